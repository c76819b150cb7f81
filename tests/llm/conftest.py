import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, rid string, key string"


def make(spark, rows):
    """Documents from (doc_id, text), with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "x", "y") for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus(spark):
    """Random texts with copies, near copies, shared passages, ties, nulls, empty, one-word and long texts, repeated rows."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = say(120)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "word"), (4, "Two words"), (5, "two  WORDS")]
    for k in range(60):
        text = "\n".join(say(r.randint(3, 60)) for _ in range(r.randint(1, 6)))
        rows.append((10 + 10 * k, text))
        if k % 4 == 0:
            rows += [(11 + 10 * k, text), (12 + 10 * k, text.replace(vocab[k], "changed"))]
            words = text.split(" ")
            rows.append((13 + 10 * k, " ".join(words[: len(words) // 2] + ["new"] + words[len(words) // 2 :])))
        if k % 5 == 0:
            rows.append((14 + 10 * k, say(r.randint(0, 9)) + passage[r.randint(0, 60) :] + say(20)))
        if k % 7 == 0:
            rows.append((15 + 10 * k, text[:-1] + "z\n" + text))
    rows += [(900, "ab" * 700), (901, "x" * 900), (902, say(6000)), (10, rows[6][1]), (903, say(30)), (903, say(40)), (None, say(50)), (None, passage)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return make(spark, corpus)
