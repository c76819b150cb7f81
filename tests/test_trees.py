"""Ways through message trees, against the walk."""

import random

import pytest

from palimpsest.operators import trees
from palimpsest.sources.parsers import message_order


def found(spark, forest, current, folder):
    nodes = spark.createDataFrame([(t, k, p) for t, of in forest.items() for k, p in of.items()], "tree string, key string, parent string").repartition(3)
    ends = spark.createDataFrame([(t, k) for t, k in current.items()] or [("none", "x")], "tree string, key string")
    out = {}
    for r in sorted(trees.message_order(nodes, ends, folder).collect(), key=lambda r: (r.tree, r.place)):
        assert r.place == len(out.setdefault(r.tree, []))
        out[r.tree].append(r.key)
    return out


def walked(forest, current):
    out = {}
    for t, of in forest.items():
        children = {}
        for k, p in of.items():
            children.setdefault(p, []).append(k)
        mapping = {k: {"parent": p, "children": children.get(k, [])} for k, p in of.items()}
        out[t] = message_order(mapping, current.get(t))
    return out


def test_ways_equal_the_walk(spark, tmp_path):
    """Chains, branches, cycles with and without a tail, parents and current nodes that don't exist, single nodes."""
    r = random.Random(8)
    forest = {"chain": {f"{k:04}": f"{k - 1:04}" if k else None for k in range(700)}, "one": {"a": None}, "self": {"a": "a"}, "lost": {"a": "gone", "b": "a"}}
    forest["cycle"] = {"a": "b", "b": "c", "c": "d", "d": "b", "e": "a", "f": None}
    for t in range(12):
        keys = [f"k{r.getrandbits(30):x}" for _ in range(r.randint(1, 60))]
        forest[f"t{t}"] = {k: r.choice(keys[:j]) if j and r.random() < 0.9 else None for j, k in enumerate(keys)}
    current = {t: r.choice(sorted(of)) for t, of in forest.items() if r.random() < 0.7} | {"chain": "0699", "cycle": "e", "lost": "b", "t3": "gone"}
    assert found(spark, forest, current, f"{tmp_path}/w") == walked(forest, current)


@pytest.mark.parametrize("n", [5000])
def test_rounds_are_the_digits_of_the_length(spark, tmp_path, n):
    forest = {"x": {f"{k:06}": f"{k - 1:06}" if k else None for k in range(n)}}
    got = found(spark, forest, {"x": f"{n - 1:06}"}, f"{tmp_path}/w")
    assert got["x"] == sorted(forest["x"]) and len(list(tmp_path.glob("w/marks-*"))) <= n.bit_length() + 2
