"""Licence scan: a trained paragraph classifier whose predictions a comparison with templates confirms.

A multinomial logistic regression over word one- and two-grams is fitted on the templates below, in random surroundings, on sentences that
name licences without giving one, and on a bounded sample of the corpus's paragraphs, which are the unknown class. A temperature fitted on
held-out rows calibrates its probabilities. Features are the templates' two-grams that hold more than function words, whatever the sample has, and n-grams with a word
that ordinary paragraphs lack. A paragraph without any of them can't be but unknown, and only the others are scored, each distinct one once, in a join
with the weights. Paragraphs of the sample that resemble a template aren't ordinary.
"""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, release

# How licences are commonly stated.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "Released under the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU GPL version 2 or later.",
        "Released under the GPLv3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the LGPL version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-clause BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
        "This text is published under the Creative Commons Attribution licence.",
    ],
    "CC-BY-SA": [
        "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License.",
        "Content is available under CC BY-SA 4.0.",
        "This text is published under the Creative Commons Attribution ShareAlike licence.",
        "Text is available under the Creative Commons Attribution Share Alike License.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License.",
        "Content is available under CC BY-NC-SA 4.0.",
        "Published under CC BY-NC-ND 3.0.",
    ],
    "public-domain": [
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "Released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "This file is in the public domain.",
        "This is free and unencumbered software released into the public domain.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ],
}
# Short names and tags of the families, and the forms in which they are given.
NAMES = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache", "Apache 2.0", "Apache-2.0"],
    "GPL": ["GPL", "GNU GPL", "GPLv2", "GPLv3", "GPL-2.0", "GPL-3.0"],
    "LGPL": ["LGPL", "GNU LGPL", "LGPLv2", "LGPLv3", "LGPL-2.1", "LGPL-3.0"],
    "BSD": ["BSD", "BSD 2-Clause", "BSD 3-Clause"],
    "MPL-2.0": ["MPL", "MPL 2.0", "MPL-2.0"],
    "CC-BY": ["CC BY", "CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA", "CC BY-SA 4.0", "CC-BY-SA-3.0"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC 4.0", "CC-BY-NC-SA-4.0"],
    "public-domain": ["CC0", "CC0 1.0", "Unlicense"],
}
TAGS = {
    "MIT": ["MIT"],
    "Apache-2.0": ["Apache-2.0"],
    "GPL": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
    "LGPL": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"],
    "MPL-2.0": ["MPL-2.0"],
    "CC-BY": ["CC-BY-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0"],
    "public-domain": ["CC0-1.0", "Unlicense"],
}
FORMS = ["{} licensed", "Licensed under {}.", "Licensed under the {} license.", "License: {}", "Released under the {} licence.", "Available under the terms of the {} license."]
for _family, _names in NAMES.items():
    TEMPLATES[_family] += [form.format(name) for name in _names for form in FORMS] + [f"SPDX-License-Identifier: {tag}" for tag in TAGS[_family]]
# Sentences that name licences and give none.
NEGATIVES = [
    "He lost his driver's license on the way to the station.",
    "The city issues a license to each street vendor.",
    "A licensed electrician must inspect the wiring.",
    "Human rights are reserved for nobody in particular.",
    "The public library is open on Sunday.",
    "The version of the story that he told was free of facts.",
    "She reserved a table for two under her name.",
    "The patent and copyright office opens at nine.",
    "The general public was not permitted to enter the building.",
    "Which license should I choose for my project?",
    "The apache helicopter landed near the source of the river.",
]
# Words that say nothing about a licence, not by twos either.
FUNCTION_WORDS = set("a all and any are as at be been by can for from has in into is it may no not of on or out that the this to under which with without you".split())
UNKNOWN = "unknown"
_WORD = re.compile(r"[\w.]*\w")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def _pairs(text: str) -> set[str]:
    return {g for g in _grams(_words(text)) if " " in g}


TEMPLATE_PAIRS = [(name, _pairs(t)) for name, ts in TEMPLATES.items() for t in dict.fromkeys(ts) if _pairs(t)]
#: How much a two-gram says of a family: one over the number of families that have it in a template.
_HAVE = {g: {name for name, own in TEMPLATE_PAIRS if g in own} for _, two in TEMPLATE_PAIRS for g in two}
SAYS = {g: 1 / len(names) for g, names in _HAVE.items()}
#: Those that open the gate by themselves.
DISTINCTIVE = {g for _, own in TEMPLATE_PAIRS for g in own if not FUNCTION_WORDS.issuperset(g.split(" "))}


def resembles(paragraph: str, least: float = 0.5) -> bool:
    """Whether it holds ``least`` of the two-grams of any template."""
    own = _pairs(paragraph)
    return any(len(own & two) >= least * len(two) for _, two in TEMPLATE_PAIRS)


def _gate_of_pairs() -> str:
    """A regular expression for lower-cased text that finds all of DISTINCTIVE, by first letter and first word."""
    tree: dict[str, dict[str, list[str]]] = {}
    for g in sorted(DISTINCTIVE):
        a, b = g.split(" ")
        tree.setdefault(a[0], {}).setdefault(a[1:], []).append(re.escape(b))
    first = (re.escape(c) + "(?:" + "|".join(re.escape(a) + r"[^\p{L}\p{N}_]+(?:" + "|".join(bs) + ")" for a, bs in words.items()) + ")" for c, words in tree.items())
    return r"(?<![\p{L}\p{N}_])(?:" + "|".join(first) + ")"


class Model:
    """Weights by n-gram and class, bias, temperature; unknown is the first class."""

    def __init__(self, background: list[str], seed: int = 3, copies: int = 6, steps: int = 150):
        pick = random.Random(seed)
        plain = [w for w in (_words(p) for p in background) if w]
        common = {w for ws in plain for w in ws}
        self.anchors = sorted({w for ts in TEMPLATES.values() for t in ts for w in _words(t) if w not in common and not w.replace(".", "").isdigit()})
        anchors = set(self.anchors)
        self.classes = [UNKNOWN, *TEMPLATES]
        filler = [w for ws in plain[:200] for w in ws][:5000] or ["a"]
        some = lambda: [pick.choice(filler) for _ in range(pick.choice((0, 0, 3, 12)))]
        rows = [(0, ws) for ws in plain] + [(0, some() + _words(t) + some()) for t in NEGATIVES for _ in range(copies)]
        rows += [(k, some() + _words(t) + some()) for k, name in enumerate(self.classes) if k for t in TEMPLATES[name] for _ in range(copies)]
        # stray licence words alone are unknown
        rows += [(0, some() + [pick.choice(self.anchors)] + some()) for _ in range(20 * copies)] if self.anchors else []
        pick.shuffle(rows)
        grams = [{g for g in _grams(ws) if g in DISTINCTIVE or anchors & set(g.split(" "))} for _, ws in rows]
        self.grams = sorted(set().union(*grams))
        index = {g: i for i, g in enumerate(self.grams)}
        x, y = np.zeros((len(rows), len(self.grams)), np.float32), np.array([k for k, _ in rows])
        for i, own in enumerate(grams):
            x[i, [index[g] for g in own]] = 1
        held = np.arange(len(rows)) % 5 == 4
        target = np.eye(len(self.classes), dtype=np.float32)[y]
        self.weights, self.bias = np.zeros((len(self.grams), len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        self.bias[0] = 1
        xt, tt = x[~held], target[~held]
        move, push = np.zeros_like(self.weights), np.zeros_like(self.bias)
        for _ in range(steps):
            off = (_softmax(xt @ self.weights + self.bias) - tt) / len(xt)
            move, push = 0.9 * move + xt.T @ off + 1e-5 * self.weights, 0.9 * push + off.sum(axis=0)
            self.weights -= 2.0 * move
            self.bias -= 2.0 * push
        self.bias[0] = max(self.bias[0], self.bias[1:].max() + 1)  # nothing known: unknown
        scores = x[held] @ self.weights + self.bias
        likely = [-np.log(_softmax(scores / t)[np.arange(held.sum()), y[held]] + 1e-9).mean() for t in np.geomspace(0.25, 4, 33)]
        self.temperature = float(np.geomspace(0.25, 4, 33)[int(np.argmin(likely))])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def scan(docs: DataFrame, max_sample_docs: int = 200, max_sample_paragraphs: int = 4000, max_sample_chars: int = 2_000_000, least_probability: float = 0.5, least_likeness: float = 0.6) -> DataFrame:
    """(doc_id, text, ...) -> doc_id, paragraph, family, probability, likeness, confirmed: a row for each paragraph with a licence.

    Paragraphs are lines, numbered from 0. A row is there where a family is likelier than ``least_probability``, after calibration; ``confirmed``
    where the paragraph holds ``least_likeness`` of one of the family's templates: of its two-grams, each weighed by how few families have it, and at
    least one that this family alone has. The unknown class is trained on
    ``max_sample_paragraphs`` paragraphs of ``max_sample_docs`` documents (both first by a hash; about ``max_sample_chars`` in all). Null and empty texts have no paragraphs with a licence.
    Repeated rows give repeated rows; other columns are ignored, whatever their names; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample_docs)
    sample = docs.join(F.broadcast(ids), "doc_id").select(F.explode(F.split("text", "\n")).alias("p")).select(F.substring("p", 1, max_sample_chars).alias("p")).orderBy(F.xxhash64("p")).limit(max_sample_paragraphs).collect()
    background, size = [], 0
    named = re.compile(r"licen[sc]e|copyright|rights reserved|\bcc by\b|public domain", re.IGNORECASE)
    for r in sample:
        if size < max_sample_chars and not named.search(r["p"]) and not resembles(r["p"]):
            background.append(r["p"])
            size += len(r["p"])
    model = Model(background)
    words = F.expr(r"regexp_extract_all(lower(p), '[\\p{L}\\p{N}_.]*[\\p{L}\\p{N}_]', 0)")
    anchors = F.split(F.lit("\n".join(model.anchors)), "\n")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "p"))
    # the words of the gate are found in the plain split of the lower-cased paragraph: those of a feature stand between marks or white space
    gate = F.arrays_overlap(F.split(F.lower("p"), r"[^\p{L}\p{N}_.]+|\.+(?![\p{L}\p{N}_])"), anchors)
    # few lines pass the gate: they are written once, as they are read three times
    hits = materialize(rows.where(gate | F.lower("p").rlike(_gate_of_pairs())), "gated-lines")
    distinct = hits.select("p").distinct().select("p", words.alias("w"))
    pairs = F.expr("case when size(w) > 1 then transform(sequence(0, size(w) - 2), i -> concat(get(w, i), ' ', get(w, i + 1))) else cast(array() as array<string>) end")
    grams = distinct.select("p", F.array_distinct(pairs).alias("two"), F.array_distinct(F.concat("w", pairs)).alias("all"))
    k = len(model.classes)
    table = spark.createDataFrame([(g, [float(v) for v in model.weights[i]]) for i, g in enumerate(model.grams)] or [("", [0.0] * k)], "gram string, weights array<double>")
    # as many weights as n-grams of the templates and the bounded sample
    met = grams.select("p", F.explode("all").alias("gram")).join(F.broadcast(table), "gram")
    sums = met.groupBy("p").agg(*(F.sum(F.col("weights")[i]).alias(f"s{i}") for i in range(k)))
    z = [(F.col(f"s{i}") + float(model.bias[i])) / model.temperature for i in range(k)]
    top = F.greatest(*z)
    scored = sums.select("p", F.array(*(F.exp(x - top) for x in z)).alias("e"))
    scored = scored.withColumn("probability", F.expr("array_max(e) / aggregate(e, 0D, (a, x) -> a + x)")).withColumn("family", F.element_at(F.array(*map(F.lit, model.classes)), F.expr("cast(array_position(e, array_max(e)) as int)")))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least_probability)).select("p", "family", "probability")
    templates = spark.createDataFrame([(name, [(g, SAYS[g]) for g in sorted(two)], sum(SAYS[g] for g in sorted(two))) for name, two in TEMPLATE_PAIRS], "family string, template array<struct<g: string, says: double>>, whole double")
    held = F.filter("template", lambda x: F.array_contains("two", x["g"]))
    part = F.when(F.exists("held", lambda x: x["says"] == 1), F.aggregate("held", F.lit(0.0), lambda a, x: a + x["says"]) / F.col("whole")).otherwise(0.0)
    like = scored.join(grams.select("p", "two"), "p").join(F.broadcast(templates), "family").withColumn("held", held).groupBy("p").agg(F.max(part).alias("likeness"))
    found = scored.join(like, "p")
    out = hits.join(found, "p").select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), F.round("likeness", 6).alias("likeness"), (F.col("likeness") >= least_likeness).alias("confirmed"))
    out = materialize(out, "licences")
    release(hits)
    return out
