"""License families of paragraphs: sparse word n-gram logistic regression with a calibrated unknown class, then a template
comparison. Scoring uses DataFrame functions only.

Training rows are made from the templates below: whole, shortened, with words dropped, inserted and exchanged; wording that
no family has is the class `unknown`, and paragraphs of the corpus without any license cue (a bounded sample of `NEGATIVES`)
are the class `none`. Features are the one- and two-word n-grams of the templates, so ordinary prose has hardly any. The
weights are fitted by numpy on the driver; a temperature and the least probability are set on held-out rows. In Spark the
model is a literal table: an n-gram's hash gives a slot, the slot's full hash tells whether it is a feature.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, fenced, query, shielded

NEGATIVES = 1500
VARIANTS = 60
SEED = 11
#: Held-out rows accepted by the least probability are right at least this often.
PRECISION = 0.995
#: Share of a template's n-grams that a paragraph must hold to confirm its family.
CONFIRM = 0.6

# Wording of public licenses and of notices that name them, by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "mit": [
        "Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "This project is licensed under the terms of the MIT license",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3", "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
        "GNU General Public License version 3 GPLv3",
    ],
    "gpl-2.0": ["GNU General Public License version 2 as published by the Free Software Foundation", "licensed under the GNU General Public License, version 2 GPLv2"],
    "lgpl": ["GNU Lesser General Public License as published by the Free Software Foundation", "licensed under the GNU Lesser General Public License LGPL"],
    "agpl-3.0": ["GNU Affero General Public License as published by the Free Software Foundation version 3", "licensed under the GNU Affero General Public License AGPL"],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Released under the BSD 3-Clause License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "licensed under the Mozilla Public License, version 2.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related rights CC0 1.0 Universal", "dedicated to the public domain under CC0"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Titles and SPDX identifiers, by family. All of a title's n-grams confirm it.
TITLES = {
    "apache-2.0": ["Apache License", "Apache-2.0", "Apache 2"], "mit": ["MIT License", "The MIT License (MIT)"], "gpl-3.0": ["GPLv3", "GPL-3.0", "GPL-3.0-or-later", "GPL-3.0-only", "GPL v3", "GPL version 3", "GNU General Public License v3.0"],
    "gpl-2.0": ["GPLv2", "GPL-2.0", "GPL-2.0-or-later", "GPL-2.0-only", "GPL v2", "GPL version 2", "GNU General Public License v2.0"], "lgpl": ["LGPL", "LGPLv3", "LGPLv2.1", "LGPL-3.0-or-later", "LGPL-2.1-only", "GNU Lesser General Public License"],
    "agpl-3.0": ["AGPL", "AGPLv3", "AGPL-3.0-or-later", "AGPL-3.0-only", "GNU Affero General Public License"], "bsd": ["BSD-3-Clause", "BSD-2-Clause", "BSD License"], "mpl-2.0": ["MPL-2.0", "MPL 2", "Mozilla Public License"],
    "cc-by-nc": ["CC-BY-NC-4.0", "CC BY-NC"], "cc-by-sa": ["CC-BY-SA-4.0", "CC BY-SA"], "cc-by": ["CC-BY-4.0"], "cc0": ["CC0", "CC0-1.0"], "isc": ["ISC License"], "unlicense": ["Unlicense", "The Unlicense"],
}
# Short names that are words of prose too, so only the identifier's form confirms them.
TITLES = {k: v + [f"{lead} {x}" for x in {"mit": ["MIT"], "isc": ["ISC"]}.get(k, []) for lead in ("SPDX-License-Identifier:", "License:")] for k, v in TITLES.items()}
# License wording of no family.
UNKNOWN = [
    "All rights reserved. No part of this publication may be reproduced without permission", "Use of this software is governed by the license agreement between the parties",
    "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited", "licensed under the terms of the agreement that you have accepted", "Licensed under the company license, version 1",
    "You may use this work under the conditions of the accompanying license", "This software is licensed, not sold", "released under a custom license",
]
FAMILIES = [*TEMPLATES, "unknown", "none"]
CUE = r"licen[cs]|copyright|warrant|redistribut|permission|public domain|creative commons|\bcc[ -]by\b|\bgnu\b"
GAP = "[^a-z0-9.]+"


def words_of(paragraph: Column) -> Column:
    """Words in lower case without outer dots."""
    return F.filter(F.transform(F.split(F.lower(paragraph), GAP), lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def _text_grams(text: str) -> list[str]:
    words = [w for w in (x.strip(".") for x in re.split(GAP, text.lower())) if w]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _variants(text: str, filler: list[str], rng: np.random.Generator) -> str:
    words = text.split()
    if len(words) > 12 and rng.random() < 0.4:
        a = int(rng.integers(0, len(words) - 10))
        words = words[a : a + int(rng.integers(10, 30))]
    out = [w for w in words if rng.random() > 0.05]
    for _ in range(int(rng.integers(0, 4))):
        out.insert(int(rng.integers(0, len(out) + 1)), filler[int(rng.integers(0, len(filler)))])
    if rng.random() < 0.3:
        out = [*(filler[int(i)] for i in rng.integers(0, len(filler), 6)), *out, *(filler[int(i)] for i in rng.integers(0, len(filler), 6))]
    return " ".join(out)


class Model:
    """Features, weights (feature by class, last row the bias), temperature and least probability."""

    def __init__(self, prose: list[str], variants: int = VARIANTS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        filler = [w for p in prose for w in p.split()] or ["and", "of", "it"]
        rows: list[tuple[str, int]] = [(p, len(FAMILIES) - 1) for p in prose]
        for label, texts in enumerate([*TEMPLATES.values(), UNKNOWN]):
            for _ in range(variants):
                rows.append((_variants(texts[int(rng.integers(0, len(texts)))], filler, rng), label))
            rows += [(t, label) for t in texts]
        for label, texts in enumerate(TITLES.values()):
            for t in texts:
                forms = [t, t, *([] if "License:" in t or "Identifier:" in t else [f"SPDX-License-Identifier: {t}", f"License: {t}"])]
                rows += [(x, label) for x in forms] * 3
                rows += [(" ".join([*(filler[int(i)] for i in rng.integers(0, len(filler), 4)), x]), label) for x in forms]
        for _ in range(2 * variants):  # single words of licenses in prose
            words = [filler[int(i)] for i in rng.integers(0, len(filler), 30)]
            own = [w for t in TEMPLATES.values() for x in t for w in x.split()]
            words += [own[int(i)] for i in rng.integers(0, len(own), 3)]
            rows.append((" ".join(words), len(FAMILIES) - 1))
        self.features = {g: i for i, g in enumerate(dict.fromkeys(g for texts in [*TEMPLATES.values(), UNKNOWN, *TITLES.values()] for t in texts for g in _text_grams(t)))}
        # features of one family, or that hold a license cue: a paragraph with one of them is scored
        of = [{g for t in [*TEMPLATES.get(k, UNKNOWN), *TITLES.get(k, [])] for g in _text_grams(t)} for k in FAMILIES[:-1]]
        self.telling = [bool(re.search(CUE, g)) or sum(g in x for x in of) == 1 for g in self.features]
        order = rng.permutation(len(rows))
        held = order[: len(rows) // 5]
        fit = order[len(rows) // 5 :]
        x = np.zeros((len(rows), len(self.features) + 1))
        x[:, -1] = 1
        for i, (text, _) in enumerate(rows):
            x[i, [self.features[g] for g in set(_text_grams(text)) if g in self.features]] = 1
        y = np.array([label for _, label in rows])
        self.weights = self._fit(x[fit], y[fit])
        self.temperature, self.least = self._calibrate(x[held] @ self.weights, y[held])

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 2.0, shrink: float = 3e-5) -> np.ndarray:
        w = np.zeros((x.shape[1], len(FAMILIES)))
        speed = np.zeros_like(w)
        target = np.eye(len(FAMILIES))[y]
        for _ in range(rounds):
            slope = x.T @ (self._softmax(x @ w) - target) / len(y)
            speed = 0.9 * speed - rate * slope
            w = w + speed
            w = np.sign(w) * np.maximum(np.abs(w) - rate * shrink, 0)  # keeps the weights sparse
        return w

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
        loss = lambda t: -np.log(self._softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        temperature = min(np.geomspace(0.25, 8, 60), key=loss)
        p = self._softmax(z / temperature)
        best, right = p.max(1), p.argmax(1) == y
        known = p.argmax(1) < len(TEMPLATES)
        for least in np.linspace(0.3, 0.95, 66):
            own = known & (best >= least)
            if not own.any() or right[own].mean() >= PRECISION:
                break
        return float(temperature), float(least)


def _table(model: Model, hashes: dict[str, int]) -> tuple[int, list[int], list[int]]:
    """(slots, full hash of each slot, feature of each slot): a power of two of slots in which no two features meet."""
    slots = 1 << 12
    while True:
        used = {}
        for g, h in hashes.items():
            used.setdefault(h % slots, []).append((h, model.features[g]))
        if all(len(x) == 1 for x in used.values()) or slots >= 1 << 20:
            names, ids = [0] * slots, [-1] * slots
            for s, x in used.items():
                names[s], ids[s] = x[0]
            return slots, names, ids
        slots *= 2


def _literal(values: list, kind: str) -> Column:
    """An array that the optimizer folds to one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def train(docs: DataFrame, negatives: int = NEGATIVES, variants: int = VARIANTS, seed: int = SEED) -> Model:
    """A model whose `none` class comes from at most `negatives` cue-free paragraphs of `docs`, taken by their hash."""
    paragraphs = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p")).filter(f"length(p) between 20 and 2000 and not lower(p) rlike '{CUE.replace(chr(92), chr(92) * 2)}'")
    # one for each remainder of the hash, by a combining aggregation: no task sends the driver more than it keeps
    hashed = paragraphs.select("p", F.xxhash64("p").alias("h"))
    sample = hashed.groupBy(F.pmod("h", F.lit(negatives)).alias("k")).agg(F.min_by("p", F.struct("h", "p")).alias("p"))
    return Model(sorted(r["p"] for r in sample.collect()), variants, seed)


@shielded
def licenses(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with license_lines added: an array of (line, last_line, family, probability, confirmed) for each notice that the
    model does not take for `none`. A notice is a paragraph (neighbouring lines with words, comment marks are none); lines
    that are confirmed by themselves are notices of their own, and what is left between them are others.

    A family below the least probability, or whose templates don't confirm it, is `unknown`. A null or empty text has an
    empty array. Computed within the row: no shuffle; repeated rows and ids don't matter. A column of the input with that
    name is replaced.
    """
    spark = docs.sparkSession
    named = spark.createDataFrame([(g,) for g in model.features], "g string").select("g", F.xxhash64("g").alias("h")).collect()
    slots, names, ids = _table(model, {r["g"]: r["h"] for r in named})
    names, ids = _literal(names, "bigint"), _literal(ids, "int")
    weights = [_literal([round(float(x), 6) for x in model.weights[:-1, c] / model.temperature], "double") for c in range(len(FAMILIES))]
    telling = _literal([int(x) for x in model.telling], "int")
    bias = [float(x) for x in model.weights[-1] / model.temperature]

    def known(gram: Column) -> Column:
        slot = F.pmod(F.xxhash64(gram), F.lit(slots)).cast("int")
        return F.when(F.get(names, slot) == F.xxhash64(gram), F.get(ids, slot)).otherwise(F.lit(-1))

    def pairs(words: Column, single: Column) -> Column:
        both = lambda i: (i > 0) & (F.get(single, i) >= 0) & (F.get(single, i - 1) >= 0)
        return F.transform(words, lambda w, i: F.when(both(i), known(F.concat_ws(" ", F.get(words, i - 1), w))).otherwise(F.lit(-1)))

    out = docs.withColumn("_words", F.transform(F.split(F.coalesce(F.col("text"), F.lit("")), "\n"), words_of))
    out = out.withColumn("_single", F.transform("_words", lambda words: F.transform(words, known)))
    every = lambda words, j: F.concat(F.get("_single", j), pairs(words, F.get("_single", j)))
    # the pair over the end of the line before
    last = lambda of, j: F.try_element_at(F.get(of, j - 1), F.lit(-1))
    over = F.transform("_words", lambda words, j: F.when((j > 0) & (last(F.col("_single"), j) >= 0) & (F.get(F.get("_single", j), 0) >= 0), known(F.concat_ws(" ", last(F.col("_words"), j), F.get(words, 0)))).otherwise(F.lit(-1)))
    out = out.withColumn("_over", over).withColumn("_empty", F.transform("_words", lambda words: F.size(words) == 0))
    out = out.withColumn("_found", F.transform("_words", lambda words, j: F.array_distinct(F.filter(every(words, j), lambda x: x >= 0)))).drop("_words", "_single")

    score = lambda x, c: F.aggregate(x, F.lit(bias[c]), lambda a, f: a + F.get(weights[c], f))
    told = lambda x: F.exists(x, lambda f: F.get(telling, f) == 1)
    templates = F.array(*(F.array(*(F.array(*map(F.lit, sorted({model.features[g] for g in _text_grams(t)}))) for t in texts)) for texts in [*TEMPLATES.values(), UNKNOWN]))
    titles = F.array(*(F.array(*(F.array(*map(F.lit, sorted({model.features[g] for g in _text_grams(t)}))) for t in TITLES[k])) for k in TEMPLATES))
    holds = lambda of, found, b, share: F.exists(F.get(of, b), lambda t: F.size(F.array_intersect(t, found)) >= share * F.size(t))
    close = lambda found, b: (b < len(TEMPLATES)) & (holds(templates, found, b, CONFIRM) | F.coalesce(holds(titles, found, b, 1), F.lit(False)))
    joined = lambda s, e: F.array_distinct(F.concat(F.flatten(F.slice("_found", s + 1, e - s + 1)), F.filter(F.slice("_over", s + 2, e - s), lambda x: x >= 0)))

    def judged(out: DataFrame, name: str) -> DataFrame:
        """b (class), probability and confirmed added to the structs (s, e, found) of a column, those without a telling feature taken out."""
        out = out.withColumn(name, F.filter(name, lambda x: told(x["found"])))
        out = out.withColumn("_scores", F.transform(name, lambda x: F.array(*(score(x["found"], c) for c in range(len(FAMILIES))))))
        out = out.withColumn("_best", F.transform("_scores", lambda z: (F.array_position(z, F.array_max(z)) - 1).cast("int")))
        out = out.withColumn("_p", F.transform("_scores", lambda z: 1 / F.aggregate(z, F.lit(0.0), lambda a, y: a + F.exp(y - F.array_max(z)))))
        both = F.arrays_zip(F.col(name).alias("x"), F.col("_best").alias("b"), F.col("_p").alias("p"))
        full = F.transform(both, lambda y: F.struct(y["x"]["s"].alias("s"), y["x"]["e"].alias("e"), y["x"]["found"].alias("found"), y["b"].alias("b"), y["p"].alias("p"), close(y["x"]["found"], y["b"]).alias("ok")))
        return out.withColumn(name, full).drop("_scores", "_best", "_p")

    def runs(apart: str) -> Column:
        """(s, e, found) of the longest runs of lines that `apart` (an array of booleans) does not mark."""
        edge = lambda i: F.coalesce(F.get(apart, i), F.lit(True))
        ends = lambda step: F.filter(F.transform(apart, lambda x, i: F.when(~x & (F.when(i + step >= 0, edge(i + step)).otherwise(True)), i).otherwise(F.lit(-1))), lambda i: i >= 0)
        return F.transform(F.arrays_zip(ends(-1).alias("s"), ends(1).alias("e")), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), joined(x["s"], x["e"]).alias("found")))

    none = F.expr("array()").cast("array<int>")
    sure = lambda x: x["ok"] & (x["p"] >= model.least)
    # whole paragraphs first, then lines that are notices by themselves
    out = judged(out.withColumn("_paras", runs("_empty")), "_paras")
    out = judged(out.withColumn("_lines", F.transform("_found", lambda x, i: F.struct(i.alias("s"), i.alias("e"), x.alias("found")))), "_lines")
    out = out.withColumn("_lines", F.filter("_lines", sure))
    # a line of another family than its confirmed paragraph stands only if the paragraph is confirmed without it too
    outer = F.map_from_entries(F.flatten(F.transform("_paras", lambda x: F.transform(F.sequence(x["s"], x["e"]), lambda i: F.struct(i, F.struct(x["s"].alias("s"), x["e"].alias("e"), x["b"].alias("b"), sure(x).alias("sure")))))))
    out = out.withColumn("_outer", outer)
    without = lambda y, i: F.array_distinct(F.concat(F.when(i > y["s"], joined(y["s"], i - 1)).otherwise(none), F.when(i < y["e"], joined(i + 1, y["e"])).otherwise(none)))
    stands = lambda x, y: ~y["sure"] | (y["b"] == x["b"]) | close(without(y, x["s"]), y["b"])
    out = out.withColumn("_lines", F.filter("_lines", lambda x: stands(x, F.try_element_at(F.col("_outer"), x["s"]))))
    # what is left of the paragraphs between these lines
    out = out.withColumn("_own", F.transform("_lines", lambda x: x["s"])).withColumn("_apart", F.transform("_empty", lambda x, i: x | F.array_contains("_own", i)))
    out = judged(out.withColumn("_rest", runs("_apart")), "_rest")
    # the rest of a notice is of its family if its paragraph is confirmed
    again = lambda x, y: x["ok"] | ((x["b"] == y["b"]) & y["sure"])
    drop = lambda x: F.struct(x["s"].alias("line"), x["e"].alias("last_line"), x["b"].alias("b"), x["p"].alias("probability"), again(x, F.try_element_at(F.col("_outer"), x["s"])).alias("confirmed"))
    out = out.withColumn("_kinds", F.filter(F.array_sort(F.transform(F.concat("_lines", "_rest"), drop)), lambda x: x["b"] < len(FAMILIES) - 1))
    family = lambda x: F.when((x["probability"] >= model.least) & x["confirmed"], F.get(F.lit(FAMILIES), x["b"])).otherwise(F.lit("unknown"))
    result = F.transform("_kinds", lambda x: F.struct(x["line"].alias("line"), x["last_line"].alias("last_line"), family(x).alias("family"), F.round(x["probability"], 6).alias("probability"), x["confirmed"].alias("confirmed")))
    return fenced(out.withColumn("license_lines", result).drop("_found", "_over", "_empty", "_paras", "_lines", "_outer", "_own", "_apart", "_rest", "_kinds"))


@query("op1_license_scan")
def op1(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    found = licenses(docs, train(docs))
    return found.select(
        "doc_id", F.size("license_lines").cast("long").alias("n_license_lines"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("license_lines", lambda x: x["family"]))), ",").alias("families"),
        F.size(F.filter("license_lines", lambda x: x["confirmed"])).cast("long").alias("n_confirmed"),
    )
