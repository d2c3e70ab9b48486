"""Licence scans: a trained paragraph classifier, in DataFrame functions alone.

A paragraph is what stands between blank lines; its lines are joined, so a wrapped notice
is one.  Its words are read in overlapping windows of WINDOW words, STEP apart, longer by
STEP than any template, so every notice lies whole in some window and the text around it
does not decide.

A multinomial logistic regression over the distinct words and word pairs of a window is
trained on the driver from the fixed templates below (words dropped, put into ordinary
prose, two notices in one window) and from prose and notices of invented licences as the
class `unknown`; a temperature calibrates the probability of a family against `unknown`, fitted on examples
of names, clauses and sentences that the two models which score them have not seen.  A window has every family that

* reaches CERTAIN in that probability, and
* is confirmed by comparison with a template: the window holds at least CONFIRM of the
  template's word pairs by weight, where a pair weighs less the more families use it, so
  words that all notices share confirm none (a template of one word is that word).

A family all of whose pairs in a paragraph are among those of another found one is a part of
that one's notice and is not reported.

No window is skipped that could pass: of each template so many pairs are `needed` that
the others weigh less than CONFIRM, and so many words that the pairs without any of them do
(bounds that follow from the weights).  Only windows without such a pair are left unscored.
Templates meet windows in an equi-join on needed pairs; tables of templates and weights are
of fixed size.

Defined cases: null, empty and blank texts have no paragraph and no licence; very long
texts are many windows; repeated rows of a doc_id are united and their paragraphs added;
rows without doc_id are one group; of equal families the smaller name is reported; empty
tables give no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

WINDOW, STEP = 96, 48
CONFIRM, CERTAIN, UNKNOWN = 0.6, 0.5, "unknown"
LASSO = 0.00015

#: Names and identifiers of public licences, by family.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "Affero GPL", "AGPL 3.0", "AGPLv3", "AGPL v3", "the AGPL"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "Artistic": ["Artistic License 2.0", "Perl Artistic License", "Artistic-2.0"],
    "BSD": ["BSD License", "BSD-style License", "BSD-3-Clause", "BSD-2-Clause", "3-clause BSD", "2-clause BSD", "under the BSD", "License: BSD", "License-Identifier: BSD"],
    "BSL-1.0": ["Boost Software License", "BSL-1.0"],
    "CC-BY": ["CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-NC-ND": ["CC BY-NC-ND 4.0", "CC BY-NC-ND 3.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA": ["CC BY-NC-SA 4.0", "CC BY-NC-SA 3.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-ND": ["CC BY-ND 4.0", "CC BY-ND 3.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0": ["CC0 1.0", "CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero"],
    "CDDL": ["Common Development and Distribution License", "CDDL-1.0"],
    "EPL": ["Eclipse Public License", "EPL-2.0", "EPL-1.0"],
    "EUPL": ["European Union Public Licence", "EUPL-1.2", "the EUPL"],
    "GFDL": ["GNU Free Documentation License", "GFDL-1.3"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL-3.0", "GPL-2.0", "GPLv3", "GPLv2", "GPL v3", "GPL v2", "the GPL", "GPL licenses", "and GPL", "or GPL", "License: GPL", "License-Identifier: GPL"],
    "ISC": ["ISC License", "ISC licence", "License: ISC", "License-Identifier: ISC"],
    "LGPL": ["GNU Lesser General Public License", "GNU Library General Public License", "LGPL-3.0", "LGPL-2.1", "LGPLv3", "LGPLv2", "LGPL v3", "LGPL v2.1", "the LGPL", "License: LGPL", "License-Identifier: LGPL"],
    "MIT": ["MIT License", "MIT licence", "under MIT", "under the MIT", "MIT/X11", "MIT or", "License: MIT", "License-Identifier: MIT"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License", "MPL-2.0"],
    "MS-PL": ["Microsoft Public License", "MS-PL"],
    "OFL": ["SIL Open Font License", "OFL-1.1"],
    "PSF": ["Python Software Foundation License", "PSF-2.0"],
    "PostgreSQL": ["PostgreSQL License", "License: PostgreSQL", "License-Identifier: PostgreSQL"],
    "Unlicense": ["The Unlicense", "License: Unlicense", "License-Identifier: Unlicense", "unlicense.org"],
    "WTFPL": ["WTFPL", "Do What The Fuck You Want To Public License"],
    "Zlib": ["zlib License", "zlib/libpng License", "License: Zlib", "License-Identifier: Zlib"],
    "proprietary": ["All rights reserved", "proprietary and confidential", "confidential and proprietary information"],
}
#: Paragraphs of the notices and texts themselves, one sentence or clause each.
TEXTS = {
    "AGPL": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "BSL-1.0": ["free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "GFDL": ["permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"],
    "GPL": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "LGPL": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "OFL": ["This Font Software is licensed under the SIL Open Font License, Version 1.1"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    ],
    "proprietary": ["No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher"],
}
#: Ways in which a notice names its licence.
FRAMES = ["Licensed under the {}", "Released under the {}.", "This work is licensed under the {}, version 3", "SPDX-License-Identifier: {}", "distributed under the terms of the {}", "Available under {}", "{}", "License: {}", "see the {} for details"]
#: Names that no licence has, for notices of unknown ones.
INVENTED = ["Foo License", "Example Public License 3.0", "company software license", "site terms", "Acme General License, version 2", "house rules", "standard agreement 4.0", "Zorp Open Licence", "library card", "state fishing license"]
#: Sentences with licence words that grant nothing.
ORDINARY = [
    "He lost his driving licence last year", "The licence fee pays for public radio", "A fishing license is required at the lake",
    "The version of the story in the second book", "Copyright law was the subject of the lecture", "The public was free to use the park",
    "All seats are reserved for members", "The general asked for permission to redistribute the food", "MIT is a university in Cambridge",
    "Apache helicopters flew over the city", "The source of the river is in the public forest", "She works under the terms of her contract",
    "The creative commons room is open to any person", "License plates are issued by the state", "The word license occurs in this line",
    "Human rights are the subject of the work", "All rights and duties of the tenant", "Released under pressure the spring moved",
    "The python slept in the sun", "An eclipse of the moon was seen by many people", "Mozilla and Microsoft sent speakers to the meeting",
    "The boost in sales was without limit and the notice came late", "It was not the first time that they had been there with the others",
    "We use the software for any purpose that the work of the day may bring", "A person may copy the form and sell or give it to another",
]
#: Words that say little: grams of these alone are no features, and `needed` picks other words first (what it lets through does not rest on them).
COMMON = set("1.1 1.2 1.3 2 3 a all an and any are as at be by can code do either event following for form free from has held if in into is it its kind law list may must name names no not of on one or other part possible public subject that the this to under use v want was what with without work you your".split())

_GAP = "[^a-z0-9]+"
_BLANK = r"\n[ \t\r\f\x0B]*\n"


def words(text: str) -> list[str]:
    """Runs of a-z and 0-9 of the lower-case text."""
    return [w for w in re.split(_GAP, text.lower()) if w]


def grams(w: list[str]) -> list[str]:
    """Distinct words and word pairs."""
    return sorted(set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def words_column(text: Column) -> Column:
    """The same words in Spark."""
    return F.array_remove(F.split(F.lower(text), _GAP), "")


def grams_column(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.array_distinct(F.concat(w, F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))))


def pairs(w: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}) or w


@lru_cache(maxsize=1)
def templates() -> list[tuple[str, dict[str, float]]]:
    """(family, pair -> share of the template's weight) of every template."""
    own = [(f, sorted({tuple(words(t)) for t in NAMES[f] + TEXTS.get(f, [])})) for f in sorted(NAMES)]
    held: dict[str, set[str]] = {}
    for f, texts in own:
        for w in texts:
            for g in pairs(list(w)):
                held.setdefault(g, set()).add(f)
    for g in {g for t in ORDINARY for g in pairs(words(t))}:
        held.setdefault(g, set()).add(UNKNOWN)
    weight = {g: math.log((len(NAMES) + 3) / (1 + len(f))) / (3 if set(g.split()) <= COMMON else 1) for g, f in held.items()}
    out = []
    for f, texts in own:
        for w in texts:
            total = sum(weight[g] for g in pairs(list(w)))
            out.append((f, {g: weight[g] / total for g in pairs(list(w))}))
    return out


def needed(template: dict[str, float], parts: dict[str, set[str]]) -> list[str]:
    """Parts without which the rest of a template weighs less than CONFIRM; parts: what each of its pairs has."""
    alone = {w: sum(x for g, x in template.items() if w in parts[g]) for w in sorted(set().union(*parts.values()))}
    chosen: list[str] = []
    for w in sorted(alone, key=lambda w: (w in COMMON, -alone[w], w)):
        if sum(x for g, x in template.items() if not set(chosen) & parts[g]) < CONFIRM - 1e-6:
            break
        chosen.append(w)
    return chosen


def needed_words(template: dict[str, float]) -> list[str]:
    return needed(template, {g: set(g.split()) for g in template})


def needed_pairs(template: dict[str, float]) -> list[str]:
    return needed(template, {g: {g} for g in template})


@lru_cache(maxsize=1)
def train(seed: int = 7) -> tuple[list[str], dict[str, np.ndarray], np.ndarray, float]:
    """families, gram -> weights by family, biases, temperature; family k against unknown is column k less the last one."""
    rng = np.random.default_rng(seed)
    families, common = [*sorted(NAMES), UNKNOWN], sorted(COMMON)

    def prose(n: int) -> list[str]:
        out: list[str] = []
        while len(out) < n:
            out += words(ORDINARY[rng.integers(len(ORDINARY))]) if rng.random() < 0.3 else [common[i] for i in rng.integers(len(common), size=6)]
        return out[:n]

    def notice(k: int) -> tuple[list[str], int]:
        own = NAMES[families[k]]
        texts = TEXTS.get(families[k], [])
        if texts and rng.random() < 0.4:
            at = int(rng.integers(len(texts)))
            w = words(texts[at])
        else:
            at = int(rng.integers(len(own)))
            w = words(FRAMES[rng.integers(len(FRAMES))].format(own[at]))
        return [x for x in w if rng.random() > 0.06] if len(w) > 8 else w, at % 2

    def put(w: list[str]) -> list[str]:
        a, b = rng.integers(0, 50, 2) if rng.random() < 0.7 else (0, 0)
        return [*prose(a), *w, *prose(b)]

    # an example, its family, and which half of the templates it comes from
    examples: list[tuple[list[str], int, int]] = []
    for k in range(len(families) - 1):
        for own in (NAMES[families[k]], TEXTS.get(families[k], [])):
            examples += [(words(t), k, i % 2) for i, t in enumerate(own)] * 4
        for _ in range(40):
            w, half = notice(k)
            examples.append((put(w), k, half))
    for _ in range(500):
        at = int(rng.integers(len(INVENTED)))
        w = words(FRAMES[rng.integers(len(FRAMES))].format(INVENTED[at])) if rng.random() < 0.4 else []
        examples.append((put(w) or prose(5), len(families) - 1, at % 2))
    examples += [(words(t), len(families) - 1, i % 2) for i, t in enumerate(ORDINARY) for _ in range(4)]
    vocabulary = sorted({g for w, _, _ in examples for g in grams(w) if not set(g.split()) <= COMMON})
    number = {g: i for i, g in enumerate(vocabulary)}
    x = np.zeros((len(examples), len(vocabulary)), np.float32)
    for i, (w, _, _) in enumerate(examples):
        x[i, [number[g] for g in grams(w) if g in number]] = 1
    y, half = np.array([k for _, k, _ in examples]), np.array([h for _, _, h in examples])
    one = np.eye(len(families), dtype=np.float32)[y]

    def fit(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        weights, bias = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
        mine, target = x[rows], one[rows]
        for _ in range(250):
            z = mine @ weights + bias
            e = np.exp(z - z.max(1, keepdims=True))
            off = (target - e / e.sum(1, keepdims=True)) / len(mine)
            weights += 6.0 * (mine.T @ off)
            # lasso: weights of little use become zero
            weights = np.sign(weights) * np.maximum(np.abs(weights) - 6.0 * LASSO, 0)
            bias += 6.0 * off.sum(0)
        return weights, bias

    gap, yes = [], []
    for h in (0, 1):
        weights, bias = fit(half != h)
        for z, k in zip(x[half == h] @ weights + bias, y[half == h], strict=True):
            rest = [k] if k < len(families) - 1 else range(len(families) - 1)
            gap += [float(z[f] - z[-1]) for f in rest]
            yes += [k < len(families) - 1] * len(rest)
    gap, yes = np.array(gap), np.array(yes)
    # a family counts as much as unknown, whose examples stand for every family
    share = np.where(yes, 1 / yes.sum(), 1 / (~yes).sum())
    loss = lambda t: (share * np.log1p(np.exp(np.clip(np.where(yes, -gap, gap) / t, -50, 50)))).sum()
    temperature = min((t / 10 for t in range(1, 101)), key=loss)
    weights, bias = fit(np.ones(len(y), bool))
    return families, {g: np.round(weights[i].astype(float), 4) for g, i in number.items()}, np.round(bias.astype(float), 4), temperature


def _rows(spark, rows: list[dict], shape: str) -> DataFrame:
    """A table of fixed rows, as a literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{shape}>>")))


def paragraph_texts(text: Column) -> Column:
    """The texts between blank lines that are not blank."""
    return F.filter(F.split(text, _BLANK), lambda p: p.rlike(r"\S"))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, copy, paragraph (from 0), family, probability, containment: every family found in a paragraph."""
    spark = docs.sparkSession
    families, coefficients, bias, temperature = train()
    chosen = [needed_pairs(t) for _, t in templates()]
    among = lambda values: F.array(*map(F.lit, sorted({v for c in values for v in c})))
    some_words, some_pairs = among(needed_words(t) for _, t in templates()), among(chosen)
    text = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("text is not null")
    part = text.select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode(paragraph_texts(F.col("text"))).alias("paragraph", "p"))
    part = part.select("doc_id", "copy", "paragraph", words_column(F.col("p")).alias("w"))
    # a paragraph without a needed word has no window with one
    part = part.where(F.arrays_overlap("w", some_words))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - STEP), F.lit(1)), F.lit(STEP))
    window = part.select("doc_id", "copy", "paragraph", F.explode(F.transform(starts, lambda i: F.slice("w", i, WINDOW))).alias("w"))
    window = window.where(F.arrays_overlap("w", some_words)).withColumn("grams", grams_column(F.col("w")))
    window = window.select("doc_id", "copy", "paragraph", "grams", F.explode(F.array_intersect("grams", some_pairs)).alias("key"))
    index = _rows(spark, [{"key": w, "name": f, "own": [{"g": g, "x": round(x, 9)} for g, x in sorted(t.items())]} for (f, t), c in zip(templates(), chosen, strict=True) for w in c], "key string, name string, own array<struct<g string, x double>>")
    some = window.join(F.broadcast(index), "key")
    some = some.withColumn("held", F.filter("own", lambda t: F.array_contains("grams", t["g"])))
    some = some.withColumn("c", F.round(F.aggregate("held", F.lit(0.0), lambda s, t: s + t["x"]), 6)).where(F.col("c") >= CONFIRM)
    key = ["doc_id", "copy", "paragraph", "window", "name"]
    some = some.withColumn("window", F.xxhash64("grams")).groupBy(*key).agg(F.first("grams").alias("grams"), F.max("c").alias("c"), F.array_distinct(F.flatten(F.collect_set("held.g"))).alias("held"))
    # the classifier, on the windows that a template fits: sums of weights over their grams, family against unknown
    sparse = _rows(spark, [{"g": g, "of": f, "x": float(v[k])} for g, v in coefficients.items() for k, f in enumerate(families) if v[k]], "g string, of string, x double")
    biases = F.create_map(*[F.lit(v) for k, f in enumerate(families[:-1]) for v in (f, round(float(bias[k] - bias[-1]), 4))])
    sums = some.select(*key, "c", "held", F.explode("grams").alias("g")).select("*", F.explode(F.array("name", F.lit(UNKNOWN))).alias("of")).join(F.broadcast(sparse), ["g", "of"], "left")
    gap = F.sum(F.when(F.col("of") == UNKNOWN, -F.col("x")).otherwise(F.col("x")))
    sums = sums.groupBy(*key).agg(F.max("c").alias("c"), F.first("held").alias("held"), F.round(F.coalesce(gap, F.lit(0.0)), 4).alias("z"))
    p = F.round(1 / (1 + F.exp(-(F.col("z") + biases[F.col("name")]) / temperature)), 6)
    sure = sums.withColumn("p", p).where(F.col("p") >= CERTAIN)
    one = sure.groupBy("doc_id", "copy", "paragraph", "name").agg(F.max("p").alias("p"), F.max("c").alias("c"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    found = one.groupBy("doc_id", "copy", "paragraph").agg(F.collect_list(F.struct("name", "p", "c", "held")).alias("all"))
    part_of = lambda x, y: (x["name"] != y["name"]) & (F.size(F.array_except(x["held"], y["held"])) == 0) & ((F.size(x["held"]) < F.size(y["held"])) | (x["name"] > y["name"]))
    found = found.select("doc_id", "copy", "paragraph", F.explode(F.filter("all", lambda x: ~F.exists("all", lambda y: part_of(x, y)))).alias("x"))
    return found.select("doc_id", "copy", "paragraph", F.col("x.name").alias("family"), F.col("x.p").alias("probability"), F.col("x.c").alias("containment"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (families found, sorted), n_paragraphs, probability (of the best) for every doc_id."""
    found = paragraphs(docs).select("doc_id", "family", F.lit(0).alias("n"), F.col("probability").alias("p"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("family"), F.coalesce(F.size(paragraph_texts(F.coalesce("text", F.lit("")))), F.lit(0)).alias("n"), F.lit(None).cast("double").alias("p"))
    return found.unionByName(every).groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("licences"), F.sum("n").alias("n_paragraphs"), F.max("p").alias("probability"))
