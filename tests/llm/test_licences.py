"""The licence scan against a plain scorer, and notices whose licence is known."""

import math
import random
import re

import pytest
from postsieve.llm import licences as L

SF = "/root/testdata/sf0.001"


def plain(text):
    """(families, paragraphs) of a text, with no filter before the comparison with templates."""
    families, weights, bias, temperature = L.train()
    out, n = set(), 0
    for p in re.split(L._BLANK, text or ""):
        if not re.search(r"\S", p):
            continue
        n += 1
        w, best = L.words(p), {}
        for at in range(0, max(len(w) - (L.WINDOW - L.STEP), 1), L.STEP):
            g = set(L.grams(w[at : at + L.WINDOW]))
            for name, template in L.templates():
                held = {x for x in template if x in g}
                k = families.index(name)
                z = sum(float(weights[x][k] - weights[x][-1]) for x in g if x in weights) + float(bias[k] - bias[-1])
                if sum(template[x] for x in held) >= L.CONFIRM and 1 / (1 + math.exp(-z / temperature)) >= L.CERTAIN:
                    best.setdefault(name, set()).update(held)
        out |= {f for f, h in best.items() if not any(o != f and h <= q and (len(h) < len(q) or f > o) for o, q in best.items())}
    return ",".join(sorted(out)), n


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.licences, r.n_paragraphs) for r in L.scan(df).collect()}


PROSE = "the license of the story is in the second book and the public was free to use the park " * 40
CASES = [
    ("Prose.\nReleased under the MIT License.", "MIT"), ("Licensed under the ISC License", "ISC"), ("GNU Affero General Public License v3", "AGPL"), ("licencing zzz", ""),
    ("Available under CC BY-SA 4.0.", "CC-BY-SA"), ("Published under CC BY 4.0.", "CC-BY"), ("Distributed under GPL-3.0-or-later.", "GPL"), ("SPDX-License-Identifier: MIT OR Apache-2.0", "Apache-2.0,MIT"),
    ("Dual-licensed under the MIT License and the Apache License, Version 2.0", "Apache-2.0,MIT"), ("All rights reserved. Licensed under CC BY-NC 4.0.", "CC-BY-NC,proprietary"),
    ("This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public\nLicense as published by the Free Software\nFoundation, either version 3", "GPL"),
    ("He lost his driving licence last year", ""), ("Licensed under the Foo License", ""), ("MIT is a university in Cambridge", ""), ("the general public has a license to use the park", ""),
    (PROSE, ""), (PROSE + "Released under the MIT License. " + PROSE, "MIT"), (PROSE + "All rights reserved", "proprietary"), ("Licensed under the GNU Lesser General Public License", "LGPL"), ("CC BY-NC-ND 3.0", "CC-BY-NC-ND"),
    ("The GNU General Public License or the GNU Affero General Public License", "AGPL,GPL"), ("Released under the\n \t\nMIT License", "MIT"), (None, ""), ("", ""), (" \n\n \t", ""),
]


def test_notices(spark):
    texts = [t for t, _ in CASES]
    got = scanned(spark, texts)
    assert {i: g[0] for i, g in got.items()} == {i: want for i, (_, want) in enumerate(CASES)}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert [got[i][1] for i in (3, 21, 22, 23, 24)] == [1, 2, 0, 0, 0]


def test_whole_table_by_plain_scorer(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert {r.doc_id: (r.licences, r.n_paragraphs) for r in L.scan(docs).collect()} == {r.doc_id: plain(r.text) for r in docs.collect()}


def test_needed_loses_nothing():
    """Any pairs of a template that reach CONFIRM hold a needed pair and a needed word."""
    rng = random.Random(3)
    for _, t in L.templates():
        for _ in range(50):
            some, weight = [], 0.0
            for g in rng.sample(sorted(t), len(t)):
                some.append(g)
                weight += t[g]
                if weight >= L.CONFIRM:
                    break
            assert set(some) & set(L.needed_pairs(t)) and {w for g in some for w in g.split()} & set(L.needed_words(t))
    assert max(len(L.words(t)) for f in L.NAMES for t in L.NAMES[f] + L.TEXTS.get(f, [])) <= L.STEP


def test_defined_cases(spark):
    """Repeated rows, rows without doc_id, a very long text, clashing names and empty tables."""
    rows = [(1, "CC0 1.0", "a", 1.0, 5), (1, "CC0 1.0", "b", 2.0, 6), (1, "MIT License\n\nx", "c", 3.0, 7), (None, "All rights reserved", "d", 0.0, 8), (None, None, "e", 0.0, 9), (2, "word " * 200_000 + "BSD License", "f", 0.0, 10)]
    df = spark.createDataFrame(rows, "doc_id int, text string, family string, probability double, paragraph long")
    got = {r.doc_id: (r.licences, r.n_paragraphs) for r in L.scan(df).collect()}
    assert got == {1: ("CC0,MIT", 4), None: ("proprietary", 1), 2: ("BSD", 1)}
    assert L.scan(df.where("false")).count() == 0
    assert L.scan(df).select("probability").where("probability < 0.5").count() == 0


def test_words_agree(spark):
    text = "GPL-3.0-or-later, (v. 2.0). Ünder l'État 4.0"
    row = spark.createDataFrame([(text,)], "t string").select(L.words_column("t").alias("w"), L.grams_column(L.words_column("t")).alias("g")).first()
    assert row.w == L.words(text) and sorted(row.g) == L.grams(L.words(text))


@pytest.mark.parametrize("family", sorted(L.NAMES))
def test_every_family_is_confirmed(family):
    for text in L.NAMES[family] + L.TEXTS.get(family, []):
        assert plain("Licensed under the " + text)[0].split(",").count(family) == 1


def test_common_notices(spark):
    """Standard notices and short names each give the licences that they grant, and no other."""
    gnu = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {0} as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY.  See the\nGNU {0} for more details."
    want = {
        gnu.format("General Public License"): "GPL", gnu.format("Lesser General Public License"): "LGPL", gnu.format("Affero General Public License"): "AGPL",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.": "LGPL",
        "Dual licensed under the MIT and GPL licenses.": "GPL,MIT", "GPL v3": "GPL", "MIT/X11": "MIT", "Licensed under the EUPL.": "EUPL", "MIT or GPL-3.0": "GPL,MIT",
        "Licensed under the LGPL": "LGPL", "Released under the Acme Public License": "", "He lives under the general plan": "", "License: BSD-3-Clause": "BSD",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(want)], "doc_id long, text string")
    got = {r.doc_id: r.licences for r in L.scan(df).collect()}
    assert got == dict(enumerate(want.values()))


def test_temperature_is_no_bound():
    assert 0.1 < L.train()[3] < 10
