"""Terms are counted in runs of rows, bounds are decided by counts, and what is encoded is read again instead of the text."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from postsieve.operators import blocks as B, models as M
from postsieve.plans import catalog

SF = "/root/testdata/sf0.001"


def rows_of(spark, n, seed):
    rnd = random.Random(seed)
    word = lambda k: [f"w{int(rnd.expovariate(0.3))}" for _ in range(rnd.randrange(k))]
    made = [(i, None if i % 9 == 0 else i % 3, word(5), word(30)) for i in range(n)]
    return made, spark.createDataFrame(made, "id long, part int, subj array<string>, body array<string>").coalesce(1)


def test_runs_of_rows_are_counted(spark, monkeypatch):
    made, df = rows_of(spark, 60, 1)
    monkeypatch.setattr(B, "TOKENS", 1 << 19)
    seen = B._seen(df, "part", B.WORDS).collect()
    want_cf, want_df = Counter(), Counter()
    for _, part, *lists in made:
        for b, own in zip(B.WORDS, lists, strict=True):
            want_cf.update((part, b, t) for t in own)
            want_df.update((part, b, t) for t in set(own))
    # one row a term and part of a run, however often it is there
    assert len(seen) == len(want_df) < sum(want_cf.values()) / 2
    assert {(r.part, r.block, r.term): (r.df, r.cf) for r in seen} == {k: (n, want_cf[k]) for k, n in want_df.items()}


def test_the_last_count_that_fits_is_placed_by_term(spark, monkeypatch):
    rows = [(b, f"t{i:02}", *[x for k in (0, 1) for x in (None if (i + k) % 7 == 0 else 2, 9 if i < 4 else 5 if i < 15 else 1)]) for b in ("subj", "body", "hdr") for i in range(20)]
    known = spark.createDataFrame(rows, "block string, term string, df0 long, cf0 long, df1 long, cf1 long")
    monkeypatch.setattr(B, "BLOCKS", {b: (w, 8) for b, (w, _) in B.BLOCKS.items()})
    got = B._within(known, {("body", 0): 17, ("body", 1): 17, ("subj", 1): 17}).collect()
    for i in (0, 1):
        for b in ("subj", "body", "hdr"):
            all_ = sorted(((-r[3 + 2 * i], r[1]) for r in rows if r[0] == b and r[2 + 2 * i] is not None))
            want = all_[:8] if (b, i) in {("body", 0), ("body", 1), ("subj", 1)} else all_
            assert sorted(r.term for r in got if r.block == b and r[f"df{i}"] is not None) == sorted(t for _, t in want)


def test_strongest_of_rows():
    rng = np.random.default_rng(1)
    bounds, w = np.array([0, 0, 60, 63]), rng.integers(-2, 3, 103).astype(float)
    at = np.concatenate([np.sort(rng.choice(100, n, replace=False)) for n in (60, 3)])
    x, num = rng.integers(1, 4, 63).astype(float), rng.integers(-1, 2, (3, 3)).astype(float)
    for top in (1, 5, 200):
        for i, own in enumerate(B.strongest(bounds, at, x, num, w, top)):
            cells = [(int(k), w[k] * v) for k, v in [*zip(at[bounds[i] : bounds[i + 1]], x[bounds[i] : bounds[i + 1]]), *zip(range(100, 103), num[i])]]
            assert own == sorted((c for c in cells if c[1]), key=lambda c: (-abs(c[1]), c[0]))[:top]


def test_bayes_reads_what_it_has_encoded(spark, monkeypatch):
    """Words are sought for the vocabulary and once more for the encoding, whatever is made of them."""
    want = {q: {tuple(r) for r in catalog.queries()[q](spark, SF).collect()} for q in ("cnb_margins", "cnb_reasons")}
    for name in ("margins", "contributions"):
        monkeypatch.setattr(B, name, None)
    for q in want:
        assert {tuple(r) for r in catalog.queries()[q](spark, SF).collect()} == want[q] and want[q]
    spark.catalog.clearCache()


def test_plain_models_count_once_and_break_ties_by_term(spark, monkeypatch):
    rows = [(float(i % 2), 1.0, list("zyxcba") + ["once"] * (i == 0) + ["s" if i % 2 else "h"] * 2) for i in range(6)]
    df = spark.createDataFrame(rows, "y double, w double, terms array<string>").repartition(3)
    assert sorted(M.counter(df).vocabulary) == ["a", "b", "c", "h", "s", "x", "y", "z"]
    monkeypatch.setattr(M, "VOCABULARY", 3)
    # the most frequent, equal ones by term
    assert sorted(M.counter(df).vocabulary) == ["a", "b", "c"]
    monkeypatch.setattr(M, "VOCABULARY", 9)
    model = M.fit(df, "logreg")
    assert {(r.y, r.score > 0) for r in M.scores(model, df).collect()} == {(0.0, False), (1.0, True)}
    # what was kept of the rows is given back
    assert not spark.sparkContext._jsc.getPersistentRDDs()
