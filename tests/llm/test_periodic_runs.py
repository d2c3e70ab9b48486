"""Periodic runs against a plain search of every period and stretch."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postsieve.llm import periodic_runs, queries

EXTRA = "n_words long, runs string, start long, collapsed string"


def plain(w, least, times):
    """All runs (start, length, period), by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(least, times * q):
                found.setdefault((i, n), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def of(texts, least, times):
    n = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    return periodic_runs.text_runs(pa.array([w.encode() for t in texts for w in t], pa.binary()), n, least, times)


def random_texts(rng, n):
    out = []
    for _ in range(n):
        kind, size = rng.randrange(4), rng.randrange(0, 90)
        w = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(size)]
        if kind == 0:
            w = (w[: rng.randrange(1, 12)] or ["a"]) * rng.randrange(1, 9) + w
        elif kind == 1:
            w = w + ["x"] + w + ["y"] + w[3:]
        elif kind == 2:
            a, b = ["a"], ["a", "b"]
            for _ in range(rng.randrange(1, 8)):
                a, b = b, b + a
            w = b
        out.append(w)
    return out


@pytest.mark.parametrize("least,times", [(2, 2), (5, 2), (6, 3), (24, 3), (1, 4)])
def test_all_runs_of_random_texts(least, times):
    texts = random_texts(random.Random(least * 10 + times), 400)
    assert of(texts, least, times) == [plain(t, least, times) for t in texts]


def test_factors_and_previous_factors():
    texts = random_texts(random.Random(5), 30)
    s = "".join("".join(t) + chr(1000 + i) for i, t in enumerate(texts))
    s = chr(999) + s
    f = periodic_runs.Factors(np.array([ord(c) for c in s], np.int64))
    assert f.suffixes.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    longest, source = periodic_runs.previous_factors(f)
    for i in range(len(s)):
        want = max((n for n in range(len(s) - i + 1) if s.find(s[i : i + n]) < i), default=0)
        assert longest[i] == want
        assert not want or (source[i] < i and s[source[i] : source[i] + want] == s[i : i + want])


def test_odd_rows(spark):
    """Nulls, blanks, repeated rows and doc_ids, a very long text, clashing columns, an empty table."""
    rng = random.Random(3)
    period = [f"p{i}" for i in range(7)]
    long = [rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(40_000)] + period * 900 + ["É", "世界"] * 40
    texts = [None, "", " \n ", "one two", " ".join(period * 5), " ".join(period * 5), "x " * 24, "x " * 23, "x\x00y\t" * 30, " ".join(long)]
    rows = [(i, t, 1, "r", 2, "c") for i, t in enumerate(texts)] + [(4, texts[4], 1, "r", 2, "c"), (4, "z " * 30, 1, "r", 2, "c"), (None, texts[4], 1, "r", 2, "c")]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {EXTRA}")
    got = sorted((str(r.doc_id), [tuple(x) for x in r.runs], r.n_words, r.collapsed) for r in periodic_runs.find_runs(df).collect())
    want = []
    for d, t, *_ in rows:
        w = "".join("\n" if c in " \t\n\v\f\r" else c for c in t or "").split("\n")
        w = [x for x in w if x]
        # the long text's own runs are known: trying every period takes too long
        runs = plain(w, 24, 3) if len(w) < 5000 else [(40_000, 6300, 7), (46_300, 80, 2)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        want.append((str(d), runs, len(w), " ".join(x for i, x in enumerate(w) if i not in gone)))
    assert got == sorted(want)
    assert periodic_runs.find_runs(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, times=1)


def test_digests(spark, tmp_path):
    """The query's planted repeats and digests by plain Python."""
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(0, 120)))) for i in range(150)]
    rows += [(200 + i, " ".join(["a", "b"] * 20 + ["c"] + ["d"] * rng.randrange(20, 30))) for i in range(10)] + [(None, "q " * 40), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for d, t in rows:
        w, h = (t or "").split(), None if d is None else zlib.crc32(str(d).encode())
        if h is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = plain(w, 24, 3)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((d, len(runs), s, n, q, runs and 1000 * n // q or None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    got = [tuple(r) for r in queries.op12_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(r[1] for r in got)
