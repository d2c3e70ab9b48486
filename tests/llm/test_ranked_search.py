"""Ranked lexical search against a plain loop over all documents."""

import math
import random
import re

import pytest

from postsieve.llm import ranked_search

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
EXTRA = "score long, rank int, n long, terms string, q long"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k):
    held = [(d, words(t)) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    out = []
    for item, text in items:
        mine, scores = set(words(text)), []
        weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in w for _, w in held) + 1))) for t in mine}
        for d, w in held:
            m = 50 + 50 * len(w) * n_docs // total
            s = sum(weight[t] * (10**9 * w.count(t) // (1000 * w.count(t) + 20 * m)) for t in mine if t in w)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("k", [3, 50])
def test_against_all_documents(spark, k):
    rng = random.Random(k)
    vocabulary = [f"w{i}" for i in range(120)] + ["Straße", "世界", "É9", "a-b"]
    some = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.04)), 123)] for _ in range(n))
    docs = [(i, some(rng.randrange(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(80)] + [docs[9], docs[9], (9, "w1 W2"), (None, "w3 w3 é9"), (None, None), (501, None), (502, ""), (503, " .-. "), (504, some(40_000))]
    items = [(i, some(rng.randrange(1, 20))) for i in range(30)] + [(3, "w5 w6"), (None, "w3 É9"), (77, None), (78, "..."), (79, "nowhere"), (80, "w1 nowhere W1"), (80, "w1 nowhere W1"), (81, docs[7][1])]
    rng.shuffle(docs)
    a = spark.createDataFrame([(d, t, 1, 2, 3, "x", 4) for d, t in docs], f"doc_id long, text string, {EXTRA}").repartition(5)
    b = spark.createDataFrame([(d, t, 1, 2, 3, "x", 4) for d, t in items], f"item_id long, text string, {EXTRA}")
    got = [tuple(r) for r in ranked_search.search(a, b, k).collect()]
    want = plain(docs, items, k)
    assert sorted(got, key=key) == sorted(want, key=key)
    blocks = [tuple(r) for r in ranked_search.search(a, b, k, block_items=9).collect()]
    assert sorted(blocks, key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "one two")], "doc_id long, text string"), spark.createDataFrame([(5, "two")], "item_id long, text string")
    assert [tuple(r)[:3] for r in ranked_search.search(docs, items).collect()] == [(5, 1, 1)]
    assert ranked_search.search(docs.where("false"), items).count() == 0
    assert ranked_search.search(docs, items.where("false")).count() == 0


def test_pruned_terms_leave_few_candidates(spark):
    """A frequent term below the bound makes no candidates, and results stay whole."""
    import numpy as np
    import pyarrow as pa

    items = ranked_search.Items(pa.table({"item_id": [1, 2], "text": ["rare common", "common"]}))
    at = {t.as_py(): i for i, t in enumerate(items.vocabulary)}
    most, kth = np.zeros(2, np.int64), np.zeros(2, np.int64)
    most[at[b"rare"]], kth[at[b"rare"]] = 1000, 900
    most[at[b"common"]], kth[at[b"common"]] = 50, 40
    least, (who, bounds) = ranked_search.prune(items, most, kth)
    assert least.tolist() == [900, 40]
    assert who[bounds[at[b"rare"]] : bounds[at[b"rare"] + 1]].tolist() == [0]
    assert who[bounds[at[b"common"]] : bounds[at[b"common"] + 1]].tolist() == [1]
