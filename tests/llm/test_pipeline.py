"""The pipeline against plain loops, stage by stage, and its queries that have no SQL."""

import base64
import hashlib
import math
import re

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from postsieve.llm import quality_gam, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(256)).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def shingles(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts, percent):
    """doc_id -> smallest doc_id reachable."""
    sets, root = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def without_repeats(texts):
    """doc_id -> kept words joined by a blank, where any went; else the text."""
    first, out = {}, {}
    words = {d: WORD.findall((t or "").encode()) for d, t in texts.items()}
    window = lambda w, i: b" ".join(w[i : i + 50])
    for d in sorted(words):
        for i in range(len(words[d]) - 49):
            first.setdefault(window(words[d], i), d)
    for d, w in words.items():
        gone = {k for i in range(len(w) - 49) if first[window(w, i)] < d for k in range(i, i + 50)}
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def held(items, texts, least=0.8):
    own = [s for s in map(shingles, items) if s]
    return {d for d, t in texts.items() for s in own if len(s & shingles(t)) >= math.ceil(round(least * len(s), 9))}


@pytest.fixture(scope="module")
def tokenizer():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(tokenizer, text):
    ids = tokenizer.encode_ordinary(text or "")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())


def test_pipeline_by_loops(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    model = quality_gam.fit(docs, labels)
    texts = {}
    for r in docs.collect():
        x = quality_gam.features(__import__("pyarrow").array([r.text], "string"))[0]
        z = model.base + sum(t[sum(c <= v for c in cut)] for v, cut, t in zip(x, model.cuts, model.single, strict=True))
        at = [sum(c <= v for c in cut) for v, cut in zip(x, model.cuts, strict=True)]
        z += sum(t[model.coarse[f][at[f]], model.coarse[g][at[g]]] for (f, g), t in zip(model.pairs, model.pair, strict=True))
        if 1 / (1 + math.exp(-z)) >= 0.3:
            texts[r.doc_id] = r.text
    got = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, SF).collect()}
    assert got == texts

    texts = {d: texts[d] for d, c in groups(texts, 80).items() if c == d}
    docs = docs.where(F.col("doc_id").isin([*got]))
    docs = corpus_pipeline.near_dedup(spark, docs, SF).cache()
    assert {r.doc_id: r.text for r in docs.collect()} == texts

    kept = without_repeats(texts)
    docs = corpus_pipeline.substring_dedup(spark, docs, SF).cache()
    out = {r.doc_id: r.text for r in docs.collect()}
    assert {d: WORD.findall((t or "").encode()) for d, t in out.items()} == kept

    gone = held(items, out)
    docs = corpus_pipeline.decontamination(spark, docs, SF).cache()
    assert {r.doc_id for r in docs.collect()} == out.keys() - gone

    want = {d: digests(tokenizer, t) for d, t in out.items() if d not in gone}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.encoding(spark, docs, SF).collect()} == want
    whole = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert whole == want


def test_bpe_query(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op8_prefix_bpe(spark, SF).collect()}
    assert got == {d: digests(tokenizer, t) for d, t in texts.items()}


def test_stages_of_odd_rows(spark, tokenizer):
    """Repeated and missing doc_ids, equal rows, nulls and blanks, clashing names: each stage keeps what is no copy, no item and no repeat."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("text is not null").first().text
    base, other = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(90))
    dirty, clean = f"{other[:40]} x1 {item} x2", " ".join(f"c{i}" for i in range(60))
    rows = [(1, base), (5, base + " more"), (5, other), (5, other), (None, base), (None, dirty), (7, dirty + " end"), (7, clean), (8, None), (9, ""), (9, " \n"), (None, None), (3, other + " z"), (12, "one two"), (11, "one two"), (None, "one two")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), 1, "k") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, item_id long, component_id string").repartition(3)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    got = corpus_pipeline.near_dedup(spark, docs, SF)
    assert got.columns == docs.columns
    want = [(1, base), (3, other + " z"), (7, dirty + " end"), (7, clean), (8, None), (9, ""), (9, " \n"), (None, None), (11, "one two")]
    assert pairs(got) == sorted(want, key=str)

    got = corpus_pipeline.decontamination(spark, docs, SF)
    assert got.columns == docs.columns
    assert pairs(got) == sorted([r for r in rows if r[1] not in (dirty, dirty + " end")], key=str)

    got = corpus_pipeline.substring_dedup(spark, docs, SF)
    first = {}
    for d, t in rows:
        w = (t or "").split()
        for i in range(len(w) - 49 if d is not None else 0):
            k = tuple(w[i : i + 50])
            first[k] = min(first.get(k, d), d)
    want = []
    for d, t in rows:
        w = (t or "").split()
        gone = {j for i in range(len(w) - 49) if d is not None and first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        want.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    assert pairs(got) == sorted(want, key=str)
    assert all(r.n_chars == len(r.text) for r in got.collect() if r.text is not None)

    got = corpus_pipeline.encoding(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted([(d, *digests(tokenizer, t)) for d, t in rows], key=str)

    got = corpus_pipeline.quality(spark, docs, SF)
    # rows of one text have one score
    model = quality_gam.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = sorted({t for _, t in rows}, key=str)
    score = {r.doc_id: r.score for r in quality_gam.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    good = {t for i, t in enumerate(texts) if score[i] >= queries.ACCEPT}
    assert got.columns == docs.columns and pairs(got) == sorted([r for r in rows if r[1] in good], key=str)
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, docs.where("false"), SF).count() == 0
