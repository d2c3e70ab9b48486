"""Words in place of tokens: pairs and letters are made where they are counted, and come to the same."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from postsieve.functions import features as X
from postsieve.operators import blocks as B
from postsieve.plans import views as W

SF = "/root/testdata/sf0.001"


def want(words, block):
    if block == "char":
        return Counter(w[i : i + n] for w in (f" {w} " for w in words) for n in (3, 4, 5) for i in range(len(w) - n + 1))
    return Counter([*words, *map(" ".join, zip(words, words[1:]))])


def test_tokens_of_words():
    rnd = random.Random(3)
    rows = [["".join(rnd.choices("abcdé世😀_1ßИ", k=rnd.randrange(1, 9))) for _ in range(rnd.randrange(30))] for _ in range(40)]
    rows[3] = rows[39] = []
    column = pa.array([None if i == 7 else " ".join(r) for i, r in enumerate(rows)], pa.string())
    rows[7] = []
    for some in (slice(0, 40), slice(5, 25), slice(0, 0), slice(3, 4), slice(7, 8)):
        part = column.slice(some.start, some.stop - some.start)
        for block in ("body", "char"):
            row, code, known = B.coded(part, block)
            got = [Counter() for _ in rows[some]]
            for r, x in zip(row, code):
                got[r][known[x].as_py()] += 1
            assert got == [want(r, block) for r in rows[some]]
            assert all(n >= sum(g.values()) for n, g in zip(B._tokens(part, block), got, strict=True))


def test_texts_learn_and_encode_as_tokens_do(spark, monkeypatch):
    monkeypatch.setattr(B, "TOKENS", 20_000)
    mail = W.mail_enriched(spark, SF).where("label is not null")
    tokens, texts = B.frame(mail, "doc_id").persist(), B.texts(mail, "doc_id").persist()
    v, same = B.learn(tokens), B.learn(texts)
    assert v.terms == same.terms and all(np.array_equal(v.idf[b], same.idf[b]) for b in v.terms) and v.n_terms > 1000
    by_id = lambda rows: {r.doc_id: (r.at, np.round(r.value, 12).tolist()) for r in B.vectors(rows, v, "doc_id").collect()}
    assert by_id(texts) == by_id(tokens)
    w = np.random.default_rng(1).normal(size=(2, v.size))
    made = [{r.doc_id: np.round(r.m, 9).tolist() for r in x.select("doc_id", B.margins(x, v, w, np.ones(2)).alias("m")).collect()} for x in (tokens, texts)]
    assert made[0] == made[1]
    tokens.unpersist(), texts.unpersist()


def test_share_of_capitals(spark):
    texts = ["", "123 .", "aB É世 Dž", "ABC" * 9000, "x" * 20_000 + "Y", "😀 ÀÇ ß"]
    m = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").withColumns({"urls": F.array().cast("array<string>"), "attachment_types": F.array().cast("array<string>"), "html_share": F.lit(0.0), "n_attachments": F.lit(0), "from_addr": F.lit(""), "reply_to": F.lit("")})
    got = {r.i: r.caps_ratio for r in m.select("i", *X.structural(m)).collect()}
    import unicodedata

    for i, t in enumerate(texts):
        kinds = [unicodedata.category(c) for c in t[:20_000]]
        letters = sum(k[0] == "L" for k in kinds)
        assert got[i] == (sum(k == "Lu" for k in kinds) / letters if letters else 0.0)


def test_across_sources_texts_are_scored_once(spark, monkeypatch):
    from postsieve.operators import evaluate as V, training as R

    mail = W.mail_enriched(spark, SF).where("label is not null").withColumn("y", F.when(F.col("label") == "spam", 1.0).otherwise(0.0))
    mail = mail.withColumn("source", F.when(F.col("seq") % 2 == 0, "a").otherwise("b"))
    plans, ranked = [], V.roc_auc
    monkeypatch.setattr(V, "roc_auc", lambda held: plans.append(held._jdf.queryExecution().toString()) or ranked(held))
    found = [R.cross(made(mail, "seq", "source", "y"), ("a", "b"), R.Candidate("cnb")) for made in (B.texts, B.frame)]
    # ranking reads what was scored, not the texts
    assert len(plans) == 4 and not any("EvalPython" in p for p in plans)
    assert found[0] == found[1] and set(found[0]) == {"a->b", "b->a"}
