"""Small cases with known results."""

import math

import pytest
from pyspark.sql import Row, functions as F

from postsieve.functions import features as X, text as T
from postsieve.operators import dedupe as D, evaluate as V, labels as L, tfidf as I


def test_dedupe_counts(spark):
    rows = [(i, f"raw{i}", f"n{i}", "ham") for i in range(4)] + [(4, "raw0", "n0", "ham"), (5, "c1", "nc", "spam"), (6, "c2", "nc", "ham"), (7, "near", "n1", "ham")]
    m = spark.createDataFrame(rows, "seq long, raw_sha256 string, norm_body_hash string, label string")
    assert D.report(m).first() == Row(exact=1, near=2, conflict_groups=1, conflict_emails=2, kept=5)
    assert sorted(r.seq for r in D.dedupe(m).collect()) == [0, 1, 2, 3, 7]


def test_missing_label_is_a_label(spark):
    m = spark.createDataFrame([(1, "a", "n", None), (2, "b", "n", "ham")], "seq long, raw_sha256 string, norm_body_hash string, label string")
    assert D.report(m).first().conflict_emails == 2


def test_split_time_sizes(spark):
    df = spark.range(300).select("id", F.timestamp_seconds(F.lit(1.7e9) + F.col("id") * 3600).alias("ts"))
    got = {r.part: r["count"] for r in D.split_time(df, "ts", ["id"]).groupBy("part").count().collect()}
    assert got == {"train": 204, "val": 36, "test": 60}


def test_threshold_admits_five(spark):
    rows = [(0, i / 999) for i in range(1000)] + [(1, 2.0)] * 10
    df = spark.createDataFrame(rows, "y int, score double")
    cut = V.threshold_for_fpr(df, 0.005)
    assert df.where((F.col("y") == 0) & (F.col("score") >= cut)).count() == 5
    assert cut == math.nextafter(994 / 999, math.inf)
    with pytest.raises(V.NoHam):
        V.threshold_for_fpr(df.where("y = 1"), 0.1)


def test_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.2), (0, 0.8), (0, 0.1)], "y int, score double")
    r = V.metrics_at(df, 0.5).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 1)
    r = V.metrics_at(df.where("y = 0"), 0.95).first()
    assert r.precision is None and r.recall is None and r.f1 is None


def test_auc_brute_force(spark):
    import random

    random.seed(2)
    data = [(int(random.random() < 0.3), round(random.random(), 1)) for _ in range(200)]
    r = V.roc_auc(spark.createDataFrame(data, "y int, score double")).first()
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    assert r.roc_auc == pytest.approx(sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg))


def test_masks(spark):
    df = spark.createDataFrame([("See HTTP://www.Shop-1.example/x?q=1 or mail a.b+c@x-y.org at 1,234.5 now ٣",)], "t string")
    got = df.select(T.masked(F.col("t")).alias("m"), T.normalized(F.lit(""), F.col("t")).alias("n")).first()
    assert got.m.split() == "see __url__ urldom_shop_1_example or mail __email__ at __num__ now __num__".split()
    assert got.n == "see u or mail e at 0,0.0 now 0"


@pytest.mark.parametrize(("folder", "rules", "own", "want"), [
    ("Junk", "mbox", None, "spam"), ("a/Sent Items", "mbox", None, "skip"), ("Work.sbd", "mbox", None, "ham"), ("x", "eml", None, "skip"),
    ("Sent", "mbox", L.Overrides(include_sent=True), "ham"), ("Junk", "mbox", L.Overrides(ham=["junk"]), "ham"), ("Junk", "mbox", L.Overrides(label="ham"), "ham"),
])
def test_rules(spark, folder, rules, own, want):
    assert spark.createDataFrame([(folder,)], "f string").select(L.resolve(F.col("f"), rules, own)).first()[0] == want


def test_char_grams(spark):
    df = spark.createDataFrame([("a Bcd",)], "t string")
    assert sorted(df.select(F.explode(I.char_grams(F.col("t")))).toPandas()["col"]) == sorted([" a ", " bc", "bcd", "cd ", " bcd", "bcd ", " bcd "])


def test_structural_features_see_the_body_alone(spark):
    m = spark.createDataFrame([("WOW!!! $$$", "Ab!$", 0.25, 1, ["EXE"], ["http://10.0.0.1/x", "bit.ly"], "a@x.example", "")], "subject string, text string, html_share double, n_attachments int, attachment_types array<string>, urls array<string>, from_addr string, reply_to string")
    got = m.select(*X.structural(m)).first().asDict()
    assert got == {"url_count": 2, "url_domains": 2, "html_share": 0.25, "n_attachments": 1, "risky_attachment": 1, "reply_to_mismatch": 0, "caps_ratio": 0.5, "exclaim_per_1k": 250, "dollar_per_1k": 250, "log_length": math.log1p(4), "ip_url": 1, "shortener_url": 1, "has_headers": 1}
