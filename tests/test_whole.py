"""Queries whose rows once differed from their SQL, or whose work grew past its bounds, on small inputs that showed it."""

from pyspark.sql import functions as F

from postsieve.operators import blocks as B, models as M, tfidf as I
from postsieve.plans import catalog
from postsieve.sources import mail

from test_oracle import SF, con, rows  # noqa: F401


def same(spark, con, name):
    """Whether a query has the rows of its SQL."""
    df, got = catalog.queries()[name](spark, SF), con.execute(catalog.oracle_sql()[name])
    return rows(df.columns, map(tuple, df.collect())) == rows([d[0] for d in got.description], got.fetchall())


def test_cut_references():
    page = "<h1>this &amp that &amp</h1><p>&amp;amp; &lt;b&gt; &#65; &#x42; &copy x</p>"
    assert mail.html_text(page)[0] == "this & that &\n&amp; <b> A B © x".replace("this", "\nthis")
    assert mail.html_text(page, closed=True)[0] == "\nthis &amp that &amp\n&amp; <b> A B &copy x"


def test_fold_terms_past_the_bounds(spark, con, monkeypatch):
    monkeypatch.setattr(B, "BLOCKS", {b: (w, 3) for b, (w, _) in B.BLOCKS.items()})
    assert same(spark, con, "fold_terms")


def test_complement_bayes_past_the_bound(spark, con, monkeypatch):
    monkeypatch.setattr(M, "VOCABULARY", 20)
    assert same(spark, con, "model_cnb")


def test_scaling_counts_no_tokens(spark, con, monkeypatch):
    monkeypatch.setattr(B, "learn_without", None)
    assert same(spark, con, "signal_scaling")


def test_term_counts_deal_texts_not_terms(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b")], "doc_id long, text string")
    counts = I.term_counts(docs, "doc_id", F.split("text", " "))
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 2), (1, "b", 1), (2, "b", 1)]
    dealt = [x for x in counts._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert dealt and not any("term" in x for x in dealt)
