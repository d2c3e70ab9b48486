"""Mail-like views over the driver's tables; the SQL twins are in catalog.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T

FOLDERS = ["Inbox", "Junk", "Trash", "Sent Items", "Lists/Spam", "Work.sbd", "Bulk  Mail.mbox", "Drafts"]
DOMAINS = ["alpha.example", "beta.example", "gamma.example"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mail_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, folder, source, label: toxic documents are spam, unlabelled ones NULL."""
    docs = table(spark, sf_dir, "documents")
    known = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    folder = F.element_at(F.array(*map(F.lit, FOLDERS)), (F.col("doc_id") % len(FOLDERS) + 1).cast("int"))
    label = F.when(F.col("toxic") == 1, "spam").when(F.col("toxic") == 0, "ham")
    return docs.join(known, "doc_id", "left").select("doc_id", "text", folder.alias("folder"), "source", label.alias("label"))


def hashed(rows: DataFrame) -> DataFrame:
    """Adds raw_sha256 and norm_body_hash of header-less text (empty subject)."""
    raw = F.sha2(F.concat(F.lit("\n"), F.col("text")), 256)
    return rows.withColumn("raw_sha256", raw).withColumn("norm_body_hash", T.norm_hash(F.lit(""), F.col("text"), raw))


def mail_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents, near copies of some, and near copies of some with the other label."""
    base = mail_base(spark, sf_dir).where("label is not null").withColumn("v", F.lit(0))
    near = base.where("doc_id % 10 = 0").withColumn("v", F.lit(1)).withColumn("text", F.concat("text", F.lit(" ")))
    other = base.where("doc_id % 25 = 0").withColumn("v", F.lit(2)).withColumn("text", F.concat("text", F.lit("  ")))
    other = other.withColumn("label", F.when(F.col("label") == "spam", "ham").otherwise("spam"))
    rows = base.unionByName(near).unionByName(other)
    return hashed(rows.withColumn("seq", F.col("v").cast("long") * 10**12 + F.col("doc_id")))


def mail_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a page's URL, an address and a number in the text, headers and attachments."""
    docs, pages = mail_base(spark, sf_dir), table(spark, sf_dir, "pages")
    n = pages.agg(F.count("*").alias("pages"))
    # the count is one row
    rows = docs.join(F.broadcast(n)).withColumn("page_id", F.col("doc_id") % F.col("pages")).join(pages.select("page_id", "url"), "page_id")
    pick = lambda k: F.element_at(F.array(*map(F.lit, DOMAINS)), ((F.col("doc_id") / k).cast("long") % len(DOMAINS) + 1).cast("int"))
    id_ = F.col("doc_id").cast("string")
    rows = rows.withColumn("text", F.concat("text", F.lit("\nSee "), "url", F.lit(" or http://10.0.0."), (F.col("doc_id") % 200).cast("string"), F.lit("/a or bit.ly, mail box"), id_, F.lit("@alpha.example $"), id_, F.lit(" now!")))
    rows = rows.withColumn("from_addr", F.concat(F.lit("u"), id_, F.lit("@"), pick(1))).withColumn("reply_to", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("r@"), pick(3))).otherwise(""))
    rows = rows.withColumn("attachment_types", F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("exe"))).when(F.col("doc_id") % 5 == 0, F.array(F.lit("pdf"))).otherwise(F.array().cast("array<string>")))
    headers = F.map_from_arrays(F.array(F.lit("x-mailer"), F.lit("content-type")), F.array(F.when(F.col("doc_id") % 3 == 0, "Mailer-X 2.1").otherwise(""), F.when(F.col("doc_id") % 2 == 0, "Text/HTML; charset=utf-8").otherwise("")))
    rows = rows.withColumn("headers", headers).withColumn("subject", F.concat(F.lit("Re: "), id_)).withColumn("html_share", F.lit(0.0)).withColumn("n_attachments", F.size("attachment_types"))
    return rows.withColumn("urls", T.urls(F.col("text"))).withColumn("seq", F.col("doc_id"))


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.col("event_type") == "error").cast("int").alias("y"), F.col("value").alias("score"), (F.col("user_id") % 5).alias("source"), (F.col("user_id") % 2 == 0).alias("mask"))


def dated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts: one row in 50 has no date."""
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 != 7, F.col("ts")).alias("ts"))
