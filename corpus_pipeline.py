"""A corpus pipeline: reject poor documents, near and partial copies and test items, then encode."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from postsieve.llm import decontaminate, fm_dedup, near_text, prefix_bpe, quality_gam
from postsieve.llm.queries import ACCEPT
from postsieve.llm.shared import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is ACCEPT or more, row by row: repeats and rows without doc_id are judged by their own text; null and empty texts have a score too."""
    model = quality_gam.fit(docs, table(spark, sf_dir, "labels"))
    return quality_gam.accepted(docs, model, ACCEPT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id (none counts as largest).

    Rows have numbers of their own, so texts that share a doc_id, or have none, are documents like others; of rows
    that are equal in all one stays; null and empty texts, and texts without words, are in no group and stay.
    """
    rows = Scratch(spark, "numbered").cut(docs.withColumn(ROW, F.monotonically_increasing_id()))
    groups = near_text.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text")).select(F.col("doc_id").alias(ROW), "component_id")
    first = groups.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))[ROW].alias(ROW))
    return rows.join(first.select(ROW), ROW, "left_semi").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that documents with smaller doc_ids have; n_chars follows the text.

    Texts without such windows stay as they are, null ones too; each row loses what its own text repeats.
    """
    return fm_dedup.remove(docs, with_text=True).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, row by row: a row goes for its own text alone."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left, a row for each; null texts count as empty."""
    return prefix_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: The name of a column that numbers rows, unlike those of documents.
ROW = "_pipeline_row"
STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("encoding", encoding)]
#: Trained models and tokenization are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.cut(docs)
    return docs
