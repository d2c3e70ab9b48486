"""Scoring and exact dedupe of message streams.

Scoring has no state and goes micro-batch by micro-batch.  Exact copies
within a time span go by raw hash; label conflicts need all rows and stay a batch job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import blocks as B
from ..operators.training import Bundle
from ..sources import mail


def verdicts(messages: DataFrame, bundle: Bundle) -> DataFrame:
    """seq, source, folder, id, subject, score, verdict of the rows of (source, folder, seq, raw) that parse."""
    rows = mail.parse(messages).where("error is null").withColumn("label", F.lit(None).cast("string"))
    return bundle.verdicts(B.frame(rows, "seq", "source", "folder", "id", "subject")).select("seq", "source", "folder", "id", "subject", "score", "verdict")


def score_stream(messages: DataFrame, bundle: Bundle, sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer that hands the verdicts of each micro-batch and its number to sink.

    A batch may come again after a failure: sink writes by batch number or by id.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(verdicts(batch, bundle), number)

    return messages.writeStream.foreachBatch(each)


def first_copies(messages: DataFrame, arrived: str, span: str = "1 day") -> DataFrame:
    """One row of each raw message among those that arrive within span of each other."""
    hashed = messages.withColumn("raw_sha256", F.sha2("raw", 256))
    return hashed.withWatermark(arrived, span).dropDuplicatesWithinWatermark(["raw_sha256"])
