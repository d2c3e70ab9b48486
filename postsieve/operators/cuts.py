"""Tables written on the way, so that plans stay short and lost executors cost a reread."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where none is named a temporary one, if Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return "file://" + tempfile.mkdtemp(prefix="postsieve-")


class Cuts:
    """with Cuts(spark) as cuts: cuts.cut(rows) is rows read back from a table, which lasts as long as the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_root(spark)}/cuts-{uuid.uuid4().hex}"
        self.made = 0
        self.kept: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Cuts:
        return self

    def __exit__(self, *_) -> None:
        self._delete(self.root)

    def _delete(self, root: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, *tables: DataFrame) -> None:
        """Tables of `cut` that nothing reads any more."""
        for t in tables:
            self._delete(self.kept.pop(id(t))[1])

    def cut(self, rows: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        rows.write.parquet(path)
        out = self.spark.read.schema(rows.schema).parquet(path)
        self.kept[id(out)] = out, path
        return out
