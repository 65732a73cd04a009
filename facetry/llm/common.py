"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import BROADCAST_ROWS, bounded, checkpoint, shared_dir

__all__ = ["BROADCAST_ROWS", "bounded", "checkpoint", "first_per_id", "release", "shared_dir", "small_batches", "stash", "stashed", "table"]

#: Bytes of an Arrow batch that a Python worker gets at once; one longer text still comes whole.
BATCH_BYTES = 8 << 20

_written: list[str] = []


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: cuts lineage and compresses."""
    path = f"{shared_dir(df.sparkSession)}/facetry/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int, keep: int = 1) -> None:
    """Delete the tables stashed after the first ``since``, but for the last ``keep``: for callers whose result no longer reads them."""
    for path in _written[since : len(_written) - keep]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    del _written[since : len(_written) - keep]


def stashed() -> int:
    """How many stashed tables there are."""
    return len(_written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound what a Python worker holds: Arrow batches of so many rows and BATCH_BYTES. The session keeps the setting, since results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def first_per_id(docs: DataFrame) -> DataFrame:
    """One row per doc_id, the one whose columns hash least, whatever the partitions. Only rows whose doc_id recurs are shuffled."""
    again = bounded(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")
    more = docs.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(one).select("_row.*")
    return docs.join(again, "doc_id", "left_anti").unionByName(more).select(*docs.columns)
