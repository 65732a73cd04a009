"""The folder that all executors share, and what is stored there between steps."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers up to which a side is broadcast (some 20 MB); a larger side is shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder in local mode, else an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if not given and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return given or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marked for broadcast if it has at most so many rows, which is counted first; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
