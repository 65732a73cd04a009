"""Versions and time series. Every operator partitions by entity id, so one shuffle serves a whole chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def number_versions(rows: DataFrame, entity: str, ts: str, tie: str) -> DataFrame:
    """Adds version: 1, 2, ... per entity in order of time."""
    return rows.withColumn("version", F.row_number().over(W.partitionBy(entity).orderBy(ts, tie)).cast("long"))


def latest(versions: DataFrame, columns: list[str]) -> DataFrame:
    """The highest version per entity: an aggregate with map-side combination, no sort."""
    return versions.groupBy("entity_id").agg(F.max(F.struct("version", *columns)).alias("v")).select("entity_id", "v.*")


def at_version(versions: DataFrame, version: int) -> DataFrame:
    return versions.where(F.col("version") == version)


def as_of(versions: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """Per entity the last version at or before a time."""
    return latest(versions.where(F.col("ts") <= F.lit(ts).cast("timestamp_ntz")), columns)


def as_of_join(left: DataFrame, versions: DataFrame, columns: list[str]) -> DataFrame:
    """For each row of left (entity_id, ts) the last version at or before its time.

    Both sides are interleaved by one shuffle on entity and a running last value takes the place of a range join,
    so the cost is linear; rows without an earlier version get nulls.
    """
    v = versions.select("entity_id", "ts", F.lit(0).alias("side"), "version", F.struct("version", *columns).alias("v"), *(F.lit(None).cast(left.schema[c].dataType).alias(f"_{c}") for c in left.columns if c not in ("entity_id", "ts")))
    x = left.select("entity_id", "ts", F.lit(1).alias("side"), F.lit(None).cast("long").alias("version"), F.lit(None).cast(v.schema["v"].dataType).alias("v"), *(F.col(c).alias(f"_{c}") for c in left.columns if c not in ("entity_id", "ts")))
    w = W.partitionBy("entity_id").orderBy("ts", "side", "version").rowsBetween(W.unboundedPreceding, 0)
    both = v.unionByName(x).withColumn("v", F.last("v", ignorenulls=True).over(w)).where("side = 1")
    return both.select("entity_id", "ts", *(F.col(f"_{c}").alias(c) for c in left.columns if c not in ("entity_id", "ts")), "v.*")


def in_range(rows: DataFrame, start: str, end: str, ts: str = "ts") -> DataFrame:
    """start <= ts < end."""
    if start >= end:
        raise ValueError("a time range needs start < end")
    return rows.where((F.col(ts) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts) < F.lit(end).cast("timestamp_ntz")))


def history(versions: DataFrame, n: int) -> DataFrame:
    """The newest n versions per entity."""
    return versions.withColumn("newest", F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("version")))).where(F.col("newest") <= n)


def diff(a: DataFrame, b: DataFrame, payload: str) -> DataFrame:
    """(entity_id, before, after, change) of two version sets; change: NoChange, Changed, Added or Removed."""
    x = a.select("entity_id", F.col(payload).alias("before"), F.lit(True).alias("in_a"))
    y = b.select("entity_id", F.col(payload).alias("after"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "Added").when(F.col("in_b").isNull(), "Removed").when(F.col("before").eqNullSafe(F.col("after")), "NoChange").otherwise("Changed")
    return x.join(y, "entity_id", "full_outer").select("entity_id", "before", "after", change.alias("change"))


def consecutive_diff(versions: DataFrame, payload: str) -> DataFrame:
    """Each version with the payload before it."""
    w = W.partitionBy("entity_id").orderBy("version")
    return versions.withColumn("before", F.lag(payload).over(w))


def temporal_consistency(versions: DataFrame, content: str) -> DataFrame:
    """(entity_id, score): backward steps, repeated contents and one outsized gap, over n versions.

    (backward + repeats / 2 + gap / 2) / n; gap counts if there are three gaps and the largest is over ten times the
    upper median. 0 below two versions.
    """
    w = W.partitionBy("entity_id").orderBy("version")
    step = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    steps = versions.withColumn("step", step).withColumn("again", (F.row_number().over(W.partitionBy("entity_id", content).orderBy("version")) > 1).cast("int"))
    g = steps.groupBy("entity_id").agg(
        F.count("*").alias("n"), F.sum((F.col("step") < 0).cast("int")).alias("back"), F.sum("again").alias("repeats"), F.sort_array(F.collect_list(F.abs("step"))).alias("gaps")
    )
    median = F.element_at("gaps", (F.size("gaps") / 2).cast("int") + 1)
    gap = (F.size("gaps") >= 3) & (median > 0) & (F.element_at("gaps", -1) > 10 * median)
    score = (F.coalesce("back", F.lit(0)) + 0.5 * F.col("repeats") + F.when(gap, 0.5).otherwise(0.0)) / F.col("n")
    return g.select("entity_id", F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.least(score, F.lit(1.0))).alias("score"))
