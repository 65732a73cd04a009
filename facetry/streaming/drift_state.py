"""Drift streams: running averages, trends and alerts, on streams and as their batch equals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALPHA = 0.1
#: Scores of a kind that the trend looks at, half of them recent.
RECENT = 10


def ewma(scores: DataFrame, key: str, alpha: float = ALPHA, first_seeds: bool = False, chunk: str = "1 hour") -> DataFrame:
    """(key, average, highest, n): the exponentially weighted average of scores (key, ts, seq, score) in order of ts and seq.

    It starts from 0, or is seeded by the first score. The average composes: a chunk's scores act as one weight on what
    came before and one sum added to it. So only a ``chunk`` of time is gathered, per key, and then one row per chunk.
    """
    keep = 1 - alpha
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ts", "seq", "score"))), lambda s: s["score"])
    at = F.window("ts", chunk)["start"].alias("chunk")
    parts = scores.groupBy(key, at).agg(ordered.alias("xs"), F.max("score").alias("highest"), F.count("*").alias("n"))
    part = F.aggregate("xs", F.lit(0.0), lambda s, x: s * keep + x * alpha)
    parts = parts.select(key, "chunk", F.pow(F.lit(keep), F.col("n")).alias("weight"), part.alias("added"), F.element_at("xs", 1).alias("first"), "highest", "n")
    whole = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "weight", "added"))).alias("ps"), F.min_by("first", "chunk").alias("first"), F.max("highest").alias("highest"), F.sum("n").alias("n"))
    start = F.col("first") if first_seeds else F.lit(0.0)
    average = F.aggregate("ps", start.cast("double"), lambda s, p: s * p["weight"] + p["added"])
    return whole.select(key, average.alias("average"), "highest", "n")


def batch_metrics(scores: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind, average, highest, n) over all scores (kind, ts, seq, score), averaged as a stream would."""
    return ewma(scores, kind)


def trend(scores: DataFrame, kind: str = "kind") -> DataFrame:
    """(kind, trend): mean of the last RECENT scores less the mean of as many before; 0 without older ones."""
    w = W.partitionBy(kind).orderBy(F.desc("ts"), F.desc("seq"))
    r = scores.withColumn("r", F.row_number().over(w)).where(F.col("r") <= 2 * RECENT)
    mean = lambda c: F.avg(F.when(c, F.col("score")))
    return r.groupBy(kind).agg(F.coalesce(mean(F.col("r") <= RECENT) - mean(F.col("r") > RECENT), F.lit(0.0)).alias("trend"))


def alerts(scores: DataFrame, limit: Column) -> DataFrame:
    """Scores strictly over their limit, with a text; works on streams.

    Numbers are rounded by their binary value, ties to even, as C's printf does; ``%.3f`` of format_string takes ties up.
    """
    three = lambda c: F.expr(f"format_number(`{c}`, '0.000')")
    over = scores.withColumn("limit", limit).where(F.col("score") > F.col("limit"))
    return over.withColumn("message", F.format_string("%s drift %s exceeds %s", "kind", three("score"), three("limit")))


def stream_metrics(scores: DataFrame) -> DataFrame:
    """Running (kind, average, highest, n) of a stream of (kind, ts, seq, score); state is three numbers per kind.

    Within a micro-batch scores are taken in order of ts and seq. Run in update mode.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        average, highest, n = state.get if state.exists else (0.0, float("-inf"), 0)
        for x in pd.concat(list(batches)).sort_values(["ts", "seq"])["score"]:
            average, highest, n = average * (1 - ALPHA) + x * ALPHA, max(highest, x), n + 1
        state.update((average, highest, n))
        yield pd.DataFrame({"kind": [key[0]], "average": [average], "highest": [highest], "n": [n]})

    return scores.groupBy("kind").applyInPandasWithState(fold, "kind string, average double, highest double, n long", "average double, highest double, n long", "update", "NoTimeout")


def breaker_states(calls: DataFrame, failures: int = 5) -> DataFrame:
    """(store_id, opened): how often so many failures in a row open a store's circuit; calls: (store_id, seq, ok).

    Runs of failures are numbered by the successes before them; a run opens the circuit once per full ``failures``.
    """
    w = W.partitionBy("store_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    runs = calls.withColumn("run", F.sum(F.col("ok").cast("int")).over(w)).where("not ok").groupBy("store_id", "run").agg(F.count("*").alias("n"))
    opened = runs.groupBy("store_id").agg(F.sum(F.floor(F.col("n") / failures)).alias("opened"))
    return calls.select("store_id").distinct().join(opened, "store_id", "left").select("store_id", F.coalesce("opened", F.lit(0)).cast("long").alias("opened"))
