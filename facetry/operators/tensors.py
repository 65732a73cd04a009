"""Row-major tensors (shape, data)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDUCTIONS = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "prod": F.product}


def numel(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda s, x: s * x)


def is_consistent(shape: Column, data: Column) -> Column:
    return numel(shape) == F.size(data)


def filled(shape: Column, value: float) -> Column:
    """The data of a tensor of one value: zeros and ones."""
    return F.array_repeat(F.lit(value), numel(shape).cast("int"))


def mapped(tensors: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return tensors.withColumn("data", F.transform("data", f))


def reduce_axis(tensors: DataFrame, axis: int, how: str) -> DataFrame:
    """(entity_id, at, value): the reduced tensor by flat position; axis counts from 0.

    Elements are grouped by (entity, position left over), so a large tensor is spread and partly aggregated first.
    """
    if how not in REDUCTIONS:
        raise ValueError(how)
    inner = F.aggregate(F.slice("shape", axis + 2, F.greatest(F.size("shape") - (axis + 1), F.lit(0))), F.lit(1).cast("long"), lambda s, x: s * x)
    cells = tensors.where(F.size("shape") > axis).select("entity_id", inner.alias("inner"), F.get("shape", F.lit(axis)).alias("n"), F.posexplode("data").alias("i", "x"))
    at = F.floor(F.col("i") / (F.col("inner") * F.col("n"))) * F.col("inner") + F.col("i") % F.col("inner")
    return cells.groupBy("entity_id", at.cast("long").alias("at")).agg(REDUCTIONS[how]("x").alias("value"))


def statistics(data: Column) -> Column:
    """mean, population deviation, min and max over finite elements (0 without any), with flags for NaN and infinity."""
    finite = F.filter(data, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    n = F.size(finite)
    total = lambda f: F.aggregate(finite, F.lit(0.0), lambda s, x: s + f(x))
    mean = total(lambda x: x) / n
    std = F.sqrt(F.greatest(F.aggregate(finite, F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")), lambda s, x: F.struct((s["a"] + x).alias("a"), (s["b"] + x * x).alias("b")), lambda s: s["b"] / n - (s["a"] / n) * (s["a"] / n)), F.lit(0.0)))
    or0 = lambda c: F.when(n > 0, c).otherwise(F.lit(0.0))
    return F.struct(
        or0(mean).alias("mean"), or0(std).alias("std"), or0(F.array_min(finite)).alias("min"), or0(F.array_max(finite)).alias("max"),
        F.exists(data, lambda x: F.isnan(x)).alias("has_nan"), F.exists(data, lambda x: F.abs(x) == F.lit(float("inf"))).alias("has_inf"),
    )
