"""Types, constraints and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The built-in types with their parents.
BUILT_IN = [("Entity", None), ("Document", "Entity"), ("Node", "Entity"), ("TimeSeries", "Entity")]


def hierarchy(types: DataFrame, depth: int = 8) -> DataFrame:
    """(type, ancestor, depth) up to ``depth`` levels; what has been reached isn't walked again, so cycles end."""
    step = types.where("parent is not null").select("type", F.col("parent").alias("ancestor"))
    out = step.withColumn("depth", F.lit(1))
    front = out
    for k in range(2, depth + 1):
        up = front.join(step.select(F.col("type").alias("ancestor"), F.col("ancestor").alias("next")), "ancestor").select("type", F.col("next").alias("ancestor"))
        front = up.distinct().join(out, ["type", "ancestor"], "left_anti").withColumn("depth", F.lit(k))
        out = out.unionByName(front)
    return out


def violation(kind: Column, value: Column, argument: Column, low: Column, high: Column) -> Column:
    """Name of the broken rule or null. required: a value; pattern: a match (missing passes); range: within bounds (missing or not numeric passes)."""
    number = F.expr("try_cast(value as double)") if isinstance(value, str) else value.try_cast("double")
    bad_range = number.isNotNull() & (F.coalesce(number < low, F.lit(False)) | F.coalesce(number > high, F.lit(False)))
    return (
        F.when((kind == "required") & value.isNull(), "required")
        .when((kind == "pattern") & value.isNotNull() & ~F.regexp_like(value, argument), "pattern")
        .when((kind == "range") & bad_range, "range")
        .when(~kind.isin("required", "pattern", "range"), "unknown")
    )


def validate(facts: DataFrame, constraints: DataFrame) -> DataFrame:
    """(entity_id, property, broken) per violated constraint.

    facts: (entity_id, type, properties map); constraints: (type, property, kind, argument, low, high), a small table.
    """
    pairs = facts.join(constraints, "type").withColumn("value", F.try_element_at("properties", F.col("property")))
    broken = violation(F.col("kind"), F.col("value"), F.col("argument"), F.col("low"), F.col("high"))
    return pairs.select("entity_id", "property", broken.alias("broken")).where("broken is not null")


def accepted(facts: DataFrame, violations: DataFrame) -> DataFrame:
    """Facts without a violation."""
    return facts.join(violations, "entity_id", "left_anti")


def messages(violations: DataFrame) -> DataFrame:
    """(entity_id, message): violations joined by '; '."""
    one = F.concat_ws(":", "broken", "property")
    return violations.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_list(one)), "; ").alias("message"))
