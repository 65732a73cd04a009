"""Whole entities: assembly, listing, presence, and append-only changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import MODALITIES, Dataset


def assemble(data: Dataset) -> DataFrame:
    """One row per document entity with a nullable struct per modality and counts of versions and chain records.

    Left joins on entity_id; the optimizer prunes the modalities that a query doesn't select.
    """
    slot = lambda df, name, *cols: df.select("entity_id", F.struct(*cols).alias(name))
    counts = data.table("events").groupBy(F.col("user_id").alias("entity_id")).agg(F.count("*").alias("version_count"))
    return (
        slot(data.documents, "document", "title", "body", "lang", "source", "n_chars")
        .join(slot(data.vectors, "vector", "embedding", "label"), "entity_id", "left")
        .join(slot(data.tensors, "tensor", "shape", "data"), "entity_id", "left")
        .join(slot(data.semantic, "semantic", "quality", "toxic"), "entity_id", "left")
        .join(counts, "entity_id", "left")
        .withColumn("version_count", F.coalesce("version_count", F.lit(0)))
    )


def presence(slot: str | Column) -> Column:
    return F.col(slot).isNotNull() if isinstance(slot, str) else slot.isNotNull()


def select_slots(wide: DataFrame, slots: list[str]) -> DataFrame:
    """The id and the chosen slots; '*' is all of them."""
    have = [m for m in MODALITIES if m in wide.columns]
    chosen = have if "*" in slots else [m for m in dict.fromkeys(s.lower() for s in slots) if m in have]
    return wide.select("entity_id", *chosen)


def project(wide: DataFrame, *fields: str) -> DataFrame:
    """Columns named modality.field."""
    return wide.select("entity_id", *(F.col(f).alias(f) for f in fields))


def point(df: DataFrame, entity_id: int) -> DataFrame:
    return df.where(F.col("entity_id") == entity_id)


def page(df: DataFrame, limit: int = 100, offset: int = 0, order: tuple[Column | str, ...] = ("entity_id",)) -> DataFrame:
    """Ordered, then offset, then limit."""
    return df.orderBy(*order).offset(offset).limit(min(limit, 1000))


def compare(a: Column, op: str, b: Column) -> Column:
    """A comparison that is false where a side is missing."""
    by = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}
    return F.coalesce(by[op], F.lit(False))


def current(log: DataFrame, key: str = "entity_id", seq: str = "seq") -> DataFrame:
    """Latest row per key of an append-only log, without the keys whose latest row is a tombstone (op = 'delete')."""
    return log.withColumn("newest", F.row_number().over(W.partitionBy(key).orderBy(F.desc(seq)))).where("newest = 1 and op <> 'delete'").drop("newest")


def append_version(latest: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows to append for an update: the changed payload with the version after the latest."""
    return changes.join(latest.select("entity_id", F.col("version").alias("last")), "entity_id", "left").withColumn("version", F.coalesce("last", F.lit(0)) + 1).drop("last")
