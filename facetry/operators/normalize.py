"""Repairs of drifted entities and resolution of conflicting modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Modalities from most to least authoritative; scores from which a repair is due and a conflict is manual.
AUTHORITY = ["document", "semantic", "provenance", "graph", "vector", "tensor", "spatial", "temporal"]
REPAIR_FROM, MANUAL_FROM = 0.3, 0.8


def authority_weight(modality: Column) -> Column:
    return F.create_map(*(F.lit(x) for i, m in enumerate(AUTHORITY) for x in (m, len(AUTHORITY) - i)))[modality]


def regenerate_from(present: Column, drifted: Column, score: Column) -> Column:
    """The most authoritative modality that is present and isn't the drifted one; null if no repair is due."""
    first = F.get(F.filter(F.array(*map(F.lit, AUTHORITY)), lambda m: F.array_contains(present, m) & (m != drifted)), F.lit(0))
    return F.when(score > REPAIR_FROM, first)


def merge_weights(present: Column) -> Column:
    """Share of each present modality in a merge, by authority."""
    weights = F.transform(present, authority_weight)
    total = F.aggregate(weights, F.lit(0), lambda s, x: s + x)
    return F.transform(weights, lambda w: w / total)


def temporal_repairs(entities: DataFrame) -> DataFrame:
    """(entity_id, change): what a repair of (created, modified, version, version_count) would change, else verified."""
    c = F.col
    changes = F.filter(
        F.array(
            F.when(c("created") > c("modified"), "created_after_modified"),
            F.when(c("version") == 0, "version_zero"),
            F.when(c("version_count") < c("version"), "missing_versions"),
        ),
        lambda x: x.isNotNull(),
    )
    return entities.select("entity_id", F.explode(F.when(F.size(changes) > 0, changes).otherwise(F.array(F.lit("verified")))).alias("change"))


def graph_document_change(has_graph: Column, has_document: Column) -> Column:
    return F.when(has_graph & has_document, "reconcile").when(has_document, "extract_graph").when(has_graph, "describe_graph").otherwise("nothing")


def resolve(strategy: str, modalities: Column, severity: Column, priority: list[str] | None = None) -> Column:
    """The modality that wins a conflict; 'manual' from MANUAL_FROM. lww: the last listed; priority: the best ranked,
    else the first listed; merge: none."""
    if strategy == "lww":
        win = F.element_at(modalities, -1)
    elif strategy == "priority":
        ranked = F.filter(F.array(*map(F.lit, priority or AUTHORITY)), lambda m: F.array_contains(modalities, m))
        win = F.coalesce(F.get(ranked, F.lit(0)), F.element_at(modalities, 1))
    elif strategy == "merge":
        win = F.lit("merged")
    else:
        raise ValueError(strategy)
    return F.when(severity >= MANUAL_FROM, "manual").otherwise(win)


def summary(modality: str) -> Column:
    """One line on a modality's content, from the columns of the assembled entity; null where it is absent."""
    c = F.col
    text = {
        "document": lambda: F.format_string("document(title='%s', body_len=%d)", c("document.title"), F.octet_length("document.body")),
        "vector": lambda: F.format_string("vector(dim=%d)", F.size("vector.embedding")),
        "tensor": lambda: F.format_string("tensor(shape=[%s], len=%d)", F.array_join(c("tensor.shape").cast("array<string>"), ", "), F.size("tensor.data")),
        "temporal": lambda: F.format_string("temporal(versions=%d)", c("version_count")),
    }[modality]()
    return F.when(c("version_count") > 0 if modality == "temporal" else c(modality).isNotNull(), text)


def _changes(entities: DataFrame, modality: str, *steps: tuple[Column, str, str]) -> DataFrame:
    """(entity_id, modality, field, change): a row per step whose source is there."""
    rows = F.array_compact(F.array(*(F.when(there, F.struct(F.lit(field).alias("field"), F.lit(change).alias("change"))) for there, field, change in steps)))
    return entities.select("entity_id", F.lit(modality).alias("modality"), F.explode(rows).alias("s")).select("entity_id", "modality", "s.field", "s.change")


def vector_repairs(entities: DataFrame) -> DataFrame:
    """How a drifted vector is regenerated; no row where there is neither document nor semantic source."""
    return _changes(entities, "vector", (F.col("document").isNotNull(), "embedding", "regenerate from document"), (F.col("semantic").isNotNull(), "embedding_context", "incorporate semantic types"))


def tensor_repairs(entities: DataFrame) -> DataFrame:
    """How a drifted tensor is regenerated; no row where there is neither vector nor document."""
    return _changes(entities, "tensor", (F.col("vector").isNotNull(), "data", "reshape embedding"), (F.col("document").isNotNull(), "features", "weight terms of document"))


def dispatch(score: Column, least: float, rules: list[tuple[Column, str]]) -> Column:
    """The first rule's strategy that applies; scores under ``least`` are skipped."""
    out = F.when(score < least, "skip")
    for applies, strategy in rules:
        out = out.when(applies, strategy)
    return out


def with_policy(conflicts: DataFrame, policies: DataFrame, default: str) -> DataFrame:
    """Adds the policy of a conflict's pair of modalities, in either order; else the default. policies: one row per pair."""
    own = policies.select(F.array_sort("pair").alias("_pair"), "policy")
    joined = conflicts.withColumn("_pair", F.array_sort("pair")).join(F.broadcast(own), "_pair", "left")  # at most one row per pair of modalities
    return joined.drop("_pair").withColumn("policy", F.coalesce("policy", F.lit(default)))
