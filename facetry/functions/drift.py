"""Drift scores, thresholds and labels; every score is in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Drift kinds in their declared order with threshold, monitor warning and critical limits, and the
# weights of the five-part and of the seven-part quality score.
THRESHOLDS = {"semantic_vector": 0.3, "graph_document": 0.4, "temporal_consistency": 0.2, "tensor": 0.35, "schema": 0.1, "provenance": 0.1, "spatial": 0.3, "quality": 0.25}
MONITOR = {"semantic_vector": (0.3, 0.7), "graph_document": (0.4, 0.8), "temporal_consistency": (0.2, 0.6), "tensor": (0.35, 0.75), "schema": (0.1, 0.5), "quality": (0.25, 0.65)}
QUALITY = {"semantic_vector": 0.25, "graph_document": 0.25, "temporal_consistency": 0.20, "tensor": 0.15, "schema": 0.15}
QUALITY_ALL = {"semantic_vector": 0.20, "graph_document": 0.20, "temporal_consistency": 0.15, "tensor": 0.10, "schema": 0.10, "provenance": 0.15, "spatial": 0.10}


def clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def graph_document(entities: Column, targets: Column) -> Column:
    """Half the uncovered share of a document's entities, half the share of targets that name none of them.

    An entity is covered by a target if one contains the other; 0 without entities.
    """
    covered = F.size(F.filter(entities, lambda e: F.exists(targets, lambda t: t.contains(e) | e.contains(t))))
    extra = F.size(F.filter(targets, lambda t: ~F.exists(entities, lambda e: t.contains(e))))
    share = F.when(F.size(targets) > 0, extra / F.size(targets)).otherwise(F.lit(0.0))
    return F.when(F.size(entities) <= 0, F.lit(0.0)).otherwise(clamp((1 - covered / F.size(entities) + share) / 2))


def tensor(expected: Column, actual: Column, mean_gap: Column, std_gap: Column, broken: Column) -> Column:
    """0.5 shape difference, 0.2 each of the capped mean and deviation gaps, 0.3 for NaN or infinity."""
    parts = F.zip_with(expected, actual, lambda e, a: F.when(e.isNull() | a.isNull() | (e == 0), F.lit(0.0)).otherwise(F.abs(e - a) / e))
    shape = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(expected), F.size(actual))
    return clamp(0.5 * shape + 0.2 * F.least(mean_gap, F.lit(1.0)) + 0.2 * F.least(std_gap, F.lit(1.0)) + F.when(broken, 0.3).otherwise(0.0))


def provenance(valid: Column, length: Column, gap: Column, max_gap: Column) -> Column:
    stale = F.when(gap > max_gap, 0.3 * F.least(gap / max_gap - 1, F.lit(1.0))).otherwise(0.0)
    return F.when(~valid, F.lit(1.0)).otherwise(clamp(F.when(length == 0, 0.5).otherwise(0.0) + stale))


def spatial(valid: Column, mentions: Column, has_point: Column, mismatch: Column) -> Column:
    score = F.when(mentions & ~has_point, 0.4).otherwise(0.0) + F.when(mismatch, 0.5).otherwise(0.0) + F.when(has_point & ~mentions, 0.1).otherwise(0.0)
    return F.when(~valid, F.lit(0.9)).otherwise(clamp(score))


def schema(missing: Column, required: Column, violations: Column, constraints: Column) -> Column:
    share = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    return clamp(0.5 * share(missing, required) + 0.5 * share(violations, constraints))


def weighted(weights: dict[str, float]) -> Column:
    """Weighted sum of the score columns of those names."""
    return clamp(sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)))


def primary(names: list[str]) -> Column:
    """The name of the largest score; of equal ones the last named."""
    return F.array_max(F.array(*(F.struct(F.col(n).alias("score"), F.lit(k).alias("order"), F.lit(n).alias("name")) for k, n in enumerate(names))))["name"]


def _label(score: Column, steps: list[tuple[float, str]], low: str, strict: bool) -> Column:
    out = F.lit(low)
    for limit, name in reversed(steps):
        out = F.when((score > limit) if strict else (score >= limit), name).otherwise(out)
    return out


def severity(score: Column) -> Column:
    return _label(score, [(0.9, "Emergency"), (0.7, "Critical"), (0.5, "Warning")], "Info", True)


def health(worst: Column) -> Column:
    return _label(worst, [(0.9, "Critical"), (0.7, "Degraded"), (0.5, "Warning")], "Healthy", True)


def entity_health(worst: Column) -> Column:
    return _label(worst, [(0.7, "critical"), (0.3, "warning")], "healthy", False)


def monitor_health(score: Column) -> Column:
    return _label(score, [(0.8, "critical"), (0.5, "degraded"), (0.3, "warning")], "healthy", False)


def threshold(kind: Column, table: dict[str, float] = THRESHOLDS) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[kind]


def monitor_level(kind: Column, score: Column) -> Column:
    """critical, warning or ok by the kind's own limits; 0.5 and 0.8 for others."""
    limit = lambda k, d: F.coalesce(F.create_map(*(F.lit(x) for n, v in MONITOR.items() for x in (n, v[k])))[kind], F.lit(d))
    return F.when(score >= limit(1, 0.8), "critical").when(score >= limit(0, 0.5), "warning").otherwise("ok")
