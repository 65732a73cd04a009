"""Unions of many stores under a consistency policy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Trust from which a store passes the trust form of STRICT, and the spread from which replicas diverge.
STRICT_TRUST, DIVERGED = 0.7, 0.3


def matches(store: Column, pattern: str) -> Column:
    """'*' is every store, 'prefix/*' those that begin with the prefix, else the one store."""
    if pattern == "*":
        return F.lit(True)
    return store.startswith(pattern[:-2]) if pattern.endswith("/*") else store == pattern


def eligible(have: Column, wanted: list[str]) -> Column:
    """The store has every wanted modality."""
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), have)) == 0


def union(sources: list[DataFrame]) -> DataFrame:
    """Rows of all sources; a column that a source lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def with_drift(rows: DataFrame, content: list[str]) -> DataFrame:
    """Adds row_hash and drifted: whether stores disagree on an entity's content. One aggregate per entity and a join."""
    hashed = rows.withColumn("row_hash", F.sha2(F.to_json(F.struct(*content), {"ignoreNullFields": "false"}), 256))
    spread = hashed.groupBy("entity_id").agg((F.min("row_hash") != F.max("row_hash")).alias("drifted"))
    return hashed.join(spread, "entity_id")


def apply_policy(rows: DataFrame, policy: str, content: list[str], ts: str = "ts") -> DataFrame:
    """TOLERATE keeps all rows; STRICT entities on which all stores agree; LATEST the newest row of an entity; REPAIR
    gives drifted entities the newest row's content everywhere."""
    if policy == "TOLERATE":
        return rows
    if policy == "STRICT":
        return with_drift(rows, content).where("not drifted").drop("row_hash", "drifted")
    newest = F.max_by(F.struct(*content), F.struct(ts, "store_id"))
    if policy == "LATEST":
        w = W.partitionBy("entity_id").orderBy(F.desc(ts), F.desc("store_id"))
        return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if policy == "REPAIR":
        best = rows.groupBy("entity_id").agg(newest.alias("_best"))
        keep = [c for c in rows.columns if c not in content]
        return rows.join(best, "entity_id").select(*keep, *(F.col(f"_best.{c}").alias(c) for c in content))
    raise ValueError(policy)


def store_score(trust: Column, response_ms: Column) -> Column:
    """0.7 x trust + 0.3 x speed; speed 0.5 where unknown."""
    speed = F.when(response_ms.isNull(), 0.5).otherwise(1 - F.least(response_ms / 1000, F.lit(1.0)))
    return 0.7 * trust + 0.3 * speed


def replication_status(missing: Column, spread: Column) -> Column:
    return F.when(spread > DIVERGED, "Diverged").when(missing > 0, F.concat(F.lit("Stale:"), (missing * 1000).cast("string"))).otherwise("UpToDate")


def trust_fold(outcomes: DataFrame, start: float = 1.0, chunk: int = 10_000) -> DataFrame:
    """(store_id, trust): +0.05 for a success, -0.1 for a failure, held in [0, 1], in order of seq.

    A run of held steps is itself one step, x -> min(max(x + move, low), high). So the outcomes of ``chunk`` numbers of seq
    are folded to three numbers, and only those are gathered per store.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "ok")))

    def then(f: Column, move: Column, low: Column, high: Column) -> Column:
        held = lambda x: F.least(F.greatest(x + move, low), high)
        return F.struct((f["move"] + move).alias("move"), held(f["low"]).alias("low"), held(f["high"]).alias("high"))

    still = F.struct(F.lit(0.0).alias("move"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    step = lambda f, o: then(f, F.when(o["ok"], 0.05).otherwise(-0.1), F.lit(0.0), F.lit(1.0))
    parts = outcomes.groupBy("store_id", F.floor(F.col("seq") / chunk).alias("part")).agg(ordered.alias("o"))
    parts = parts.select("store_id", "part", F.aggregate("o", still, step).alias("f"))
    whole = parts.groupBy("store_id").agg(F.array_sort(F.collect_list(F.struct("part", "f"))).alias("fs"))
    f = F.aggregate("fs", still, lambda f, p: then(f, p["f"]["move"], p["f"]["low"], p["f"]["high"]))
    return whole.select("store_id", f.alias("f")).select("store_id", F.least(F.greatest(F.lit(start) + F.col("f.move"), F.col("f.low")), F.col("f.high")).alias("trust"))


def consensus(votes: DataFrame, level: str) -> DataFrame:
    """(entity_id, value, votes, of, agreed) of the value with most votes (ties: the least); STRONG needs all, QUORUM n div 2 + 1, EVENTUAL one."""
    counts = votes.groupBy("entity_id", "value").agg(F.count("*").alias("votes"))
    best = counts.groupBy("entity_id").agg(F.sum("votes").alias("of"), F.min_by("value", F.struct((-F.col("votes")).alias("v"), "value")).alias("value"), F.max("votes").alias("votes"))
    need = {"STRONG": F.col("of"), "QUORUM": F.floor(F.col("of") / 2) + 1, "EVENTUAL": F.lit(1)}[level]
    return best.select("entity_id", "value", "votes", "of", (F.col("votes") >= need).alias("agreed"))


def fan_out(readers: dict[str, object]) -> tuple[DataFrame | None, dict[str, str]]:
    """Union of the stores that can be opened, each row with its store_id, and the errors of the others.

    A reader is a function without arguments that gives a DataFrame; one that fails counts as empty.
    """
    rows, errors = [], {}
    for store, read in readers.items():
        try:
            rows.append(read().withColumn("store_id", F.lit(store)))
        except Exception as e:  # noqa: BLE001  any store may fail in its own way
            errors[store] = str(e).splitlines()[0]
    return (union(rows) if rows else None), errors


def heartbeats(beats: DataFrame) -> DataFrame:
    """(store_id, registered, last_seen, beats, live): the registry as a fold of its log (store_id, ts, op); a store is live unless its last entry is 'leave'."""
    g = beats.groupBy("store_id").agg(F.min("ts").alias("registered"), F.max("ts").alias("last_seen"), F.count("*").alias("beats"), F.max_by("op", F.struct("ts", "op")).alias("last_op"))
    return g.select("store_id", "registered", "last_seen", "beats", (F.col("last_op") != "leave").alias("live"))
