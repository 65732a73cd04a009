"""Hash-linked provenance chains (entity_id, seq, event_type, actor, ts, source, description)."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import GENESIS, record_hash

# The kinds of events and the fields that a record's hash covers.
KINDS = ["created", "modified", "imported", "normalized", "drift_repaired", "deleted", "merged"]
FIELDS = ["actor", "description", "event_type", "source", "ts"]


def normal_kind(kind: Column) -> Column:
    """Lower-case known kinds; others are custom."""
    low = F.lower(F.trim(kind))
    return F.when(low.isin(KINDS), low).otherwise("custom")


def append(records: DataFrame) -> DataFrame:
    """Adds parent_hash and content_hash: each record names the one before it, the first names GENESIS.

    A record's hash needs its parent's, so an entity's records are folded in order. Records are dealt by entity and
    sorted, and a task walks its rows as a stream: state is one hash, whatever a chain's length. The hash is the one
    of record_hash, which verification computes in SQL. Records without entity_id are one chain.
    """
    names = records.columns
    at = {c: names.index(c) for c in ("entity_id", *FIELDS)}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, last = object(), GENESIS
        for b in batches:
            parents, hashes = [], []
            for e, *values in zip(*(b.column(k).to_pylist() for k in at.values())):
                if e != entity:
                    entity, last = e, GENESIS
                v = dict(zip(FIELDS, values))
                record = {"actor": v["actor"], "description": v["description"], "event_type": v["event_type"], "parent_hash": last, "source": v["source"], "timestamp": v["ts"]}
                parents.append(last)
                last = hashlib.sha256(json.dumps(record, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parents, pa.string()), pa.array(hashes, pa.string())], names=[*names, "parent_hash", "content_hash"])

    schema = T.StructType(list(records.schema)).add("parent_hash", "string").add("content_hash", "string")
    return records.repartition("entity_id").sortWithinPartitions("entity_id", "seq").mapInArrow(fold, schema)


def verify(chain: DataFrame) -> DataFrame:
    """(entity_id, length, chain_valid, first_bad, fault): linkage is tested before the record's own hash."""
    w = W.partitionBy("entity_id").orderBy("seq")
    linked = F.col("parent_hash") == F.lag("content_hash", 1, GENESIS).over(w)
    whole = F.col("content_hash") == record_hash(*(F.col(c) for c in ("actor", "description", "event_type", "parent_hash", "source", "ts")))
    fault = F.when(~linked, "broken_link").when(~whole, "altered_record")
    tested = chain.select("entity_id", "seq", fault.alias("fault"))
    bad = F.min(F.when(F.col("fault").isNotNull(), F.struct("seq", "fault")))
    return tested.groupBy("entity_id").agg(F.count("*").alias("length"), bad.alias("bad")).select("entity_id", "length", F.col("bad").isNull().alias("chain_valid"), F.col("bad.seq").alias("first_bad"), F.col("bad.fault").alias("fault"))


def ends(chain: DataFrame) -> DataFrame:
    """(entity_id, origin, latest): descriptions of the first and the last record."""
    return chain.groupBy("entity_id").agg(F.min_by("description", "seq").alias("origin"), F.max_by("description", "seq").alias("latest"))
