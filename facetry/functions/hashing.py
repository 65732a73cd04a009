"""Content hashes, commitments and certificates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SHA-256 of nothing: the parent of a chain's first record.
GENESIS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def record_hash(actor: Column, description: Column, event_type: Column, parent: Column, source: Column, ts: Column) -> Column:
    """SHA-256 of the record as JSON with sorted keys and explicit nulls."""
    record = F.struct(actor.alias("actor"), description.alias("description"), event_type.alias("event_type"), parent.alias("parent_hash"), source.alias("source"), ts.alias("timestamp"))
    return F.sha2(F.to_json(record, {"ignoreNullFields": "false"}), 256)


def commitment(claim: Column, secret: Column) -> Column:
    return F.sha2(F.concat(claim, secret), 256)


def joined(*digests: Column) -> Column:
    """SHA-256 of the raw digests, one after another."""
    return F.sha2(F.concat(*(F.unhex(d) for d in digests)), 256)


def signature(prover: Column, statement: Column, term: Column) -> Column:
    return F.sha2(F.concat_ws(":", prover, statement, term), 256)
