"""The entity model over the source tables: one DataFrame per modality, built lazily."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How logged events stand for provenance events.
EVENT_KINDS = {"signup": "created", "view": "imported", "click": "modified", "purchase": "merged", "error": "drift_repaired"}
MODALITIES = ["graph", "vector", "tensor", "semantic", "document", "temporal", "provenance", "spatial"]


class Dataset:
    """Modality tables of one data folder. Reads are plain Parquet scans, so filters and columns reach them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        d = self.table("documents")
        return d.select(F.col("doc_id").alias("entity_id"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("body"), "lang", "source", "n_chars")

    @property
    def vectors(self) -> DataFrame:
        """Components as doubles; label is the entity's semantic type."""
        return self.table("embeddings").select(F.col("vec_id").alias("entity_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")

    @property
    def tensors(self) -> DataFrame:
        """Embeddings as row-major 8 x 8 tensors."""
        return self.vectors.select("entity_id", F.array(F.lit(8), F.lit(8)).alias("shape"), F.col("embedding").alias("data"))

    @property
    def semantic(self) -> DataFrame:
        return self.table("labels").select(F.col("doc_id").alias("entity_id"), "quality", "toxic")

    @property
    def edges(self) -> DataFrame:
        """(subject, predicate, object) triples of the foreign keys."""

        def part(table: str, s: str, sk: str, predicate: str, o: str, ok: str) -> DataFrame:
            name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
            return self.table(table).select(name(s, sk).alias("subject"), F.lit(predicate).alias("predicate"), name(o, ok).alias("object"))

        return reduce(
            DataFrame.unionByName,
            [
                part("orders", "order/", "o_orderkey", "placed_by", "customer/", "o_custkey"),
                part("customer", "customer/", "c_custkey", "in_nation", "nation/", "c_nationkey"),
                part("supplier", "supplier/", "s_suppkey", "in_nation", "nation/", "s_nationkey"),
                part("nation", "nation/", "n_nationkey", "in_region", "region/", "n_regionkey"),
            ],
        )

    @property
    def versions(self) -> DataFrame:
        """Versions of a user: their events in order, numbered from 1."""
        from .operators.temporal import number_versions

        e = self.table("events").select(F.col("user_id").alias("entity_id"), "ts", "event_id", F.col("event_type").alias("message"), F.col("value").alias("payload"))
        return number_versions(e, "entity_id", "ts", "event_id")

    @property
    def provenance(self) -> DataFrame:
        """(entity_id, seq, event_type, actor, ts, source, description): the events as unhashed provenance records."""
        v = self.versions
        kind = F.coalesce(F.create_map(*(F.lit(x) for kv in EVENT_KINDS.items() for x in kv))[F.col("message")], F.lit("custom"))
        return v.select(
            "entity_id", F.col("version").alias("seq"), kind.alias("event_type"), F.concat(F.lit("user"), (F.col("entity_id") % 7).cast("string")).alias("actor"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), F.lit(None).cast("string").alias("source"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"),
        )

    @property
    def spatial(self) -> DataFrame:
        """Customers and suppliers at places derived from their keys."""

        def part(table: str, key: str, prefix: str) -> DataFrame:
            k = F.col(key)
            return self.table(table).select(F.concat(F.lit(prefix), k.cast("string")).alias("entity_id"), ((k * 37) % 18000 / 100 - 90).alias("lat"), ((k * 91) % 36000 / 100 - 180).alias("lon"))

        return part("customer", "c_custkey", "customer/").unionByName(part("supplier", "s_suppkey", "supplier/"))

    @property
    def peers(self) -> DataFrame:
        """One store per document source, with trust and response time derived from its number."""
        d = self.table("documents").where("source is not null").groupBy(F.col("source").alias("store_id")).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        return d.select("store_id", "n_docs", "last_doc", ((F.regexp_extract("store_id", r"(\d+)$", 1).cast("int") * 13) % 20 / 20).alias("trust"), ((F.regexp_extract("store_id", r"(\d+)$", 1).cast("int") * 97) % 1500).cast("double").alias("response_ms"))
