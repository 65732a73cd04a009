"""Readers and writers of the formats that entities come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTITY = """id string, document struct<title: string, body: string, fields: map<string, string>>, vector struct<embedding: array<float>, model: string>,
tensor struct<shape: array<int>, data: array<double>>, semantic struct<types: array<string>, properties: map<string, string>>,
graph struct<relationships: array<struct<predicate: string, target: string>>>,
provenance struct<event_type: string, actor: string, source: string, description: string>,
spatial struct<latitude: double, longitude: double, altitude: double, geometry_type: string, srid: int>, metadata map<string, string>"""
SCAN = "program_path string, language string, frameworks array<string>, weak_points array<struct<category: string, location: string, severity: string, description: string>>"


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines in the canonical entity form; a fixed schema, so nothing is inferred."""
    return spark.read.schema(ENTITY).json(path)


def entity_tables(entities: DataFrame) -> dict[str, DataFrame]:
    """Modality tables out of entities: one projection or explode each, to be written apart."""
    have = lambda slot, *cols: entities.where(F.col(slot).isNotNull()).select(F.col("id").alias("entity_id"), *cols)
    return {
        "document": have("document", "document.*"),
        "vector": have("vector", "vector.*"),
        "tensor": have("tensor", "tensor.*"),
        "semantic": have("semantic", "semantic.*"),
        "graph": have("graph", F.explode("graph.relationships").alias("r")).select(F.col("entity_id").alias("subject"), "r.predicate", F.col("r.target").alias("object")),
        "provenance": have("provenance", "provenance.*"),
        "spatial": have("spatial", "spatial.*"),
    }


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """Scan reports, one JSON document or array of them a file, as one row per weak point with its place ``point`` in the
    report; a report without any has one row of nulls."""
    scans = spark.read.schema(SCAN).option("multiLine", True).json(path)
    return scans.select("program_path", "language", F.posexplode_outer("weak_points").alias("point", "p")).select("program_path", "language", "point", "p.*")


def scan_triples(points: DataFrame) -> DataFrame:
    """(subject, predicate, object) of weak points (program_path, point, category, location, severity): a repository's
    scan, the scan's weaknesses, and each one's file, category and severity; what is missing is 'unknown'."""
    scan = F.concat(F.lit("scan:"), "program_path")
    weakness = F.concat(scan, F.lit(":wp:"), F.col("point").cast("string"))
    to = lambda kind, c: F.concat(F.lit(kind), F.coalesce(c, F.lit("unknown")))
    triple = lambda s, p, o: F.struct(s.alias("subject"), F.lit(p).alias("predicate"), o.alias("object"))
    own = F.array(
        triple(scan, "has_weakness", weakness), triple(weakness, "in_file", to("file:", "location")),
        triple(weakness, "has_category", to("category:", "category")), triple(weakness, "has_severity", to("severity:", "severity")),
    )
    repos = points.select(F.concat(F.lit("repo:"), "program_path").alias("subject"), F.lit("has_scan").alias("predicate"), scan.alias("object")).distinct()
    return repos.unionByName(points.where("point is not null").select(F.explode(own).alias("t")).select("t.*"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of one file, a folder, or a glob of dated files; damaged lines are nulls, not failures."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A relational store, read in ranges of its key; filters and columns are pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, **options).load()


#: Spark formats of the other stores, each read with its own connector package on the classpath.
CONNECTORS = {"postgresql": "jdbc", "clickhouse": "jdbc", "duckdb": "jdbc", "sqlite": "jdbc", "mongodb": "mongodb", "elasticsearch": "org.elasticsearch.spark.sql", "neo4j": "org.neo4j.spark.DataSource", "redis": "org.apache.spark.sql.redis", "object_storage": "parquet"}


def read_store(spark: SparkSession, kind: str, **options: str) -> DataFrame:
    return spark.read.format(CONNECTORS[kind]).options(**options).load()


def write(df: DataFrame, path: str, form: str, mode: str = "error") -> None:
    """json (lines), csv (with header; nested columns as JSON) or parquet."""
    if form == "csv":
        flat = [F.to_json(c).alias(c) if kind.startswith(("struct", "array", "map")) else F.col(c) for c, kind in df.dtypes]
        df.select(*flat).write.mode(mode).option("header", True).csv(path)
    elif form in ("json", "parquet"):
        df.write.mode(mode).format(form).save(path)
    else:
        raise ValueError(form)
