"""Triples (subject, predicate, object)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import bounded, checkpoint

TRIPLE = ["subject", "predicate", "object"]


def insert(edges: DataFrame, new: DataFrame) -> DataFrame:
    return edges.unionByName(new).dropDuplicates(TRIPLE)


def delete(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select(*TRIPLE), TRIPLE, "left_anti")


def existing(edges: DataFrame, asked: DataFrame) -> DataFrame:
    return asked.join(edges.select(*TRIPLE), TRIPLE, "left_semi")


def outgoing(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("subject") == node)


def incoming(edges: DataFrame, node: str) -> DataFrame:
    return edges.where(F.col("object") == node)


def related(edges: DataFrame, node: str, predicate: str) -> DataFrame:
    return outgoing(edges, node).where(F.col("predicate") == predicate).select(F.col("object").alias("entity_id"))


def keyed(edges: DataFrame) -> DataFrame:
    """(by_subject, by_object): the sort keys of the two orders that triples are stored in, parts ended by U+0000."""
    end = F.lit("\u0000")
    return edges.select(F.concat("subject", end, "predicate", end, "object").alias("by_subject"), F.concat("object", end, "predicate", end, "subject").alias("by_object"))


def scan_keys(keys: DataFrame, key: str, first: str) -> DataFrame:
    """Triples whose key begins with one subject or object; the prefix reaches the scan of a stored table."""
    parts = F.split(key, "\u0000")
    names = TRIPLE if key == "by_subject" else TRIPLE[::-1]
    return keys.where(F.col(key).startswith(first + "\u0000")).select(*(F.get(parts, F.lit(names.index(n))).alias(n) for n in TRIPLE))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b): each edge both ways."""
    return edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).unionByName(edges.select(F.col("object").alias("a"), F.col("subject").alias("b")))


def neighborhood(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(node, depth): nodes within so many undirected hops of the seeds (column node), with their least depth.

    Breadth first: a hop reads the edges once, against the frontier, which is broadcast while it is small, and drops what
    has been seen, so cycles end. Frontiers are stored, so the work of a hop doesn't grow with the hops before it.
    """
    seen = checkpoint(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for hop in range(1, hops + 1):
        now = bounded(frontier.select("node"))
        out = edges.join(now, F.col("subject") == F.col("node")).select(F.col("object").alias("to"))
        back = edges.join(now, F.col("object") == F.col("node")).select(F.col("subject").alias("to"))
        step = out.unionByName(back).distinct().withColumnRenamed("to", "node")
        frontier = checkpoint(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def paths(edges: DataFrame, start: str, most: int, least: int = 1) -> DataFrame:
    """(node, depth): ends of directed walks of least..most edges, one row per walk (UNION ALL); least 0 has the start itself."""
    e = edges.select(F.col("subject").alias("a"), F.col("object").alias("b"))
    walk = e.where(F.col("a") == start).select(F.col("b").alias("node"), F.lit(1).alias("depth"))
    out = walk
    for depth in range(2, most + 1):
        walk = walk.join(e, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(depth).alias("depth"))
        out = out.unionByName(walk)
    if least == 0:
        out = out.unionByName(edges.sparkSession.createDataFrame([(start, 0)], "node string, depth int"))
    return out.where(F.col("depth") >= least)


def steps(edges: DataFrame, predicate: str, direction: str, a: str, b: str) -> DataFrame:
    """(a, b) of one edge of a pattern: ->, <- or -, the last either way."""
    e = edges.where(F.col("predicate") == predicate)
    out = e.select(F.col("subject").alias(a), F.col("object").alias(b))
    back = e.select(F.col("object").alias(a), F.col("subject").alias(b))
    return {"->": out, "<-": back, "-": out.unionByName(back)}[direction]


def pattern(edges: DataFrame, first: str, second: str, directions: tuple[str, str] = ("->", "->")) -> DataFrame:
    """(a, b, c) of two edges that meet in b, each in its direction."""
    return steps(edges, first, directions[0], "a", "b").join(steps(edges, second, directions[1], "b", "c"), "b").select("a", "b", "c")


def degree(edges: DataFrame) -> DataFrame:
    """(node, degree): both directions."""
    return undirected(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"))
