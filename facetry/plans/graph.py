"""Graph, temporal, spatial and tensor queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import is_wgs84
from ..functions.text import local_name
from ..model import Dataset
from ..operators import graph as G
from ..operators import search
from ..operators import spatial as P
from ..operators import temporal as T
from ..operators import tensors as N
from .registry import query

EDGES = """(SELECT 'order/' || o_orderkey AS subject, 'placed_by' AS predicate, 'customer/' || o_custkey AS object FROM orders UNION ALL
SELECT 'customer/' || c_custkey, 'in_nation', 'nation/' || c_nationkey FROM customer UNION ALL
SELECT 'supplier/' || s_suppkey, 'in_nation', 'nation/' || s_nationkey FROM supplier UNION ALL
SELECT 'nation/' || n_nationkey, 'in_region', 'region/' || n_regionkey FROM nation)"""
BOTH = f"(SELECT subject AS a, object AS b FROM {EDGES} UNION SELECT object, subject FROM {EDGES})"


@query(f"SELECT count(*) AS n FROM (SELECT DISTINCT subject, predicate, object FROM {EDGES})")
def insert_triples(d: Dataset) -> DataFrame:
    """Inserting triples that exist changes nothing."""
    e = d.edges
    return G.insert(e, e.where("predicate = 'in_region'")).agg(F.count("*").alias("n"))


@query(f"SELECT predicate, object FROM {EDGES} WHERE subject = 'customer/7'")
def outgoing_edges(d: Dataset) -> DataFrame:
    return G.outgoing(d.edges, "customer/7").select("predicate", "object")


@query(f"SELECT predicate, subject FROM {EDGES} WHERE object = 'nation/3'")
def incoming_edges(d: Dataset) -> DataFrame:
    return G.incoming(d.edges, "nation/3").select("predicate", "subject")


@query(f"SELECT subject, predicate, object FROM {EDGES} WHERE predicate = 'in_nation' AND object = 'nation/1'")
def existing_edges(d: Dataset) -> DataFrame:
    asked = d.edges.where("predicate = 'in_nation'").withColumn("object", F.lit("nation/1")).distinct()
    return G.existing(d.edges, asked)


@query(f"SELECT predicate, count(*) AS n FROM {EDGES} WHERE NOT (predicate = 'in_nation' AND object = 'nation/1') GROUP BY 1")
def delete_edges(d: Dataset) -> DataFrame:
    gone = d.edges.where("predicate = 'in_nation' and object = 'nation/1'")
    return G.delete(d.edges, gone).groupBy("predicate").agg(F.count("*").alias("n"))


@query(f"""WITH h1 AS (SELECT DISTINCT b AS node FROM {BOTH} WHERE a = 'region/1' AND b <> 'region/1'),
h2 AS (SELECT DISTINCT b AS node FROM {BOTH} JOIN h1 ON a = h1.node WHERE b <> 'region/1' AND b NOT IN (SELECT node FROM h1))
SELECT 'region/1' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def neighborhood(d: Dataset) -> DataFrame:
    seeds = d.spark.createDataFrame([("region/1",)], "node string")
    return G.neighborhood(d.edges, seeds, 2)


@query(f"SELECT object AS entity_id FROM {EDGES} WHERE subject = 'order/1' AND predicate = 'placed_by'")
def related_entities(d: Dataset) -> DataFrame:
    return G.related(d.edges, "order/1", "placed_by")


@query(f"SELECT x.subject AS a, x.object AS b, y.object AS c FROM {EDGES} x JOIN {EDGES} y ON x.object = y.subject WHERE x.predicate = 'in_nation' AND y.predicate = 'in_region'")
def edge_pattern(d: Dataset) -> DataFrame:
    return G.pattern(d.edges, "in_nation", "in_region")


@query(f"SELECT x.subject AS a, x.object AS b, y.subject AS c FROM {EDGES} x JOIN {EDGES} y ON x.object = y.object WHERE x.predicate = 'in_nation' AND y.predicate = 'in_nation' AND x.subject = 'supplier/1'")
def edge_pattern_reverse(d: Dataset) -> DataFrame:
    """(supplier/1)-[in_nation]->(b)<-[in_nation]-(c)."""
    return G.pattern(d.edges, "in_nation", "in_nation", ("->", "<-")).where("a = 'supplier/1'")


@query(f"""WITH u AS (SELECT subject AS a, object AS b FROM {EDGES} WHERE predicate = 'in_region' UNION ALL SELECT object, subject FROM {EDGES} WHERE predicate = 'in_region')
SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a""")
def edge_pattern_undirected(d: Dataset) -> DataFrame:
    """(a)-[in_region]-(b)-[in_region]-(c)."""
    return G.pattern(d.edges, "in_region", "in_region", ("-", "-"))


WALK = f"WITH RECURSIVE w AS (SELECT 'order/1' AS node, 0 AS depth UNION ALL SELECT e.object, depth + 1 FROM w JOIN {EDGES} e ON e.subject = w.node WHERE depth < 3)"


@query(f"{WALK} SELECT node, depth FROM w WHERE depth >= 2")
def quantified_paths(d: Dataset) -> DataFrame:
    """Walks of {{2,3}} edges."""
    return G.paths(d.edges, "order/1", 3, 2)


@query(f"{WALK} SELECT node, depth FROM w")
def star_paths(d: Dataset) -> DataFrame:
    """Walks of any number of edges, none included; the graph is three deep."""
    return G.paths(d.edges, "order/1", 3, 0)


@query(f"""WITH h1 AS (SELECT DISTINCT b AS node FROM {BOTH} WHERE a = 'nation/3'), h2 AS (SELECT DISTINCT b AS node FROM {BOTH} JOIN h1 ON a = h1.node WHERE b <> 'nation/3' AND b NOT IN (SELECT node FROM h1))
SELECT node, depth FROM (SELECT 'nation/3' AS node, 0 AS depth UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2) ORDER BY depth, node LIMIT 50""")
def walk_by_depth(d: Dataset) -> DataFrame:
    """An undirected walk, nearest nodes first, the first fifty."""
    return G.neighborhood(d.edges, d.spark.createDataFrame([("nation/3",)], "node string"), 2).orderBy("depth", "node").limit(50)


@query(f"""WITH RECURSIVE w AS (SELECT object AS node, 1 AS depth FROM {EDGES} WHERE subject = 'order/1' UNION ALL SELECT e.object, depth + 1 FROM w JOIN {EDGES} e ON e.subject = w.node WHERE depth < 3)
SELECT node, depth FROM w WHERE depth >= 1""")
def bounded_paths(d: Dataset) -> DataFrame:
    return G.paths(d.edges, "order/1", 3)


@query(f"""WITH RECURSIVE w AS (SELECT object AS node, 1 AS depth FROM {EDGES} WHERE subject = 'order/1' UNION ALL SELECT e.object, depth + 1 FROM w JOIN {EDGES} e ON e.subject = w.node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM w GROUP BY 1""")
def recursive_paths(d: Dataset) -> DataFrame:
    """The same walk as a recursive SQL query."""
    d.edges.createOrReplaceTempView("facetry_edges")
    return d.spark.sql("""WITH RECURSIVE w(node, depth) AS (SELECT object, 1 FROM facetry_edges WHERE subject = 'order/1' UNION ALL SELECT e.object, depth + 1 FROM w JOIN facetry_edges e ON e.subject = w.node WHERE depth < 3)
    SELECT node, min(depth) AS depth FROM w GROUP BY node""")


@query(f"SELECT a AS node, count(*) AS degree, round(count(*) / (SELECT count(DISTINCT a) - 1 FROM {BOTH}), 6) AS centrality FROM (SELECT subject AS a FROM {EDGES} UNION ALL SELECT object FROM {EDGES}) GROUP BY 1")
def degree_centrality(d: Dataset) -> DataFrame:
    g = G.degree(d.edges)
    n = g.agg((F.count("*") - 1).alias("others"))
    return g.crossJoin(F.broadcast(n)).select("node", "degree", F.round(F.col("degree") / F.col("others"), 6).alias("centrality"))


@query(f"SELECT DISTINCT object, split_part(object, '/', 2) AS name FROM {EDGES} WHERE predicate = 'in_region'")
def local_names(d: Dataset) -> DataFrame:
    return d.edges.where("predicate = 'in_region'").select("object", local_name(F.col("object")).alias("name")).distinct()


V = "(SELECT user_id AS entity_id, ts, event_id, event_type AS message, value AS payload, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)"


@query(f"SELECT entity_id, version, event_id FROM {V}")
def numbered_versions(d: Dataset) -> DataFrame:
    return d.versions.select("entity_id", "version", "event_id")


@query(f"SELECT entity_id, max(version) AS version, arg_max(message, version) AS message, round(arg_max(payload, version), 6) AS payload FROM {V} GROUP BY 1")
def version_latest(d: Dataset) -> DataFrame:
    return T.latest(d.versions, ["message", "payload"]).select("entity_id", "version", "message", F.round("payload", 6).alias("payload"))


@query(f"SELECT entity_id, message, round(payload, 6) AS payload FROM {V} WHERE version = 3")
def version_at(d: Dataset) -> DataFrame:
    return T.at_version(d.versions, 3).select("entity_id", "message", F.round("payload", 6).alias("payload"))


@query(f"SELECT entity_id, max(version) AS version, arg_max(message, version) AS message FROM {V} WHERE ts <= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1")
def as_of(d: Dataset) -> DataFrame:
    return T.as_of(d.versions, "2024-01-10 00:00:00", ["message"])


@query(f"""SELECT o.o_orderkey, v.version, v.message FROM (SELECT o_orderkey, (o_custkey % 150) AS entity_id, TIMESTAMP '2024-01-01' + to_hours((o_orderkey % 700)::INT) AS ts FROM orders) o
ASOF LEFT JOIN {V} v ON o.entity_id = v.entity_id AND o.ts >= v.ts""")
def as_of_join(d: Dataset) -> DataFrame:
    when = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(o_orderkey % 700 as int), 0, 0)")
    o = d.table("orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("entity_id"), when.alias("ts"))
    return T.as_of_join(o, d.versions, ["message"]).select("o_orderkey", "version", "message")


@query(f"SELECT event_id FROM {V} WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def series_range(d: Dataset) -> DataFrame:
    return T.in_range(d.versions, "2024-01-05", "2024-01-06").select("event_id")


@query(f"SELECT entity_id, version, newest FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY version DESC) newest FROM {V}) WHERE newest <= 5")
def history(d: Dataset) -> DataFrame:
    return T.history(d.versions, 5).select("entity_id", "version", F.col("newest").cast("long").alias("newest"))


@query(f"""SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, a.message AS before, b.message AS after, CASE WHEN a.entity_id IS NULL THEN 'Added' WHEN b.entity_id IS NULL THEN 'Removed' WHEN a.message = b.message THEN 'NoChange' ELSE 'Changed' END AS change
FROM (SELECT * FROM {V} WHERE version = 60) a FULL JOIN (SELECT * FROM {V} WHERE version = 65) b ON a.entity_id = b.entity_id""")
def version_diff(d: Dataset) -> DataFrame:
    return T.diff(T.at_version(d.versions, 60), T.at_version(d.versions, 65), "message")


@query(f"""WITH v AS {V}, a AS (SELECT entity_id, arg_max(message, version) m FROM v WHERE ts <= TIMESTAMP '2024-01-02' GROUP BY 1), b AS (SELECT entity_id, arg_max(message, version) m FROM v WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY 1)
SELECT coalesce(a.entity_id, b.entity_id) AS entity_id, a.m AS before, b.m AS after, CASE WHEN a.entity_id IS NULL THEN 'Added' WHEN b.entity_id IS NULL THEN 'Removed' WHEN a.m = b.m THEN 'NoChange' ELSE 'Changed' END AS change FROM a FULL JOIN b ON a.entity_id = b.entity_id""")
def time_diff(d: Dataset) -> DataFrame:
    return T.diff(T.as_of(d.versions, "2024-01-02", ["message"]), T.as_of(d.versions, "2024-01-20", ["message"]), "message")


@query(f"SELECT entity_id, version, message, lag(message) OVER (PARTITION BY entity_id ORDER BY version) AS before FROM {V}")
def consecutive_diff(d: Dataset) -> DataFrame:
    return T.consecutive_diff(d.versions, "message").select("entity_id", "version", "message", "before")


@query(f"SELECT event_id, ts FROM {V} WHERE ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-04' ORDER BY ts DESC, event_id DESC LIMIT 50")
def newest_in_range(d: Dataset) -> DataFrame:
    x = d.versions.where("ts between timestamp_ntz'2024-01-03 00:00:00' and timestamp_ntz'2024-01-04 00:00:00'")
    return x.orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts")


@query("SELECT event_id FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def last_day(d: Dataset) -> DataFrame:
    """The 24 hours before the newest event; the bound is one aggregate row."""
    e = d.table("events").select("event_id", "ts")
    end = e.agg((F.max("ts") - F.expr("interval 24 hours")).alias("since"))
    return e.join(F.broadcast(end), F.col("ts") > F.col("since")).select("event_id")


S = "(SELECT 'customer/' || c_custkey AS entity_id, (c_custkey * 37) % 18000 / 100 - 90 AS lat, (c_custkey * 91) % 36000 / 100 - 180 AS lon FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, (s_suppkey * 37) % 18000 / 100 - 90, (s_suppkey * 91) % 36000 / 100 - 180 FROM supplier)"
KM = "2 * 6371.0 * asin(sqrt(least(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 1)))"


def _km(lat: str, lon: str) -> str:
    return KM.format(lat1=lat, lon1=lon, lat2="lat", lon2="lon")


@query(f"SELECT entity_id, round({_km('-60.0', '-110.0')}, 4) AS km FROM {S} WHERE {_km('-60.0', '-110.0')} <= 2000")
def spatial_radius(d: Dataset) -> DataFrame:
    return P.within_radius(d.spatial, -60.0, -110.0, 2000.0).select("entity_id", F.round("km", 4).alias("km"))


@query(f"SELECT entity_id, round({_km('-30.0', '0.0')}, 4) AS km FROM {S} WHERE lat BETWEEN -70 AND 10 AND lon BETWEEN -60 AND 60")
def spatial_bounds(d: Dataset) -> DataFrame:
    return P.within_bounds(d.spatial, -70.0, -60.0, 10.0, 60.0).select("entity_id", F.round("km", 4).alias("km"))


@query(f"SELECT entity_id, round({_km('51.5074', '-0.1278')}, 4) AS km FROM {S} ORDER BY {_km('51.5074', '-0.1278')}, entity_id LIMIT 10")
def spatial_nearest(d: Dataset) -> DataFrame:
    return P.nearest(d.spatial, 51.5074, -0.1278, 10).select("entity_id", F.round("km", 4).alias("km"))


@query(f"SELECT count(*) AS n, sum((lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)::INT)::BIGINT AS valid FROM {S}")
def spatial_validation(d: Dataset) -> DataFrame:
    return d.spatial.agg(F.count("*").alias("n"), F.sum(is_wgs84(F.col("lat"), F.col("lon")).cast("int")).alias("valid"))


@query("""SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'moved' ELSE 'old' END AS kind, count(*) AS n, round(sum(CASE WHEN s_suppkey % 4 = 0 THEN 10.5 ELSE (s_suppkey * 37) % 18000 / 100 - 90 END), 4) AS lat FROM supplier WHERE s_suppkey % 5 <> 0 GROUP BY 1
UNION ALL SELECT 'rejected', count(*), NULL FROM supplier WHERE s_suppkey % 6 = 0""")
def spatial_updates(d: Dataset) -> DataFrame:
    """Every fourth supplier moves, places off the globe are rejected, every fifth supplier is deleted."""
    key = F.split_part("entity_id", F.lit("/"), F.lit(2)).cast("long")
    p = d.spatial.where(F.col("entity_id").startswith("supplier/"))
    new = p.where(key % 4 == 0).withColumn("lat", F.lit(10.5)).unionByName(p.where(key % 6 == 0).withColumn("lat", F.lit(91.0)))
    on_globe = is_wgs84(F.col("lat"), F.col("lon"))
    left = search.delete(search.upsert(p, new.where(on_globe)), p.where(key % 5 == 0))
    kinds = left.groupBy(F.when(key % 4 == 0, "moved").otherwise("old").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("lat"), 4).alias("lat"))
    return kinds.unionByName(new.where(~on_globe).agg(F.lit("rejected").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("double").alias("lat")))


@query(f"SELECT entity_id FROM {S} WHERE lat > -80 AND lat < -20 AND lon > -150 AND lon < -150 + 2 * (lat + 80)")
def spatial_polygon(d: Dataset) -> DataFrame:
    return P.in_polygon(d.spatial, [(-80.0, -150.0), (-20.0, -150.0), (-20.0, -30.0)]).select("entity_id")


@query(f"""SELECT a.entity_id AS "left", b.entity_id AS "right", round({KM.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')}, 4) AS km
FROM {S} a JOIN {S} b ON a.entity_id LIKE 'customer/%' AND b.entity_id LIKE 'supplier/%' AND {KM.format(lat1='a.lat', lon1='a.lon', lat2='b.lat', lon2='b.lon')} <= 500""")
def spatial_join(d: Dataset) -> DataFrame:
    s = d.spatial
    j = P.distance_join(s.where(F.col("entity_id").startswith("customer/")), s.where(F.col("entity_id").startswith("supplier/")), 500.0)
    return j.select("left", "right", F.round("km", 4).alias("km"))


CELLS = "(SELECT vec_id AS entity_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, embedding[i]::DOUBLE AS x FROM embeddings, unnest(range(1, 65)) t(i))"
DUCK = {"sum": "sum", "mean": "avg", "max": "max", "min": "min", "prod": "product"}


def _reduction(how: str):
    def f(d: Dataset) -> DataFrame:
        r = N.reduce_axis(d.tensors, 0, how)
        return r.select("entity_id", "at", F.round("value", 6).alias("value"))

    f.__name__ = f"tensor_reduce_{how}"
    f.__doc__ = f"{how} over the first axis."
    return query(f"SELECT entity_id, c AS at, round({DUCK[how]}(x), 6) AS value FROM {CELLS} GROUP BY 1, 2")(f)


tensor_reduce_sum, tensor_reduce_mean, tensor_reduce_max, tensor_reduce_min, tensor_reduce_prod = map(_reduction, DUCK)


@query(f"SELECT entity_id, r AS at, round(sum(x), 6) AS value FROM {CELLS} GROUP BY 1, 2")
def tensor_reduce_last_axis(d: Dataset) -> DataFrame:
    return N.reduce_axis(d.tensors, 1, "sum").select("entity_id", "at", F.round("value", 6).alias("value"))


@query("""SELECT vec_id AS entity_id, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS std, round(list_min(e), 6) AS min, round(list_max(e), 6) AS max, false AS has_nan, false AS has_inf FROM (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings)""")
def tensor_statistics(d: Dataset) -> DataFrame:
    s = d.tensors.select("entity_id", N.statistics(F.col("data")).alias("s"))
    return s.select("entity_id", *(F.round(f"s.{k}", 6).alias(k) for k in ("mean", "std", "min", "max")), "s.has_nan", "s.has_inf")


@query("SELECT vec_id AS entity_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: 2 * x + 1)), 6) AS total FROM embeddings")
def tensor_map(d: Dataset) -> DataFrame:
    return N.mapped(d.tensors, lambda x: 2 * x + 1).select("entity_id", F.round(F.aggregate("data", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT vec_id AS entity_id, round(embedding[9]::DOUBLE, 6) AS first, len(embedding[9:16]) AS n, len(embedding) = 64 AS consistent FROM embeddings")
def tensor_slice(d: Dataset) -> DataFrame:
    row = F.slice("data", 9, 8)
    return d.tensors.select("entity_id", F.round(F.element_at(row, 1), 6).alias("first"), F.size(row).cast("long").alias("n"), N.is_consistent(F.col("shape"), F.col("data")).alias("consistent"))


@query("SELECT vec_id AS entity_id FROM embeddings WHERE list_max(embedding::DOUBLE[]) > 0.3 AND len(embedding) = 64")
def tensor_predicates(d: Dataset) -> DataFrame:
    """SHAPE, RANK and value predicates."""
    t = d.tensors.where((F.col("shape") == F.array(F.lit(8), F.lit(8))) & (F.size("shape") == 2) & (F.array_max("data") > 0.3))
    return t.select("entity_id")


