"""Drift and streaming queries (batch forms; the stream forms are held against them in tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import drift as D
from ..functions import vectors as V
from ..model import Dataset
from ..operators import temporal as T
from ..operators import tensors as N
from ..streaming import drift_state as K
from ..streaming import windows as X
from .registry import query

E = "(SELECT vec_id AS entity_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
CENTRE = f"(SELECT label, list(m ORDER BY i) AS centre FROM (SELECT label, i, avg(e[i]) AS m FROM {E}, unnest(range(1, 65)) t(i) GROUP BY 1, 2) GROUP BY 1)"
SV = f"(SELECT entity_id, least(greatest(1 - list_cosine_similarity(e, centre), 0), 1) AS semantic_vector FROM {E} JOIN {CENTRE} USING (label))"


def _semantic_vector(d: Dataset) -> DataFrame:
    """1 - cosine with the mean vector of the entity's type."""
    cells = d.vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centre = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre"))
    x = d.vectors.join(centre, "label")
    return x.select("entity_id", D.clamp(1 - V.cosine(F.col("embedding"), F.col("centre"))).alias("semantic_vector"))


@query(f"SELECT entity_id, round(semantic_vector, 6) AS semantic_vector FROM {SV}")
def drift_semantic_vector(d: Dataset) -> DataFrame:
    return _semantic_vector(d).select("entity_id", F.round("semantic_vector", 6).alias("semantic_vector"))


WORDS = "list_distinct(list_filter(regexp_split_to_array(lower(substr(text, 1, 40)), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 2))"
GD = f"""(SELECT entity_id, CASE WHEN len(es) = 0 THEN 0 ELSE least(greatest((1 - len(list_filter(es, lambda e: contains(t1, e) OR contains(e, t1) OR contains(t2, e) OR contains(e, t2))) / len(es)
 + ((len(list_filter(es, lambda e: contains(t1, e))) = 0)::INT + (len(list_filter(es, lambda e: contains(t2, e))) = 0)::INT) / 2) / 2, 0), 1) END AS graph_document
FROM (SELECT doc_id AS entity_id, {WORDS} AS es, lower(lang) AS t1, 'the' AS t2 FROM documents))"""


def _graph_document(d: Dataset) -> DataFrame:
    """Words of the title as the document's entities, its language and 'the' as graph targets."""
    es = F.array_distinct(F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 2))
    x = d.documents.select("entity_id", es.alias("es"), F.array(F.lower("lang"), F.lit("the")).alias("ts"))
    return x.select("entity_id", D.graph_document(F.col("es"), F.col("ts")).alias("graph_document"))


@query(f"SELECT entity_id, round(graph_document, 6) AS graph_document FROM {GD}")
def drift_graph_document(d: Dataset) -> DataFrame:
    return _graph_document(d).select("entity_id", F.round("graph_document", 6).alias("graph_document"))


V_SQL = "(SELECT user_id AS entity_id, ts, event_id, event_type AS message, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events)"


@query(f"""WITH v AS {V_SQL}, s AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY entity_id ORDER BY version)) AS step, (row_number() OVER (PARTITION BY entity_id, message ORDER BY version) > 1)::INT AS again FROM v),
g AS (SELECT entity_id, count(*) n, sum((step < 0)::INT) back, sum(again) repeats, list(abs(step) ORDER BY abs(step)) FILTER (step IS NOT NULL) gaps FROM s GROUP BY 1)
SELECT entity_id, round(CASE WHEN n < 2 THEN 0 ELSE least((coalesce(back, 0) + 0.5 * repeats + CASE WHEN len(gaps) >= 3 AND gaps[len(gaps) // 2 + 1] > 0 AND gaps[len(gaps)] > 10 * gaps[len(gaps) // 2 + 1] THEN 0.5 ELSE 0 END) / n, 1) END, 6) AS score FROM g""")
def drift_temporal(d: Dataset) -> DataFrame:
    """Versions in order of event_id, so that time may step back."""
    e = d.table("events").select(F.col("user_id").alias("entity_id"), "ts", "event_id", F.col("event_type").alias("message"))
    return T.temporal_consistency(T.number_versions(e, "entity_id", "event_id", "ts"), "message").select("entity_id", F.round("score", 6).alias("score"))


@query(f"""SELECT vec_id AS entity_id, round(least(greatest(0.5 * ((vec_id % 3) / 8.0 + 0) / 2 + 0.2 * least(abs(list_avg(e)), 1) + 0.2 * least(abs(list_stddev_pop(e) - 1), 1), 0), 1), 6) AS tensor FROM (SELECT vec_id, embedding::DOUBLE[] e FROM embeddings)""")
def drift_tensor(d: Dataset) -> DataFrame:
    """Against an expected 8 x 8 tensor of mean 0 and deviation 1; the actual first side is shortened for some."""
    s = d.tensors.select("entity_id", N.statistics(F.col("data")).alias("s"))
    actual = F.array((F.lit(8) - F.col("entity_id") % 3).cast("double"), F.lit(8.0))
    score = D.tensor(F.array(F.lit(8.0), F.lit(8.0)), actual, F.abs("s.mean"), F.abs(F.col("s.std") - 1), F.col("s.has_nan") | F.col("s.has_inf"))
    return s.select("entity_id", F.round(score, 6).alias("tensor"))


@query("""SELECT user_id AS entity_id, round(CASE WHEN user_id % 11 = 0 THEN 1.0 ELSE least(CASE WHEN count(*) = 0 THEN 0.5 ELSE 0 END + CASE WHEN gap > 86400 THEN 0.3 * least(gap / 86400.0 - 1, 1) ELSE 0 END, 1) END, 6) AS provenance
FROM (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts) OVER (PARTITION BY user_id))) / 1e6 AS gap FROM events) GROUP BY user_id, gap""")
def drift_provenance(d: Dataset) -> DataFrame:
    g = d.table("events").groupBy(F.col("user_id").alias("entity_id")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    gap = (F.unix_micros(F.lit("2024-01-31 00:00:00").cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    return g.select("entity_id", F.round(D.provenance(F.col("entity_id") % 11 != 0, F.col("n"), gap, F.lit(86400)), 6).alias("provenance"))


@query("""SELECT c_custkey AS entity_id, round(CASE WHEN c_custkey % 13 = 0 THEN 0.9 ELSE CASE WHEN m AND NOT p THEN 0.4 ELSE 0 END + CASE WHEN c_nationkey = 3 THEN 0.5 ELSE 0 END + CASE WHEN p AND NOT m THEN 0.1 ELSE 0 END END, 6) AS spatial
FROM (SELECT *, c_custkey % 2 = 0 AS m, c_custkey % 3 = 0 AS p FROM customer)""")
def drift_spatial(d: Dataset) -> DataFrame:
    k = F.col("c_custkey")
    return d.table("customer").select(k.alias("entity_id"), F.round(D.spatial(k % 13 != 0, k % 2 == 0, k % 3 == 0, F.col("c_nationkey") == 3), 6).alias("spatial"))


@query("""SELECT doc_id AS entity_id, round(0.5 * (l.doc_id IS NULL)::INT / 2 + 0.5 * ((lang NOT IN ('en', 'fr'))::INT + (n_chars > 5000)::INT) / 2, 6) AS "schema" FROM documents LEFT JOIN labels l USING (doc_id)""")
def drift_schema(d: Dataset) -> DataFrame:
    x = d.documents.join(d.semantic, "entity_id", "left")
    missing = F.col("quality").isNull().cast("int")
    broken = (~F.col("lang").isin("en", "fr")).cast("int") + (F.col("n_chars") > 5000).cast("int")
    return x.select("entity_id", F.round(D.schema(missing, F.lit(2), broken, F.lit(2)), 6).alias("schema"))


ALL = f"""(SELECT d.entity_id, coalesce(semantic_vector, 0) AS semantic_vector, graph_document, (entity_id * 7 % 50) / 100 AS temporal_consistency, (entity_id * 13 % 80) / 100 AS tensor, (entity_id * 17 % 30) / 100 AS "schema", (entity_id * 19 % 40) / 100 AS provenance, (entity_id * 23 % 60) / 100 AS spatial
FROM {GD} d LEFT JOIN {SV} s USING (entity_id))"""


def _scores(d: Dataset) -> DataFrame:
    """The seven scores; five of them made up from the id so that the formulas over them are exercised."""
    k = F.col("entity_id")
    x = _graph_document(d).join(_semantic_vector(d), "entity_id", "left")
    made = {"temporal_consistency": k * 7 % 50 / 100, "tensor": k * 13 % 80 / 100, "schema": k * 17 % 30 / 100, "provenance": k * 19 % 40 / 100, "spatial": k * 23 % 60 / 100}
    return x.select("entity_id", F.coalesce("semantic_vector", F.lit(0.0)).alias("semantic_vector"), "graph_document", *(c.alias(n) for n, c in made.items()))


W5 = "0.25 * semantic_vector + 0.25 * graph_document + 0.20 * temporal_consistency + 0.15 * tensor + 0.15 * \"schema\""
W7 = "0.20 * semantic_vector + 0.20 * graph_document + 0.15 * temporal_consistency + 0.10 * tensor + 0.10 * \"schema\" + 0.15 * provenance + 0.10 * spatial"


@query(f"SELECT entity_id, round({W5}, 6) AS quality, round({W7}, 6) AS quality_all FROM {ALL}")
def drift_quality(d: Dataset) -> DataFrame:
    return _scores(d).select("entity_id", F.round(D.weighted(D.QUALITY), 6).alias("quality"), F.round(D.weighted(D.QUALITY_ALL), 6).alias("quality_all"))


NAMES = list(D.QUALITY_ALL)
LIST = "[" + ", ".join(f"{{'s': (\"{n}\")::DOUBLE, 'o': {k}, 'n': '{n}'}}" for k, n in enumerate(NAMES)) + "]"


@query(f"SELECT entity_id, list_max({LIST}).n AS kind, round(list_max({LIST}).s, 6) AS score FROM {ALL}")
def drift_primary(d: Dataset) -> DataFrame:
    return _scores(d).select("entity_id", D.primary(NAMES).alias("kind"), F.round(F.greatest(*NAMES), 6).alias("score"))


SEVERITY = "CASE WHEN s > 0.9 THEN 'Emergency' WHEN s > 0.7 THEN 'Critical' WHEN s > 0.5 THEN 'Warning' ELSE 'Info' END"
SCORED = f"(SELECT entity_id, list_max({LIST}).n AS kind, list_max({LIST}).s AS s FROM {ALL})"
LIMITS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in D.THRESHOLDS.items()) + " END"


@query(f"SELECT entity_id, kind, {SEVERITY} AS severity, CASE WHEN s >= 0.7 THEN 'critical' WHEN s >= 0.3 THEN 'warning' ELSE 'healthy' END AS status FROM {SCORED}")
def drift_severity(d: Dataset) -> DataFrame:
    x = _scores(d).select("entity_id", D.primary(NAMES).alias("kind"), F.greatest(*NAMES).alias("s"))
    return x.select("entity_id", "kind", D.severity(F.col("s")).alias("severity"), D.entity_health(F.col("s")).alias("status"))


@query(f"SELECT entity_id, kind, printf('%s drift %.3f exceeds %.3f', kind, s, ({LIMITS})::DOUBLE) AS message FROM {SCORED} WHERE s > {LIMITS}")
def drift_alerts(d: Dataset) -> DataFrame:
    x = _scores(d).select("entity_id", D.primary(NAMES).alias("kind"), F.greatest(*NAMES).alias("score"))
    return K.alerts(x, D.threshold(F.col("kind"))).select("entity_id", "kind", "message")


@query(f"""SELECT kind, count(*) AS n, round(avg(s), 6) AS mean, round(max(s), 6) AS worst, CASE WHEN max(s) > 0.9 THEN 'Critical' WHEN max(s) > 0.7 THEN 'Degraded' WHEN max(s) > 0.5 THEN 'Warning' ELSE 'Healthy' END AS health,
CASE WHEN max(s) >= 0.8 THEN 'critical' WHEN max(s) >= 0.5 THEN 'degraded' WHEN max(s) >= 0.3 THEN 'warning' ELSE 'healthy' END AS monitor FROM {SCORED} GROUP BY 1""")
def drift_health(d: Dataset) -> DataFrame:
    x = _scores(d).select(D.primary(NAMES).alias("kind"), F.greatest(*NAMES).alias("s"))
    worst = F.max("s")
    return x.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("mean"), F.round(worst, 6).alias("worst"), D.health(worst).alias("health"), D.monitor_health(worst).alias("monitor"))


MON = "CASE WHEN s >= CASE kind " + " ".join(f"WHEN '{k}' THEN {v[1]}" for k, v in D.MONITOR.items()) + " ELSE 0.8 END THEN 'critical' WHEN s >= CASE kind " + " ".join(f"WHEN '{k}' THEN {v[0]}" for k, v in D.MONITOR.items()) + " ELSE 0.5 END THEN 'warning' ELSE 'ok' END"


@query(f"SELECT kind, {MON} AS level, count(*) AS n FROM {SCORED} GROUP BY 1, 2")
def drift_monitor_levels(d: Dataset) -> DataFrame:
    x = _scores(d).select(D.primary(NAMES).alias("kind"), F.greatest(*NAMES).alias("s"))
    return x.select("kind", D.monitor_level(F.col("kind"), F.col("s")).alias("level")).groupBy("kind", "level").agg(F.count("*").alias("n"))


@query(f"SELECT kind, round(({LIMITS})::DOUBLE + avg(s) * 0.1, 6) AS adapted FROM {SCORED} GROUP BY kind")
def adaptive_thresholds(d: Dataset) -> DataFrame:
    """The fixed threshold plus a tenth of the kind's mean score."""
    x = _scores(d).select(D.primary(NAMES).alias("kind"), F.greatest(*NAMES).alias("s")).groupBy("kind").agg(F.avg("s").alias("m"))
    return x.select("kind", F.round(D.threshold(F.col("kind")) + F.col("m") * 0.1, 6).alias("adapted"))


def _stream(d: Dataset) -> DataFrame:
    """Events as drift scores of five kinds."""
    return d.table("events").select(F.col("event_type").alias("kind"), "ts", F.col("event_id").alias("seq"), (F.col("value") % 1).alias("score"))


SCORES = "(SELECT event_type AS kind, ts, event_id AS seq, value % 1 AS score FROM events)"


@query(f"SELECT kind, round(list_reduce(list_prepend(0.0::DOUBLE, list(score ORDER BY ts, seq)), lambda s, x: s * 0.9 + x * 0.1), 6) AS average, round(max(score), 6) AS highest, count(*) AS n FROM {SCORES} GROUP BY 1")
def ewma_metrics(d: Dataset) -> DataFrame:
    return K.batch_metrics(_stream(d)).select("kind", F.round("average", 6).alias("average"), F.round("highest", 6).alias("highest"), "n")


@query(f"SELECT kind, round(list_reduce(list(score ORDER BY ts, seq), lambda s, x: s * 0.9 + x * 0.1), 6) AS average FROM {SCORES} GROUP BY 1")
def ewma_seeded(d: Dataset) -> DataFrame:
    return K.ewma(_stream(d), "kind", first_seeds=True).select("kind", F.round("average", 6).alias("average"))


@query(f"SELECT kind, round(avg(score) FILTER (r <= 10) - avg(score) FILTER (r > 10), 6) AS trend FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY ts DESC, seq DESC) r FROM {SCORES}) WHERE r <= 20 GROUP BY 1")
def drift_trend(d: Dataset) -> DataFrame:
    return K.trend(_stream(d)).select("kind", F.round("trend", 6).alias("trend"))


@query("SELECT user_id AS entity_id, event_type AS kind, round(arg_max(value % 1, (ts, event_id)), 6) AS last FROM events GROUP BY 1, 2")
def last_scores(d: Dataset) -> DataFrame:
    e = d.table("events").groupBy(F.col("user_id").alias("entity_id"), F.col("event_type").alias("kind"))
    return e.agg(F.round(F.max_by(F.col("value") % 1, F.struct("ts", "event_id")), 6).alias("last"))


@query("""WITH c AS (SELECT user_id AS store_id, event_id AS seq, value >= 20 AS ok FROM events), r AS (SELECT store_id, ok, sum(ok::INT) OVER (PARTITION BY store_id ORDER BY seq) AS run FROM c),
g AS (SELECT store_id, run, count(*) n FROM r WHERE NOT ok GROUP BY 1, 2) SELECT s.store_id, coalesce(sum(n // 5), 0)::BIGINT AS opened FROM (SELECT DISTINCT store_id FROM c) s LEFT JOIN g USING (store_id) GROUP BY 1""")
def breaker_openings(d: Dataset) -> DataFrame:
    return K.breaker_states(d.table("events").select(F.col("user_id").alias("store_id"), F.col("event_id").alias("seq"), (F.col("value") >= 20).alias("ok")))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def window_tumbling(d: Dataset) -> DataFrame:
    x = X.tumbling(d.table("events"), "1 hour")
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT start, count(*) AS n, round(max(value), 6) AS highest FROM (SELECT value, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1")
def window_sliding(d: Dataset) -> DataFrame:
    x = X.sliding(d.table("events"), "2 hours", "1 hour")
    return x.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("highest", 6).alias("highest"))


@query("""WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 4 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def window_sessions(d: Dataset) -> DataFrame:
    x = X.sessions(d.table("events"), "4 hours")
    return x.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT user_id, event_type, count(DISTINCT date_trunc('day', ts)) AS days FROM events GROUP BY 1, 2")
def window_deduplicated(d: Dataset) -> DataFrame:
    x = d.table("events").withColumn("day", F.date_trunc("day", "ts"))
    return X.deduplicated(x, ["user_id", "event_type", "day"], "1 day").groupBy("user_id", "event_type").agg(F.count("*").alias("days"))


@query("SELECT date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS lowest, round(max(value), 6) AS highest, round(avg(count(*)) OVER (ORDER BY date_trunc('day', ts) ROWS 6 PRECEDING), 6) AS week_mean FROM events GROUP BY 1")
def telemetry_daily(d: Dataset) -> DataFrame:
    g = d.table("events").groupBy(F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 6).alias("lowest"), F.round(F.max("value"), 6).alias("highest"))
    return g.withColumn("week_mean", F.round(F.avg("n").over(W.orderBy("day").rowsBetween(-6, 0)), 6))
