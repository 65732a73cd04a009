"""Entity, predicate and aggregation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..model import Dataset
from ..operators import entities as O
from ..operators import search as S
from .registry import query

WIDE = "(SELECT d.*, substr(text, 1, 40) AS title, e.embedding::DOUBLE[] AS e, e.label, l.quality, l.toxic FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@query("""SELECT d.doc_id AS entity_id, substr(d.text, 1, 40) AS title, round(list_cosine_similarity(e.embedding::DOUBLE[], q.e), 6) AS score
FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id, (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) q
WHERE list_cosine_similarity(e.embedding::DOUBLE[], q.e) >= 0.0 ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], q.e) DESC, 1 LIMIT 10""")
def similar_entities(d: Dataset) -> DataFrame:
    """Documents with a vector, most similar first: the similarity is ranked before documents are joined."""
    hits = S.similar(d.vectors, S.vector_of(d.vectors, 0), 0.0).select("entity_id", "score")
    return d.documents.join(hits, "entity_id").orderBy(F.desc("score"), "entity_id").limit(10).select("entity_id", "title", F.round("score", 6).alias("score"))


@query("SELECT doc_id AS entity_id, substr(text, 1, 40) AS title, lang FROM documents WHERE doc_id = 7")
def point_lookup(d: Dataset) -> DataFrame:
    return O.point(d.documents, 7).select("entity_id", "title", "lang")


@query("SELECT doc_id AS entity_id, lang FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")
def listing(d: Dataset) -> DataFrame:
    return O.page(d.documents.select("entity_id", "lang"), 25, 50)


@query(f"""SELECT w.doc_id AS entity_id, title, lang, label, quality, coalesce(v.n, 0) AS version_count FROM {WIDE} w LEFT JOIN (SELECT user_id, count(*) n FROM events GROUP BY 1) v ON w.doc_id = v.user_id""")
def assemble_entity(d: Dataset) -> DataFrame:
    w = O.assemble(d)
    return w.select("entity_id", "document.title", "document.lang", "vector.label", "semantic.quality", "version_count")


@query(f"""SELECT doc_id AS entity_id, true AS document, e IS NOT NULL AS vector, quality IS NOT NULL AS semantic, doc_id IN (SELECT user_id FROM events) AS temporal FROM {WIDE}""")
def status_flags(d: Dataset) -> DataFrame:
    w = O.assemble(d)
    return w.select("entity_id", *(O.presence(m).alias(m) for m in ("document", "vector", "semantic")), (F.col("version_count") > 0).alias("temporal"))


@query(f"""SELECT doc_id AS entity_id, CASE WHEN e IS NULL THEN 'vector,' ELSE '' END || CASE WHEN quality IS NULL THEN 'semantic,' ELSE '' END AS missing FROM {WIDE}""")
def missing_modalities(d: Dataset) -> DataFrame:
    w = O.assemble(d)
    return w.select("entity_id", F.concat(*(F.when(O.presence(m), "").otherwise(f"{m},") for m in ("vector", "semantic"))).alias("missing"))


@query(f"SELECT doc_id AS entity_id, lang AS \"document.lang\", label AS \"vector.label\" FROM {WIDE} WHERE e IS NOT NULL")
def project_fields(d: Dataset) -> DataFrame:
    w = O.select_slots(O.assemble(d), ["DOCUMENT", "VECTOR", "document"])
    return O.project(w.where(O.presence("vector")), "document.lang", "vector.label")


@query("SELECT doc_id AS entity_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def modality_exists(d: Dataset) -> DataFrame:
    return d.documents.join(d.semantic, "entity_id", "left_semi").select("entity_id")


@query("SELECT doc_id AS entity_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def modality_not_exists(d: Dataset) -> DataFrame:
    return d.documents.join(d.semantic, "entity_id", "left_anti").select("entity_id")


@query(f"SELECT doc_id AS entity_id FROM {WIDE} WHERE coalesce(label > quality, false)")
def field_compare(d: Dataset) -> DataFrame:
    w = O.assemble(d)
    return w.where(O.compare(F.col("vector.label"), ">", F.col("semantic.quality"))).select("entity_id")


@query(f"SELECT doc_id AS entity_id FROM {WIDE} WHERE (lang = 'de' OR coalesce(label < 3, false)) AND NOT (coalesce(toxic = 1, false))")
def boolean_predicates(d: Dataset) -> DataFrame:
    w = O.assemble(d)
    keep = ((F.col("document.lang") == "de") | O.compare(F.col("vector.label"), "<", F.lit(3))) & ~O.compare(F.col("semantic.toxic"), "==", F.lit(1))
    return w.where(keep).select("entity_id")


@query("SELECT doc_id AS entity_id, lang, n_chars FROM documents ORDER BY lang NULLS LAST, n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 5")
def order_offset_limit(d: Dataset) -> DataFrame:
    return O.page(d.documents.select("entity_id", "lang", "n_chars"), 20, 5, (F.asc_nulls_last("lang"), F.desc_nulls_last("n_chars"), F.asc("entity_id")))


FP = "list_transform(range(0, least(4, ceil(n / greatest(n // 4, 1))::BIGINT)), lambda i: list_sum(list_transform(range(i * greatest(n // 4, 1), least((i + 1) * greatest(n // 4, 1), n)), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::INT)) / (least((i + 1) * greatest(n // 4, 1), n) - i * greatest(n // 4, 1)) / 255)"


@query(f"""SELECT entity_id, array_to_string(list_transform({FP}, lambda x: printf('%.6f', x)), ',') AS fingerprint FROM (SELECT doc_id AS entity_id, hex(encode(text)) AS h, (length(hex(encode(text))) // 2) AS n FROM documents WHERE length(text) > 0)""")
def content_fingerprint(d: Dataset) -> DataFrame:
    f = V.byte_fingerprint(F.col("body"))
    return d.documents.where(F.length("body") > 0).select("entity_id", F.array_join(F.transform(f, lambda x: F.format_string("%.6f", x)), ",").alias("fingerprint"))


PAIR = "(SELECT d.doc_id AS entity_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM documents d LEFT JOIN embeddings a ON d.doc_id = a.vec_id LEFT JOIN embeddings b ON b.vec_id = d.doc_id + 1)"


def _pairs(d: Dataset) -> DataFrame:
    v = d.vectors.select("entity_id", F.col("embedding").alias("a"))
    n = d.vectors.select((F.col("entity_id") - 1).alias("entity_id"), F.col("embedding").alias("b"))
    return d.documents.select("entity_id").join(v, "entity_id", "left").join(n, "entity_id", "left")


@query(f"SELECT entity_id, round(CASE WHEN a IS NULL OR b IS NULL THEN 1.0 ELSE least(greatest(1 - list_cosine_similarity(a, b), 0), 1) END, 6) AS drift FROM {PAIR}")
def drift_pair(d: Dataset) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(d).select("entity_id", F.round(F.when(a.isNull() | b.isNull(), 1.0).otherwise(V.cosine_drift(a, b)), 6).alias("drift"))


@query(f"""SELECT entity_id, round(coalesce(greatest(list_cosine_similarity(a, b), 0), 0), 6) AS cosine, round(coalesce(1 / (1 + list_distance(a, b)), 0), 6) AS euclidean, round(coalesce(1 / (1 + exp(-list_dot_product(a, b))), 0), 6) AS dot_product FROM {PAIR}""")
def consistency_scores(d: Dataset) -> DataFrame:
    return _pairs(d).select("entity_id", *(F.round(V.consistency(m, F.col("a"), F.col("b")), 6).alias(m) for m in ("cosine", "euclidean", "dot_product")))


@query("""SELECT a.event_id AS entity_id, round(len(list_intersect(json_keys(a.props), json_keys(b.props))) / len(list_distinct(list_concat(json_keys(a.props), json_keys(b.props)))), 6) AS jaccard FROM events a JOIN events b ON b.event_id = a.event_id + 1""")
def consistency_jaccard(d: Dataset) -> DataFrame:
    keys = d.table("events").select("event_id", F.json_object_keys("props").alias("keys"))
    after = keys.select((F.col("event_id") - 1).alias("event_id"), F.col("keys").alias("others"))
    return keys.join(after, "event_id").select(F.col("event_id").alias("entity_id"), F.round(V.jaccard(F.col("keys"), F.col("others")), 6).alias("jaccard"))


@query("SELECT source AS \"document.source\", lang AS \"document.lang\", count(*) AS \"COUNT(*)\", count(n_chars) AS \"COUNT(document.n_chars)\", sum(n_chars)::BIGINT AS \"SUM(document.n_chars)\", round(avg(n_chars), 6) AS \"AVG(document.n_chars)\", min(n_chars) AS \"MIN(document.n_chars)\", max(n_chars) AS \"MAX(document.n_chars)\" FROM documents GROUP BY source, lang HAVING count(*) >= 10")
def group_having(d: Dataset) -> DataFrame:
    n = F.col("n_chars")
    aggs = [F.count("*").alias("COUNT(*)"), F.count(n).alias("COUNT(document.n_chars)"), F.sum(n).alias("SUM(document.n_chars)"), F.round(F.avg(n), 6).alias("AVG(document.n_chars)"), F.min(n).alias("MIN(document.n_chars)"), F.max(n).alias("MAX(document.n_chars)")]
    return d.documents.groupBy(F.col("source").alias("document.source"), F.col("lang").alias("document.lang")).agg(*aggs).where(F.col("`COUNT(*)`") >= 10)


@query("SELECT count(*) AS n, count(DISTINCT lang) AS langs, round(avg(n_chars), 6) AS mean_chars FROM documents")
def global_aggregate(d: Dataset) -> DataFrame:
    return d.documents.agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("""WITH log AS (SELECT user_id AS entity_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, round(value, 6) AS payload FROM events)
SELECT entity_id, seq, payload FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY seq DESC) r FROM log) WHERE r = 1 AND op <> 'delete'""")
def latest_without_deleted(d: Dataset) -> DataFrame:
    """Inserts, updates and deletes as an append-only log, read as the current state."""
    e = d.table("events")
    log = e.select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), F.round("value", 6).alias("payload"))
    return O.current(log).select("entity_id", "seq", "payload")


@query("""WITH last AS (SELECT user_id AS entity_id, count(*) AS version FROM events GROUP BY 1) SELECT l.doc_id AS entity_id, coalesce(version, 0) + 1 AS version, quality FROM labels l LEFT JOIN last ON last.entity_id = l.doc_id""")
def update_versions(d: Dataset) -> DataFrame:
    last = d.table("events").groupBy(F.col("user_id").alias("entity_id")).agg(F.count("*").alias("version"))
    return O.append_version(last, d.semantic.select("entity_id", "quality")).select("entity_id", "version", "quality")


@query("SELECT event_id AS seq, event_type FROM events WHERE event_id >= (SELECT max(event_id) FROM events WHERE event_type = 'signup' AND event_id < 9000) ORDER BY event_id")
def replay_from_checkpoint(d: Dataset) -> DataFrame:
    """The change log from its last checkpoint (here: a signup) before a sequence number."""
    e = d.table("events").select(F.col("event_id").alias("seq"), "event_type")
    mark = e.where("event_type = 'signup' and seq < 9000").agg(F.max("seq").alias("mark"))
    return e.join(F.broadcast(mark), F.col("seq") >= F.col("mark")).select("seq", "event_type").orderBy("seq")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def prefix_scan(d: Dataset) -> DataFrame:
    return d.table("customer").where(F.col("c_name").startswith("Customer#00000001")).select("c_custkey", "c_name")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (3, 5, 8, 13, 21)")
def multi_get(d: Dataset) -> DataFrame:
    return d.table("customer").where(F.col("c_custkey").isin(3, 5, 8, 13, 21)).select("c_custkey", "c_mktsegment")


@query("SELECT 'query-' || doc_id AS query_id, 'reflect' AS _source, 'query' AS _type FROM documents ORDER BY doc_id LIMIT 20")
def reflect_listing(d: Dataset) -> DataFrame:
    """Stored queries are entities too: listed with their source and type."""
    ids = d.documents.orderBy("entity_id").limit(20)
    return ids.select(F.concat(F.lit("query-"), F.col("entity_id").cast("string")).alias("query_id"), F.lit("reflect").alias("_source"), F.lit("query").alias("_type"))


@query("SELECT 'documents' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'labels', count(*) FROM labels")
def show_status(d: Dataset) -> DataFrame:
    one = lambda t: d.table(t).agg(F.count("*").alias("n")).select(F.lit(t).alias("kind"), "n")
    return one("documents").unionByName(one("embeddings")).unionByName(one("events")).unionByName(one("labels"))


SEV = "CASE WHEN quality IS NULL THEN 'Low' WHEN toxic = 1 THEN 'Critical' WHEN quality = 0 THEN 'High' ELSE 'Medium' END"
POINTS = f"(SELECT d.doc_id, d.source AS repo, d.lang AS category, {SEV} AS severity, d.n_chars FROM documents d LEFT JOIN labels l USING (doc_id))"


def _points(d: Dataset) -> DataFrame:
    """Weak points of a scan: here documents by language, with a severity out of their labels."""
    sev = F.when(F.col("quality").isNull(), "Low").when(F.col("toxic") == 1, "Critical").when(F.col("quality") == 0, "High").otherwise("Medium")
    return d.documents.join(d.semantic, "entity_id", "left").select("entity_id", F.col("source").alias("repo"), F.col("lang").alias("category"), sev.alias("severity"), "n_chars")


@query(f"SELECT severity, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM {POINTS} GROUP BY severity")
def severity_distribution(d: Dataset) -> DataFrame:
    g = _points(d).groupBy("severity").agg(F.count("*").alias("n"))
    return g.select("severity", "n", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("percent"))


@query(f"SELECT category, count(*) AS n FROM {POINTS} GROUP BY category ORDER BY n DESC, category LIMIT 3")
def top_categories(d: Dataset) -> DataFrame:
    return _points(d).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(3)


@query(f"SELECT category || ':' || severity AS pattern, count(DISTINCT repo) AS repos, string_agg(DISTINCT repo, ',' ORDER BY repo) AS names FROM {POINTS} GROUP BY category, severity HAVING count(DISTINCT repo) >= 3")
def cross_repo_patterns(d: Dataset) -> DataFrame:
    g = _points(d).select(F.concat_ws(":", "category", "severity").alias("pattern"), "repo").distinct()
    return g.groupBy("pattern").agg(F.count("*").alias("repos"), F.array_join(F.array_sort(F.collect_set("repo")), ",").alias("names")).where("repos >= 3")


@query(f"SELECT repo, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM {POINTS} GROUP BY repo ORDER BY n DESC, repo LIMIT 50")
def hotspots(d: Dataset) -> DataFrame:
    g = _points(d).groupBy("repo").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))
    return g.orderBy(F.desc("n"), "repo").limit(50)


@query("SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, count(*) - lag(count(*)) OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts)) AS delta FROM events WHERE event_type = 'error' GROUP BY 1, 2")
def trends(d: Dataset) -> DataFrame:
    g = d.table("events").where("event_type = 'error'").groupBy("user_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))
    return g.withColumn("delta", F.col("n") - F.lag("n").over(W.partitionBy("user_id").orderBy("day")))


@query(f"SELECT repo, count(*) AS n FROM {POINTS} WHERE severity = 'Critical' GROUP BY repo HAVING count(*) > 0")
def repos_by_severity(d: Dataset) -> DataFrame:
    return _points(d).where("severity = 'Critical'").groupBy("repo").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS scans, count(DISTINCT source) AS repos, round(avg(n_chars), 1) AS mean_size, max(doc_id) AS last_scan FROM documents")
def pipeline_health(d: Dataset) -> DataFrame:
    return d.documents.agg(F.count("*").alias("scans"), F.countDistinct("source").alias("repos"), F.round(F.avg("n_chars"), 1).alias("mean_size"), F.max("entity_id").alias("last_scan"))


@query("""SELECT event_type AS strategy, count(*) AS n, sum((value >= 50)::INT)::BIGINT AS succeeded, round(avg((value >= 50)::INT), 6) AS rate,
CASE WHEN avg((value >= 50)::INT) > 0.5 THEN 'improving' WHEN avg((value >= 50)::INT) > 0.3 THEN 'stable' ELSE 'regressing' END AS feedback FROM events GROUP BY 1""")
def dispatch_summary(d: Dataset) -> DataFrame:
    ok = (F.col("value") >= 50).cast("int")
    g = d.table("events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("n"), F.sum(ok).alias("succeeded"), F.avg(ok).alias("r"))
    word = F.when(F.col("r") > 0.5, "improving").when(F.col("r") > 0.3, "stable").otherwise("regressing")
    return g.select("strategy", "n", "succeeded", F.round("r", 6).alias("rate"), word.alias("feedback"))


@query("""SELECT date_trunc('hour', ts) AS hour, count(*) AS n, sum((event_type = 'error')::INT)::BIGINT AS errors, round(avg((event_type = 'error')::INT), 6) AS rate, avg((event_type = 'error')::INT) > 0.3 AS over_budget FROM events GROUP BY 1""")
def error_budget_hourly(d: Dataset) -> DataFrame:
    bad = (F.col("event_type") == "error").cast("int")
    g = d.table("events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"), F.sum(bad).alias("errors"), F.avg(bad).alias("r"))
    return g.select("hour", "n", "errors", F.round("r", 6).alias("rate"), (F.col("r") > 0.3).alias("over_budget"))


@query("SELECT event_type AS modality, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM events GROUP BY 1")
def modality_heatmap(d: Dataset) -> DataFrame:
    g = d.table("events").groupBy(F.col("event_type").alias("modality")).agg(F.count("*").alias("n"))
    return g.select("modality", "n", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("percent"))


@query("SELECT event_type AS status, date_trunc('day', ts) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def status_by_day(d: Dataset) -> DataFrame:
    return d.table("events").groupBy(F.col("event_type").alias("status"), F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


@query("SELECT d.lang AS entity_type, count(*) AS n, round(avg(1 - l.quality), 6) AS mean_drift FROM documents d JOIN labels l USING (doc_id) GROUP BY 1")
def drift_by_type(d: Dataset) -> DataFrame:
    return d.documents.join(d.semantic, "entity_id").groupBy(F.col("lang").alias("entity_type")).agg(F.count("*").alias("n"), F.round(F.avg(1 - F.col("quality")), 6).alias("mean_drift"))


@query("""SELECT count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS slowest, round(min(value), 6) AS fastest,
(SELECT event_type FROM events WHERE value > 100 GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1) AS bottleneck FROM events WHERE value > 100""")
def slow_query_summary(d: Dataset) -> DataFrame:
    g = d.table("events").where("value > 100").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.max("value").alias("hi"), F.min("value").alias("lo"))
    most = F.max(F.struct("n", F.struct((-F.ascii("event_type")).alias("a")), "event_type"))["event_type"]
    return g.agg(F.sum("n").alias("n"), F.round(F.sum("s") / F.sum("n"), 6).alias("mean"), F.round(F.max("hi"), 6).alias("slowest"), F.round(F.min("lo"), 6).alias("fastest"), most.alias("bottleneck"))


@query("""SELECT user_id % 10 AS pattern, min_by(event_type, (m, event_type)) AS best_plan, round(min(m), 6) AS best_mean, round(sum(hits) / sum(n), 6) AS hit_rate
FROM (SELECT user_id, event_type, avg(value) m, count(*) n, sum((value < 50)::INT) hits FROM events GROUP BY 1, 2) GROUP BY 1""".replace("SELECT user_id, event_type, avg", "SELECT user_id % 10 AS user_id, event_type, avg").replace("user_id % 10 AS pattern", "user_id AS pattern"))
def adaptive_plans(d: Dataset) -> DataFrame:
    g = d.table("events").groupBy((F.col("user_id") % 10).alias("pattern"), "event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"), F.sum((F.col("value") < 50).cast("int")).alias("hits"))
    return g.groupBy("pattern").agg(F.min_by("event_type", F.struct("m", "event_type")).alias("best_plan"), F.round(F.min("m"), 6).alias("best_mean"), F.round(F.sum("hits") / F.sum("n"), 6).alias("hit_rate"))
