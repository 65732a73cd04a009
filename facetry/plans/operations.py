"""Repair plans, stored proofs, predicates of the query surface, and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as X
from ..functions import vectors as V
from ..model import Dataset
from ..operators import entities as O
from ..operators import federation as J
from ..operators import normalize as M
from ..operators import proofs as P
from ..operators import provenance as R
from ..operators import search as S
from ..operators import temporal as T
from .evidence import REC
from .graph import V as VERSIONS
from .registry import query

WIDE = "(SELECT d.doc_id AS entity_id, d.text, e.vec_id, l.doc_id AS lab, coalesce(v.n, 0) AS n FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN (SELECT user_id, count(*) n FROM events GROUP BY 1) v ON v.user_id = d.doc_id)"


@query(f"""SELECT entity_id, 'document(title=''' || substr(text, 1, 40) || ''', body_len=' || strlen(text) || ')' AS document, CASE WHEN vec_id IS NOT NULL THEN 'vector(dim=64)' END AS vector,
CASE WHEN vec_id IS NOT NULL THEN 'tensor(shape=[8, 8], len=64)' END AS tensor, CASE WHEN n > 0 THEN 'temporal(versions=' || n || ')' END AS temporal FROM {WIDE}""")
def modality_summaries(d: Dataset) -> DataFrame:
    w = O.assemble(d)
    return w.select("entity_id", *(M.summary(m).alias(m) for m in ("document", "vector", "tensor", "temporal")))


REPAIR = f"""SELECT entity_id, 'vector' AS modality, 'embedding' AS field, 'regenerate from document' AS change FROM {WIDE}
UNION ALL SELECT entity_id, 'vector', 'embedding_context', 'incorporate semantic types' FROM {WIDE} WHERE lab IS NOT NULL"""
TENSOR = f"""SELECT entity_id, 'tensor' AS modality, 'data' AS field, 'reshape embedding' AS change FROM {WIDE} WHERE vec_id IS NOT NULL
UNION ALL SELECT entity_id, 'tensor', 'features', 'weight terms of document' FROM {WIDE}"""


@query(REPAIR)
def vector_repairs(d: Dataset) -> DataFrame:
    return M.vector_repairs(O.assemble(d))


@query(TENSOR)
def tensor_repairs(d: Dataset) -> DataFrame:
    return M.tensor_repairs(O.assemble(d))


@query(f"SELECT modality, field, count(*) AS n FROM ({REPAIR} UNION ALL {TENSOR}) GROUP BY 1, 2")
def quality_repairs(d: Dataset) -> DataFrame:
    """All repairs that a drop in overall quality sets off, counted."""
    w = O.assemble(d)
    return M.vector_repairs(w).unionByName(M.tensor_repairs(w)).groupBy("modality", "field").agg(F.count("*").alias("n"))


@query("""SELECT user_id AS entity_id, count(*) AS queued, sum((event_type = 'purchase')::INT)::BIGINT AS resolved, sum((event_type <> 'purchase')::INT)::BIGINT AS pending FROM events WHERE value > 60 GROUP BY 1""")
def repair_queue(d: Dataset) -> DataFrame:
    """Repairs left to a user: queued and resolved by event."""
    done = (F.col("event_type") == "purchase").cast("int")
    return d.table("events").where("value > 60").groupBy(F.col("user_id").alias("entity_id")).agg(F.count("*").alias("queued"), F.sum(done).alias("resolved"), F.sum(1 - done).alias("pending"))


@query("""SELECT user_id AS entity_id, event_id, CASE WHEN value % 1 >= 0.8 THEN 'manual' WHEN event_type = 'click' THEN 'document' ELSE 'vector' END AS winner,
row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events WHERE event_type IN ('click', 'view')""")
def conflict_history(d: Dataset) -> DataFrame:
    """Conflicts of an entity in order, resolved by the last modality listed."""
    e = d.table("events").where(F.col("event_type").isin("click", "view"))
    listed = F.when(F.col("event_type") == "click", F.array(F.lit("vector"), F.lit("document"))).otherwise(F.array(F.lit("document"), F.lit("vector")))
    x = e.select(F.col("user_id").alias("entity_id"), "event_id", M.resolve("lww", listed, F.col("value") % 1).alias("winner"))
    return T.number_versions(x, "entity_id", "event_id", "winner").withColumnRenamed("version", "nth")


@query("""WITH p AS (SELECT doc_id, coalesce(text, '') AS claim, CASE doc_id % 4 WHEN 0 THEN 'commitment' WHEN 1 THEN 'reveal' WHEN 2 THEN 'integrity' ELSE 'derivation' END AS kind, doc_id % 3 = 0 AS bad FROM documents),
g AS (SELECT *, CASE kind WHEN 'integrity' THEN sha256(CASE WHEN bad THEN claim || '!' ELSE claim END) WHEN 'reveal' THEN CASE WHEN bad THEN sha256('no') ELSE sha256(claim || doc_id) END WHEN 'derivation' THEN CASE WHEN bad THEN '' ELSE 'x' END END AS digest FROM p)
SELECT doc_id AS entity_id, kind, CASE kind WHEN 'commitment' THEN true WHEN 'reveal' THEN digest = sha256(claim || doc_id) WHEN 'integrity' THEN digest = sha256(claim) ELSE length(digest) > 0 END AS valid FROM g""")
def stored_proofs(d: Dataset) -> DataFrame:
    """Four kinds of proofs of the whole texts; every third reveal is false, every third integrity proof is of another text, every third derivation empty."""
    k, claim, secret = F.col("entity_id"), F.coalesce("body", F.lit("")), F.col("entity_id").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("commitment", "reveal", "integrity", "derivation"))), (k % 4 + 1).cast("int"))
    held = F.when(k % 3 == 0, F.concat(claim, F.lit("!"))).otherwise(claim)
    good = F.when(kind == "integrity", F.sha2(held, 256)).otherwise(F.sha2(F.concat(claim, secret), 256))
    digest = F.when((k % 3 == 0) & (kind == "reveal"), F.sha2(F.lit("no"), 256)).when((k % 3 == 0) & (kind == "derivation"), "").otherwise(good)
    return d.documents.select(k, kind.alias("kind"), P.verify(kind, claim, secret, digest).alias("valid"))


@query("""WITH k AS (SELECT o_custkey AS circuit, o_orderkey AS seq, 'key-' || o_orderkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders)
SELECT circuit, count(*) AS version, max(key) FILTER (r = 1) AS active, max(key) FILTER (r = 2) AS previous, sha256(max(key) FILTER (r = 1)) AS fingerprint FROM k GROUP BY 1""")
def key_rotation(d: Dataset) -> DataFrame:
    k = d.table("orders").select(F.col("o_custkey").alias("circuit"), F.col("o_orderkey").alias("seq"), F.concat(F.lit("key-"), F.col("o_orderkey").cast("string")).alias("key"))
    return P.key_store(k)


@query("""SELECT 'document' AS route, count(*) AS n FROM documents WHERE contains(text, 'the') UNION ALL SELECT 'vector', count(*) FROM embeddings WHERE label = 1 UNION ALL SELECT 'provenance', count(*) FROM events WHERE user_id % 7 = 3""")
def store_routes(d: Dataset) -> DataFrame:
    """One condition, sent to the one modality that answers it."""
    n = F.count("*").alias("n")
    routes = {"document": d.documents.where(F.col("body").contains("the")), "vector": d.vectors.where("label = 1"), "provenance": d.provenance.where("actor = 'user3'")}
    return J.union([df.agg(n).select(F.lit(k).alias("route"), "n") for k, df in routes.items()])


PAIR = "(SELECT d.doc_id AS entity_id, a.embedding::DOUBLE[] AS a, b.embedding::DOUBLE[] AS b FROM documents d LEFT JOIN embeddings a ON a.vec_id = d.doc_id LEFT JOIN embeddings b ON b.vec_id = d.doc_id + 1)"


@query(f"SELECT entity_id FROM {PAIR} WHERE CASE WHEN a IS NULL OR b IS NULL THEN 1.0 ELSE least(greatest(1 - list_cosine_similarity(a, b), 0), 1) END < 0.9")
def drift_predicate(d: Dataset) -> DataFrame:
    """DRIFT(a, b) < 0.9; a missing vector drifts by 1."""
    v = d.vectors.select("entity_id", F.col("embedding").alias("a"))
    n = d.vectors.select((F.col("entity_id") - 1).alias("entity_id"), F.col("embedding").alias("b"))
    drift = F.when(F.col("a").isNull() | F.col("b").isNull(), 1.0).otherwise(V.cosine_drift(F.col("a"), F.col("b")))
    x = d.documents.select("entity_id").join(v, "entity_id", "left").join(n, "entity_id", "left")
    return x.where(O.compare(drift, "<", F.lit(0.9))).select("entity_id")


@query(f"SELECT entity_id FROM {PAIR} WHERE coalesce(1 / (1 + list_distance(a, b)), 0) > 0.05")
def consistent_predicate(d: Dataset) -> DataFrame:
    """CONSISTENT(a, b) USING EUCLIDEAN over a threshold."""
    v = d.vectors.select("entity_id", F.col("embedding").alias("a"))
    n = d.vectors.select((F.col("entity_id") - 1).alias("entity_id"), F.col("embedding").alias("b"))
    x = d.documents.select("entity_id").join(v, "entity_id", "left").join(n, "entity_id", "left")
    return x.where(V.consistency("euclidean", F.col("a"), F.col("b")) > 0.05).select("entity_id")


@query(f"SELECT entity_id, count(*) AS changes FROM {VERSIONS} WHERE message = 'purchase' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY 1")
def modified_by(d: Dataset) -> DataFrame:
    """Versions between two times by one kind of author."""
    v = d.versions.where("message = 'purchase' and ts between timestamp_ntz'2024-01-05 00:00:00' and timestamp_ntz'2024-01-25 00:00:00'")
    return v.groupBy("entity_id").agg(F.count("*").alias("changes"))


@query(f"SELECT entity_id, max(seq) AS length FROM {REC} GROUP BY 1 HAVING max(seq) > 60 AND arg_min(event_type, seq) = 'created'")
def provenance_predicates(d: Dataset) -> DataFrame:
    """Valid chains of over 60 records that begin with a creation."""
    chain = R.append(d.provenance)
    first = chain.groupBy("entity_id").agg(F.min_by("event_type", "seq").alias("origin"))
    return R.verify(chain).where("chain_valid and length > 60").join(first.where("origin = 'created'"), "entity_id").select("entity_id", "length")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 5), d AS (SELECT doc_id FROM documents WHERE contains(text, 'License'))
SELECT vec_id AS entity_id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE vec_id IN (SELECT doc_id FROM d) ORDER BY list_cosine_similarity(embedding::DOUBLE[], q) DESC, vec_id LIMIT 5""")
def filtered_knn(d: Dataset) -> DataFrame:
    """Nearest vectors among the entities that a text condition leaves."""
    hits = d.documents.where(F.col("body").contains("License")).select("entity_id")
    return S.knn(d.vectors.join(hits, "entity_id", "left_semi"), S.vector_of(d.vectors, 5), 5).select("entity_id", F.round("score", 6).alias("score"))


@query("SELECT event_type AS pattern, count(*) AS n, round(100.0 * sum((value > 90)::INT) / count(*), 2) AS error_rate FROM events GROUP BY 1")
def query_patterns(d: Dataset) -> DataFrame:
    bad = F.sum((F.col("value") > 90).cast("int"))
    return d.table("events").groupBy(F.col("event_type").alias("pattern")).agg(F.count("*").alias("n"), F.round(100.0 * bad / F.count("*"), 2).alias("error_rate"))


@query("SELECT count(*) AS query_count, round(avg(value), 2) AS mean_ms, round(min(value), 2) AS least_ms, round(max(value), 2) AS most_ms, round(sum(value), 2) AS total_ms FROM events")
def performance_summary(d: Dataset) -> DataFrame:
    v = F.col("value")
    return d.table("events").agg(F.count("*").alias("query_count"), *(F.round(f(v), 2).alias(n) for f, n in ((F.avg, "mean_ms"), (F.min, "least_ms"), (F.max, "most_ms"), (F.sum, "total_ms"))))


@query("""SELECT user_id % 8 AS modality, count(*) AS detected, sum((event_type = 'error')::INT)::BIGINT AS repaired, round(100.0 * sum((event_type = 'error')::INT) / count(*), 1) AS success_rate FROM events WHERE value > 50 GROUP BY 1""")
def drift_report(d: Dataset) -> DataFrame:
    ok = F.sum((F.col("event_type") == "error").cast("int"))
    g = d.table("events").where("value > 50").groupBy((F.col("user_id") % 8).alias("modality"))
    return g.agg(F.count("*").alias("detected"), ok.alias("repaired"), F.round(100.0 * ok / F.count("*"), 1).alias("success_rate"))


@query("SELECT user_id AS store_id, min(ts) AS registered, max(ts) AS last_seen, count(*) AS beats, arg_max(event_type, (ts, event_type)) <> 'error' AS live FROM events GROUP BY 1")
def store_registry(d: Dataset) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "leave").otherwise(F.col("event_type"))
    return J.heartbeats(d.table("events").select(F.col("user_id").alias("store_id"), "ts", op.alias("op")))


@query("SELECT lang AS claim, count(*) AS proofs, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1")
def proof_usage(d: Dataset) -> DataFrame:
    from pyspark.sql import Window as W

    g = d.documents.groupBy(F.col("lang").alias("claim")).agg(F.count("*").alias("proofs"))
    return g.select("claim", "proofs", F.round(100.0 * F.col("proofs") / F.sum("proofs").over(W.partitionBy()), 6).alias("percent"))


@query("""SELECT event_id, props::JSON->>'$.k' AS k, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'n/a' ELSE props::JSON->>'$.k' END AS DOUBLE), 0.0) AS number, event_id % 2 = 0 AS uuid FROM events""")
def value_checks(d: Dataset) -> DataFrame:
    """A JSON path, a number with a default, and a check for UUIDs."""
    k, text = F.col("event_id"), X.json_path(F.col("props"), "k")
    dashed = F.regexp_replace(F.md5(k.cast("string").cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    number = X.parse_or(F.when(k % 3 == 0, "n/a").otherwise(text))
    return d.table("events").select("event_id", text.alias("k"), number.alias("number"), X.is_uuid(F.when(k % 2 == 0, dashed).otherwise(F.lit("no-uuid"))).alias("uuid"))


@query("""SELECT doc_id AS entity_id, map_extract(m, 'quality')[1] AS quality, map_extract(m, 'toxic')[1] AS toxic, map_extract(m, 'kind')[1] AS kind, cardinality(m)::INT AS n
FROM (SELECT doc_id, map_concat(map_concat(MAP {'quality': quality::VARCHAR, 'toxic': toxic::VARCHAR}, MAP {'toxic': 'checked'}), MAP {'kind': 'label'}) AS m FROM labels)""")
def map_updates(d: Dataset) -> DataFrame:
    """Maps merged, the later entry winning, and one key put."""
    own = F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"))
    m = X.map_put(X.map_merge(own, F.create_map(F.lit("toxic"), F.lit("checked"))), "kind", F.lit("label"))
    x = d.semantic.select("entity_id", m.alias("m"))
    return x.select("entity_id", *(F.col("m")[k].alias(k) for k in ("quality", "toxic", "kind")), F.size("m").alias("n"))


@query("""SELECT '-24h' AS span, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 24 HOUR UNION ALL SELECT '-15m', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 15 MINUTE
UNION ALL SELECT '-2w', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 14 DAY""")
def relative_times(d: Dataset) -> DataFrame:
    """Events since a relative time, for several spans in one scan."""
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    spans = ["-24h", "-15m", "-2w"]
    sums = d.table("events").agg(*(F.count_if(F.col("ts") >= X.ago(now, s)).alias(s) for s in spans))
    return sums.unpivot([], spans, "span", "n")


@query("""SELECT 'document' AS modality, count(*) + (SELECT count(*) FROM benchmark) AS n FROM documents UNION ALL SELECT 'semantic', count(*) + (SELECT count(*) FROM benchmark) FROM labels
UNION ALL SELECT 'vector', count(*) FROM embeddings""")
def insert_entities(d: Dataset) -> DataFrame:
    """Benchmark items become entities with a document and an annotation, beside those that exist; vectors stay as they are."""
    new = d.table("benchmark").select((-F.col("item_id") - 1).alias("entity_id"), F.col("text").alias("body"))
    slots = {"document": S.upsert(d.documents.select("entity_id", "body"), new), "semantic": S.upsert(d.semantic, new.select("entity_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))), "vector": d.vectors}
    return J.union([x.agg(F.lit(k).alias("modality"), F.count("*").alias("n")) for k, x in slots.items()])


@query("""WITH l AS (SELECT doc_id, sha256(doc_id || ':' || lang) AS h FROM documents WHERE lang = 'fr'), g AS (SELECT doc_id // 1000 AS b, sha256(string_agg(h, '' ORDER BY doc_id)) AS h, count(*) AS n, bool_and(length(h) = 64) AS proven FROM l GROUP BY 1)
SELECT sha256('lang = fr') AS query_hash, sum(n)::BIGINT AS n, sha256(string_agg(h, '' ORDER BY b)) AS rows_hash, bool_and(proven) AS proven FROM g GROUP BY b // 1000""")
def result_bundle(d: Dataset) -> DataFrame:
    """A result's evidence: the hash of what was asked, the number of rows, one digest over the sorted rows' hashes."""
    r = d.documents.where("lang = 'fr'").select("entity_id", F.sha2(F.concat(F.col("entity_id").cast("string"), F.lit(":"), F.col("lang")), 256).alias("h"))
    return P.bundle(r, "lang = fr", levels=2)


@query("""SELECT o_custkey AS circuit, count(*) AS entries, arg_max(o_orderstatus, o_orderkey) <> 'F' AS registered FROM orders GROUP BY 1""")
def circuit_registry(d: Dataset) -> DataFrame:
    """Circuits by name, as a fold of a log in which F unregisters and any other entry registers."""
    op = F.when(F.col("o_orderstatus") == "F", "leave").otherwise("register")
    log = d.table("orders").select(F.col("o_custkey").alias("store_id"), F.col("o_orderkey").alias("ts"), op.alias("op"))
    return J.heartbeats(log).select(F.col("store_id").alias("circuit"), F.col("beats").alias("entries"), F.col("live").alias("registered"))


@query("""SELECT event_id, CASE WHEN value % 1 < 0.2 THEN 'skip' WHEN event_type = 'error' THEN 'repair_provenance' WHEN event_type = 'click' THEN 'regenerate_vector' ELSE 'sync_document' END AS strategy FROM events""")
def repair_dispatch(d: Dataset) -> DataFrame:
    """The first strategy that applies, in order; scores under the least one are skipped."""
    kind = F.col("event_type")
    rules = [(kind == "error", "repair_provenance"), (kind == "click", "regenerate_vector"), (F.lit(True), "sync_document")]
    return d.table("events").select("event_id", M.dispatch(F.col("value") % 1, 0.2, rules).alias("strategy"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'dismissed' WHEN event_type = 'click' THEN 'manual' ELSE 'vector' END AS winner FROM events WHERE event_type IN ('click', 'view')""")
def conflict_overrides(d: Dataset) -> DataFrame:
    """Conflicts resolved by a policy of their own pair where there is one; dismissed ones stay so."""
    e = d.table("events").where(F.col("event_type").isin("click", "view"))
    pair = F.when(F.col("event_type") == "click", F.array(F.lit("document"), F.lit("graph"))).otherwise(F.array(F.lit("document"), F.lit("vector")))
    policies = d.spark.createDataFrame([(["document", "graph"], "manual")], "pair array<string>, policy string")
    x = M.with_policy(e.select("event_id", pair.alias("pair")), policies, "lww")
    resolved = F.when(F.col("policy") == "manual", "manual").otherwise(M.resolve("lww", F.col("pair"), F.lit(0.0)))
    return x.select("event_id", F.when(F.col("event_id") % 10 == 0, "dismissed").otherwise(resolved).alias("winner"))
