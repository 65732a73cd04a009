"""Provenance, semantic, proof, federation and normalisation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..model import Dataset
from ..operators import federation as J
from ..operators import normalize as M
from ..operators import proofs as P
from ..operators import provenance as R
from ..operators import semantic as S
from .registry import query

KIND = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'view' THEN 'imported' WHEN 'click' THEN 'modified' WHEN 'purchase' THEN 'merged' WHEN 'error' THEN 'drift_repaired' ELSE 'custom' END"
REC = f"(SELECT user_id AS entity_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, {KIND} AS event_type, 'user' || user_id % 7 AS actor, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, 'event ' || event_id AS description FROM events)"
HASH = "sha256('{{\"actor\":\"' || {r}.actor || '\",\"description\":\"' || {r}.description || '\",\"event_type\":\"' || {r}.event_type || '\",\"parent_hash\":\"' || {p} || '\",\"source\":null,\"timestamp\":\"' || {r}.ts || '\"}}')"
CHAIN = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT * FROM {REC} WHERE entity_id < 40), c AS (
SELECT entity_id, seq, '{H.GENESIS}' AS parent_hash, {HASH.format(r="r", p="'" + H.GENESIS + "'")} AS content_hash FROM r WHERE seq = 1
UNION ALL SELECT r.entity_id, r.seq, c.content_hash, {HASH.format(r="r", p="c.content_hash")} FROM c JOIN r ON r.entity_id = c.entity_id AND r.seq = c.seq + 1)
"""


@query(CHAIN.replace(" WHERE entity_id < 40", "") + "SELECT entity_id, seq, parent_hash, content_hash FROM c")
def chain_append(d: Dataset) -> DataFrame:
    return R.append(d.provenance).select("entity_id", "seq", "parent_hash", "content_hash")


CHECKED = """, k AS (SELECT c.entity_id, c.seq, c.parent_hash = coalesce(lag(c.content_hash) OVER (PARTITION BY c.entity_id ORDER BY c.seq), '{genesis}') AS linked, c.content_hash = {hash} AS whole
FROM c JOIN {now} r ON r.entity_id = c.entity_id AND r.seq = c.seq)
"""
ALTERED = f"(SELECT * REPLACE (CASE WHEN entity_id % 3 = 0 AND seq = 2 THEN 'tampered' ELSE description END AS description) FROM {REC})"


@query(CHAIN.replace(" WHERE entity_id < 40", "") + CHECKED.format(genesis=H.GENESIS, hash=HASH.format(r="r", p="c.parent_hash"), now="r") + "SELECT entity_id, count(*) AS length, bool_and(linked AND whole) AS chain_valid FROM k GROUP BY 1")
def chain_verify(d: Dataset) -> DataFrame:
    return R.verify(R.append(d.provenance)).select("entity_id", "length", "chain_valid")


@query(CHAIN.replace(" WHERE entity_id < 40", "") + CHECKED.format(genesis=H.GENESIS, hash=HASH.format(r="r", p="c.parent_hash"), now=ALTERED) + """SELECT entity_id, bool_and(linked AND whole) AS chain_valid, min(seq) FILTER (NOT (linked AND whole)) AS first_bad,
arg_min(CASE WHEN NOT linked THEN 'broken_link' ELSE 'altered_record' END, seq) FILTER (NOT (linked AND whole)) AS fault FROM k GROUP BY 1""")
def chain_tampered(d: Dataset) -> DataFrame:
    """Every third chain has its second record's description altered after hashing."""
    hit = (F.col("entity_id") % 3 == 0) & (F.col("seq") == 2)
    altered = R.append(d.provenance).withColumn("description", F.when(hit, "tampered").otherwise(F.col("description")))
    return R.verify(altered).select("entity_id", "chain_valid", "first_bad", "fault")


@query(f"SELECT entity_id, arg_min(description, seq) AS origin, arg_max(description, seq) AS latest FROM {REC} GROUP BY 1")
def origin_latest(d: Dataset) -> DataFrame:
    return R.ends(d.provenance)


@query(f"SELECT entity_id, seq, event_type FROM {REC} WHERE actor = 'user3'")
def by_actor(d: Dataset) -> DataFrame:
    return d.provenance.where("actor = 'user3'").select("entity_id", "seq", "event_type")


@query("SELECT event_type, CASE WHEN lower(event_type) IN ('created','modified','imported','normalized','drift_repaired','deleted','merged') THEN lower(event_type) ELSE 'custom' END AS kind, count(*) AS n FROM (SELECT CASE WHEN event_type = 'click' THEN 'Modified' ELSE event_type END AS event_type FROM events) GROUP BY 1, 2")
def event_kinds(d: Dataset) -> DataFrame:
    e = d.table("events").select(F.when(F.col("event_type") == "click", "Modified").otherwise(F.col("event_type")).alias("event_type"))
    return e.select("event_type", R.normal_kind(F.col("event_type")).alias("kind")).groupBy("event_type", "kind").agg(F.count("*").alias("n"))


def _types(d: Dataset) -> DataFrame:
    n = d.table("nation").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("type"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("parent"))
    r = d.table("region").select(F.concat(F.lit("region"), F.col("r_regionkey").cast("string")).alias("type"), F.lit("Document").alias("parent"))
    return n.unionByName(r).unionByName(d.spark.createDataFrame(S.BUILT_IN, "type string, parent string"))


@query("""WITH RECURSIVE t AS (SELECT 'nation' || n_nationkey AS type, 'region' || n_regionkey AS parent FROM nation UNION ALL SELECT 'region' || r_regionkey, 'Document' FROM region UNION ALL SELECT * FROM (VALUES ('Document', 'Entity'), ('Node', 'Entity'), ('TimeSeries', 'Entity'))),
a AS (SELECT type, parent AS ancestor, 1 AS depth FROM t UNION ALL SELECT a.type, t.parent, depth + 1 FROM a JOIN t ON t.type = a.ancestor) SELECT type, ancestor, min(depth) AS depth FROM a GROUP BY 1, 2""")
def type_hierarchy(d: Dataset) -> DataFrame:
    return S.hierarchy(_types(d), 4)


def _facts(d: Dataset) -> DataFrame:
    props = F.map_from_arrays(F.array(F.lit("lang"), F.lit("n_chars"), F.lit("quality")), F.array(F.col("lang"), F.col("n_chars").cast("string"), F.col("quality").cast("string")))
    return d.documents.join(d.semantic, "entity_id", "left").select("entity_id", F.lit("Document").alias("type"), props.alias("properties"))


def _constraints(d: Dataset) -> DataFrame:
    rows = [("Document", "quality", "required", None, None, None), ("Document", "lang", "pattern", "^(en|fr)$", None, None), ("Document", "n_chars", "range", None, 100.0, 5000.0)]
    return d.spark.createDataFrame(rows, "type string, property string, kind string, argument string, low double, high double")


VIOL = """(SELECT d.doc_id AS entity_id, 'quality' AS property, 'required' AS broken FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)
UNION ALL SELECT doc_id, 'lang', 'pattern' FROM documents WHERE lang NOT IN ('en', 'fr') UNION ALL SELECT doc_id, 'n_chars', 'range' FROM documents WHERE n_chars < 100 OR n_chars > 5000)"""


@query(f"SELECT entity_id, property, broken FROM {VIOL}")
def constraint_violations(d: Dataset) -> DataFrame:
    return S.validate(_facts(d), _constraints(d))


@query(f"SELECT entity_id, string_agg(broken || ':' || property, '; ' ORDER BY broken || ':' || property) AS message FROM {VIOL} GROUP BY 1")
def violation_messages(d: Dataset) -> DataFrame:
    return S.messages(S.validate(_facts(d), _constraints(d)))


@query(f"SELECT doc_id AS entity_id FROM documents WHERE doc_id NOT IN (SELECT entity_id FROM {VIOL})")
def annotate_accepted(d: Dataset) -> DataFrame:
    f = _facts(d)
    return S.accepted(f, S.validate(f, _constraints(d))).select("entity_id")


@query("SELECT event_type AS claim, sum((value >= 50)::INT)::BIGINT AS valid, count(*) AS total FROM events GROUP BY 1")
def proof_tally(d: Dataset) -> DataFrame:
    return d.table("events").groupBy(F.col("event_type").alias("claim")).agg(F.sum((F.col("value") >= 50).cast("int")).alias("valid"), F.count("*").alias("total"))


@query("SELECT doc_id AS entity_id, sha256(text || 'secret-' || doc_id) AS commitment, sha256(text || 'secret-' || doc_id) = sha256(text || CASE WHEN doc_id % 7 = 0 THEN 'wrong' ELSE 'secret-' || doc_id END) AS verified FROM documents WHERE text IS NOT NULL")
def commitments(d: Dataset) -> DataFrame:
    """Commitments to whole texts, opened with the secret, or every seventh with another."""
    secret = F.concat(F.lit("secret-"), F.col("entity_id").cast("string"))
    opened = F.when(F.col("entity_id") % 7 == 0, "wrong").otherwise(secret)
    c = d.documents.where("body is not null").select("entity_id", H.commitment(F.col("body"), secret).alias("commitment"), "body", opened.alias("opened"))
    return c.select("entity_id", "commitment", (F.col("commitment") == H.commitment(F.col("body"), F.col("opened"))).alias("verified"))


def _leaves(d: Dataset) -> DataFrame:
    """Trees of a hundred documents, whole texts."""
    return d.documents.select(F.floor(F.col("entity_id") / 100).alias("tree"), (F.col("entity_id") % 100).alias("idx"), F.coalesce("body", F.lit("")).alias("data"))


LEAF = "SELECT doc_id // 100 AS tree, doc_id % 100 AS idx, sha256(coalesce(text, '')) AS h, max(doc_id % 100 + 1) OVER (PARTITION BY doc_id // 100) AS n FROM documents"
PAIRED = "SELECT tree, idx // 2 AS idx, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(unhex(arg_min(h, idx)) || unhex(arg_max(h, idx))) END AS h, (max(n) + 1) // 2 AS n FROM l{} GROUP BY 1, 2"
LEVELS = ", ".join([f"l0 AS MATERIALIZED ({LEAF})", *(f"l{k + 1} AS MATERIALIZED ({PAIRED.format(k)})" for k in range(7))])
WALK = ", ".join(
    f"w{k + 1} AS (SELECT w.tree, w.idx, CASE WHEN s.n = 1 THEN w.h WHEN (w.idx >> {k}) % 2 = 1 THEN sha256(unhex(s.h) || unhex(w.h)) ELSE sha256(unhex(w.h) || unhex(s.h)) END AS h "
    f"FROM w{k} w JOIN l{k} s ON s.tree = w.tree AND s.idx = least(xor(w.idx >> {k}, 1), s.n - 1))"
    for k in range(7)
)


@query(f"WITH {LEVELS} SELECT tree, h AS root FROM l7")
def merkle_roots(d: Dataset) -> DataFrame:
    return P.merkle_roots(_leaves(d))


@query(f"""WITH {LEVELS}, w0 AS (SELECT doc_id // 100 AS tree, doc_id % 100 AS idx, sha256(CASE WHEN doc_id % 11 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) AS h FROM documents), {WALK}
SELECT tree, w7.idx, w7.h = l7.h AS included FROM w7 JOIN l7 USING (tree)""")
def merkle_inclusion(d: Dataset) -> DataFrame:
    """Whether a leaf's path leads from what its document holds to the tree's root; every eleventh text has been changed since."""
    leaves = _leaves(d)
    paths = P.merkle_paths(leaves).join(P.merkle_roots(leaves), "tree")
    now = leaves.select("tree", "idx", F.sha2(F.when((F.col("tree") * 100 + F.col("idx")) % 11 == 0, F.concat("data", F.lit("!"))).otherwise(F.col("data")), 256).alias("now"))
    return paths.join(now, ["tree", "idx"]).select("tree", "idx", (P.path_root(F.col("now"), F.col("path")) == F.col("root")).alias("included"))


@query("SELECT doc_id AS entity_id, sha256(unhex(sha256(coalesce(text, ''))) || unhex(sha256('nonce-' || doc_id))) AS blinded FROM documents")
def blinded_leaves(d: Dataset) -> DataFrame:
    """Leaves as a private proof publishes them: each hashed with a nonce."""
    leaf, nonce = F.sha2(F.coalesce("body", F.lit("")), 256), F.sha2(F.concat(F.lit("nonce-"), F.col("entity_id").cast("string")), 256)
    return d.documents.select("entity_id", H.joined(leaf, nonce).alias("blinded"))


@query("SELECT doc_id AS circuit, (quality = 1 OR toxic = 1) = (quality + toxic > 0) AND quality <> 2 AS holds FROM labels")
def circuit_check(d: Dataset) -> DataFrame:
    """or, and, xor and not gates over each label row's two bits, checked as arithmetic constraints."""
    rows = [t for k, kind in enumerate(("or", "and", "xor", "not")) for t in P.gate(k, kind, 0, 1, 2 + k)]
    terms = d.spark.createDataFrame(rows, "constraint int, side string, wire int, coefficient double")
    q, t = F.col("quality"), F.col("toxic")
    outs = [q, t, F.greatest(q, t), q * t, F.abs(q - t), 1 - q]
    witness = d.semantic.select(F.col("entity_id").alias("circuit"), F.posexplode(F.array(*(o.cast("double") for o in outs))).alias("wire", "value"))
    circuits = d.semantic.select(F.col("entity_id").alias("circuit")).crossJoin(F.broadcast(terms))  # ten terms: the gates above
    return P.constraints_hold(circuits, witness)


@query("SELECT doc_id AS entity_id, sha256('prover:' || coalesce(lang, '') || ':' || doc_id) AS signature, '1.0' AS version FROM documents")
def proven_certificates(d: Dataset) -> DataFrame:
    return d.documents.select("entity_id", H.signature(F.lit("prover"), F.coalesce("lang", F.lit("")), F.col("entity_id").cast("string")).alias("signature"), F.lit("1.0").alias("version"))


@query("SELECT event_id, sha256(event_type || round(value)::BIGINT || strftime(ts, '%Y-%m-%d')) AS certificate FROM events")
def obligation_certificates(d: Dataset) -> DataFrame:
    o = d.table("events").select("event_id", F.col("event_type").alias("obligation"), F.round("value").cast("long").cast("string").alias("witness"), F.date_format("ts", "yyyy-MM-dd").alias("ts"))
    return P.certificates(o).select("event_id", "certificate")


@query("""SELECT d.doc_id AS entity_id, e.n IS NOT NULL AS provenance, l.quality IS NOT NULL AS existence, coalesce(l.toxic = 0, false) AS access, coalesce(e.last >= TIMESTAMP '2024-01-30 00:00:00', false) AS fresh
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN (SELECT user_id, count(*) n, max(ts) AS last FROM events GROUP BY 1) e ON e.user_id = d.doc_id""")
def proof_gates(d: Dataset) -> DataFrame:
    """Existence, provenance, access and freshness as columns, so a conjunction is one filter."""
    e = d.table("events").groupBy(F.col("user_id").alias("entity_id")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    x = d.documents.select("entity_id").join(d.semantic, "entity_id", "left").join(e, "entity_id", "left")
    fresh = F.coalesce(F.col("last") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"), F.lit(False))
    return x.select("entity_id", F.col("n").isNotNull().alias("provenance"), F.col("quality").isNotNull().alias("existence"), F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("access"), fresh.alias("fresh"))


@query("""SELECT source AS repo, count(*) AS issues, sum((l.toxic = 1)::INT)::BIGINT AS critical, sum((l.quality = 0 AND l.toxic = 0)::INT)::BIGINT AS high, sum((l.toxic = 1)::INT) = 0 AS sanctified FROM documents d JOIN labels l USING (doc_id) GROUP BY 1""")
def sanctify_report(d: Dataset) -> DataFrame:
    x = d.documents.join(d.semantic, "entity_id").groupBy(F.col("source").alias("repo"))
    critical = F.sum((F.col("toxic") == 1).cast("int"))
    return x.agg(F.count("*").alias("issues"), critical.alias("critical"), F.sum(((F.col("quality") == 0) & (F.col("toxic") == 0)).cast("int")).alias("high"), (critical == 0).alias("sanctified"))


STORE = "(SELECT source AS store_id, count(*) AS n_docs, max(doc_id) AS last_doc, (regexp_extract(source, '(\\d+)$', 1)::INT * 13) % 20 / 20 AS trust, ((regexp_extract(source, '(\\d+)$', 1)::INT * 97) % 1500)::DOUBLE AS response_ms FROM documents WHERE source IS NOT NULL GROUP BY 1)"
# each entity of the federation has two replicas with contents that differ for every seventh entity
REPL = "(SELECT doc_id AS entity_id, source AS store_id, 1 AS ts, n_chars AS value, lang FROM documents UNION ALL SELECT doc_id, 'mirror', 2, n_chars + (doc_id % 7 = 0)::INT, lang FROM documents)"


def _replicas(d: Dataset) -> DataFrame:
    a = d.documents.select("entity_id", F.col("source").alias("store_id"), F.lit(1).alias("ts"), F.col("n_chars").alias("value"), "lang")
    b = d.documents.select("entity_id", F.lit("mirror").alias("store_id"), F.lit(2).alias("ts"), (F.col("n_chars") + (F.col("entity_id") % 7 == 0).cast("int")).alias("value"), "lang")
    return J.union([a, b])


@query(f"SELECT store_id, n_docs FROM {STORE} WHERE starts_with(store_id, 'src1')")
def federation_pattern(d: Dataset) -> DataFrame:
    return d.peers.where(J.matches(F.col("store_id"), "src1/*")).select("store_id", "n_docs")


@query("""SELECT source AS store_id FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY 1 HAVING count(e.vec_id) > 10 AND count(l.doc_id) > 10""")
def federation_eligible(d: Dataset) -> DataFrame:
    """Stores that hold both wanted modalities in more than ten rows."""
    x = d.documents.select("entity_id", "source").join(d.vectors.select("entity_id", "label"), "entity_id", "left").join(d.semantic, "entity_id", "left")
    have = x.groupBy(F.col("source").alias("store_id")).agg(F.filter(F.array(F.when(F.count("label") > 10, "vector"), F.when(F.count("quality") > 10, "semantic")), lambda m: m.isNotNull()).alias("have"))
    return have.where(J.eligible(F.col("have"), ["vector", "semantic"])).select("store_id")


@query("""SELECT source AS source_store, doc_id AS entity_id, n_chars AS score FROM documents ORDER BY score DESC, doc_id LIMIT 100""")
def federation_topk(d: Dataset) -> DataFrame:
    parts = [d.documents.where(F.col("source").endswith(str(k))).select(F.col("source").alias("source_store"), "entity_id", F.col("n_chars").alias("score")) for k in range(10)]
    return J.union(parts).orderBy(F.desc("score"), "entity_id").limit(100)


@query(f"SELECT entity_id, count(*) AS replicas FROM {REPL} GROUP BY 1 HAVING min(value) = max(value)")
def federation_strict(d: Dataset) -> DataFrame:
    return J.apply_policy(_replicas(d), "STRICT", ["value", "lang"]).groupBy("entity_id").agg(F.count("*").alias("replicas"))


@query(f"SELECT entity_id, 'mirror' AS store_id, value FROM {REPL} WHERE store_id = 'mirror'")
def federation_latest(d: Dataset) -> DataFrame:
    return J.apply_policy(_replicas(d), "LATEST", ["value", "lang"]).select("entity_id", "store_id", "value")


@query(f"SELECT r.entity_id, r.store_id, m.value FROM {REPL} r JOIN {REPL} m ON m.entity_id = r.entity_id AND m.store_id = 'mirror'")
def federation_repair(d: Dataset) -> DataFrame:
    return J.apply_policy(_replicas(d), "REPAIR", ["value", "lang"]).select("entity_id", "store_id", "value")


@query(f"SELECT entity_id, store_id, entity_id % 7 = 0 AS drifted FROM {REPL}")
def federation_tolerate(d: Dataset) -> DataFrame:
    return J.with_drift(J.apply_policy(_replicas(d), "TOLERATE", []), ["value", "lang"]).select("entity_id", "store_id", "drifted")


@query(f"SELECT store_id, round(0.7 * trust + 0.3 * (1 - least(response_ms / 1000, 1)), 6) AS score FROM {STORE} ORDER BY 0.7 * trust + 0.3 * (1 - least(response_ms / 1000, 1)) DESC, store_id LIMIT 3")
def best_store(d: Dataset) -> DataFrame:
    s = d.peers.withColumn("s", J.store_score(F.col("trust"), F.col("response_ms")))
    return s.orderBy(F.desc("s"), "store_id").limit(3).select("store_id", F.round("s", 6).alias("score"))


@query(f"SELECT store_id FROM {STORE} WHERE trust >= 0.5 AND last_doc >= (SELECT max(doc_id) FROM documents) - 300")
def live_stores(d: Dataset) -> DataFrame:
    end = d.table("documents").agg((F.max("doc_id") - 300).alias("since"))
    return d.peers.join(F.broadcast(end), F.col("last_doc") >= F.col("since")).where("trust >= 0.5").select("store_id")


@query(f"""SELECT lang, max(trust) - min(trust) > 0.3 AS diverged, CASE WHEN max(trust) - min(trust) > 0.3 THEN 'Diverged' WHEN 20 - count(*) > 0 THEN 'Stale:' || (20 - count(*)) * 1000 ELSE 'UpToDate' END AS status
FROM (SELECT DISTINCT lang, source FROM documents) d JOIN {STORE} s ON s.store_id = d.source GROUP BY 1""")
def replication_status(d: Dataset) -> DataFrame:
    x = d.documents.select("lang", F.col("source").alias("store_id")).distinct().join(d.peers.select("store_id", "trust"), "store_id")
    g = x.groupBy("lang").agg((F.max("trust") - F.min("trust")).alias("spread"), (20 - F.count("*")).alias("missing"))
    return g.select("lang", (F.col("spread") > J.DIVERGED).alias("diverged"), J.replication_status(F.col("missing"), F.col("spread")).alias("status"))


@query("""WITH c AS (SELECT user_id AS entity_id, event_type AS value, count(*) AS votes FROM events GROUP BY 1, 2)
SELECT entity_id, arg_min(value, (-votes, value)) AS value, max(votes) AS votes, sum(votes)::BIGINT AS "of", max(votes) >= sum(votes) // 2 + 1 AS agreed FROM c GROUP BY 1""")
def consensus_quorum(d: Dataset) -> DataFrame:
    return J.consensus(d.table("events").select(F.col("user_id").alias("entity_id"), F.col("event_type").alias("value")), "QUORUM")


@query(f"SELECT store_id, round(abs(trust - m), 6) AS distance FROM {STORE}, (SELECT quantile_disc(trust, 0.5) AS m FROM {STORE}) WHERE abs(trust - m) > 0.3")
def byzantine_stores(d: Dataset) -> DataFrame:
    """Stores more than 0.3 from the median trust; one row of statistics is broadcast."""
    m = d.peers.agg(F.percentile_approx("trust", 0.5, 10000).alias("m"))
    gap = F.abs(F.col("trust") - F.col("m"))
    return d.peers.crossJoin(F.broadcast(m)).where(gap > 0.3).select("store_id", F.round(gap, 6).alias("distance"))


@query("""SELECT user_id AS store_id, round(list_reduce(list_prepend(1.0::DOUBLE, list((CASE WHEN value >= 20 THEN 0.05 ELSE -0.1 END)::DOUBLE ORDER BY event_id)), lambda t, x: least(greatest(t + x, 0), 1)), 6) AS trust FROM events GROUP BY 1""")
def trust_fold(d: Dataset) -> DataFrame:
    e = d.table("events").select(F.col("user_id").alias("store_id"), F.col("event_id").alias("seq"), (F.col("value") >= 20).alias("ok"))
    return J.trust_fold(e).select("store_id", F.round("trust", 6).alias("trust"))


@query("""SELECT d.doc_id AS entity_id, CASE WHEN (doc_id * 37 % 100) / 100 > 0.3 THEN CASE WHEN d.doc_id % 2 = 0 THEN CASE WHEN l.doc_id IS NOT NULL THEN 'semantic' WHEN e.vec_id IS NOT NULL THEN 'vector' END ELSE 'document' END END AS source
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l USING (doc_id)""")
def authority_pick(d: Dataset) -> DataFrame:
    """The modality a drifted one (the document for even ids, else the vector) is regenerated from."""
    x = d.documents.select("entity_id").join(d.vectors.select("entity_id", "label"), "entity_id", "left").join(d.semantic, "entity_id", "left")
    present = F.filter(F.array(F.lit("document"), F.when(F.col("label").isNotNull(), "vector"), F.when(F.col("quality").isNotNull(), "semantic")), lambda m: m.isNotNull())
    drifted = F.when(F.col("entity_id") % 2 == 0, "document").otherwise("vector")
    return x.select("entity_id", M.regenerate_from(present, drifted, F.col("entity_id") * 37 % 100 / 100).alias("source"))


@query("""SELECT d.doc_id AS entity_id, round(8.0 / (8 + CASE WHEN e.vec_id IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN l.doc_id IS NOT NULL THEN 7 ELSE 0 END), 6) AS document_weight FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l USING (doc_id)""")
def merge_weights(d: Dataset) -> DataFrame:
    x = d.documents.select("entity_id").join(d.vectors.select("entity_id", "label"), "entity_id", "left").join(d.semantic, "entity_id", "left")
    present = F.filter(F.array(F.lit("document"), F.when(F.col("label").isNotNull(), "vector"), F.when(F.col("quality").isNotNull(), "semantic")), lambda m: m.isNotNull())
    return x.select("entity_id", F.round(F.get(M.merge_weights(present), F.lit(0)), 6).alias("document_weight"))


LIFE = "(SELECT o_custkey AS entity_id, min(o_orderdate) AS a, max(o_orderdate) AS b, count(*) AS n FROM orders GROUP BY 1)"


@query(f"""SELECT entity_id, unnest(CASE WHEN len(list_filter([CASE WHEN entity_id % 5 = 0 AND a < b THEN 'created_after_modified' END, CASE WHEN entity_id % 4 = 0 THEN 'version_zero' END, CASE WHEN n < (entity_id % 4) * 3 THEN 'missing_versions' END], lambda x: x IS NOT NULL)) > 0
THEN list_filter([CASE WHEN entity_id % 5 = 0 AND a < b THEN 'created_after_modified' END, CASE WHEN entity_id % 4 = 0 THEN 'version_zero' END, CASE WHEN n < (entity_id % 4) * 3 THEN 'missing_versions' END], lambda x: x IS NOT NULL) ELSE ['verified'] END) AS change FROM {LIFE}""")
def temporal_repairs(d: Dataset) -> DataFrame:
    k = F.col("entity_id")
    g = d.table("orders").groupBy(F.col("o_custkey").alias("entity_id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"), F.count("*").alias("version_count"))
    x = g.select("entity_id", F.when(k % 5 == 0, F.col("b")).otherwise(F.col("a")).alias("created"), F.when(k % 5 == 0, F.col("a")).otherwise(F.col("b")).alias("modified"), ((k % 4) * 3).alias("version"), "version_count")
    return M.temporal_repairs(x)


@query("""SELECT doc_id AS entity_id, CASE WHEN u AND t THEN 'reconcile' WHEN t THEN 'extract_graph' WHEN u THEN 'describe_graph' ELSE 'nothing' END AS change FROM (SELECT doc_id, doc_id IN (SELECT user_id FROM events) AS u, n_chars > 500 AS t FROM documents)""")
def graph_document_changes(d: Dataset) -> DataFrame:
    u = d.table("events").select(F.col("user_id").alias("entity_id")).distinct().withColumn("u", F.lit(True))
    x = d.documents.select("entity_id", "n_chars").join(u, "entity_id", "left")
    return x.select("entity_id", M.graph_document_change(F.coalesce("u", F.lit(False)), F.col("n_chars") > 500).alias("change"))


@query("""SELECT doc_id AS entity_id, CASE WHEN s >= 0.8 THEN 'manual' ELSE 'vector' END AS lww, CASE WHEN s >= 0.8 THEN 'manual' ELSE 'document' END AS priority, CASE WHEN s >= 0.8 THEN 'manual' ELSE 'merged' END AS merge FROM (SELECT doc_id, (doc_id * 37 % 100) / 100 AS s FROM documents)""")
def conflict_resolution(d: Dataset) -> DataFrame:
    m, s = F.array(F.lit("document"), F.lit("vector")), F.col("entity_id") * 37 % 100 / 100
    return d.documents.select("entity_id", *(M.resolve(k, m, s).alias(k) for k in ("lww", "priority", "merge")))
