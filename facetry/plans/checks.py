"""Proof requests, access, contracts, partial projections, and files written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Dataset
from ..operators import access
from ..operators import federation as J
from ..operators import graph as G
from ..operators import proofs as P
from ..operators import search as S
from ..operators import tensors as N
from ..shared import shared_dir
from ..sources import files
from .graph import EDGES
from .registry import query
from .search import CHARS, TOKENS


def _strings(*xs: str):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


def _requests(d: Dataset) -> DataFrame:
    """Proof requests of five forms, with every third contract given and four choices of modalities."""
    kinds = F.when(F.col("entity_id") % 5 == 0, _strings("EXISTENCE")).when(F.col("entity_id") % 5 == 1, _strings("PROVENANCE", "CITATION")).when(F.col("entity_id") % 5 == 2, _strings("INTEGRITY", "FRESHNESS")).when(F.col("entity_id") % 5 == 3, _strings("SIGNED")).otherwise(_strings())
    modalities = F.when(F.col("entity_id") % 4 == 0, _strings("all")).when(F.col("entity_id") % 4 == 1, _strings("document")).when(F.col("entity_id") % 4 == 2, _strings("temporal", "semantic")).otherwise(_strings())
    return d.documents.select("entity_id", kinds.alias("kinds"), F.when(F.col("entity_id") % 3 == 0, "c").alias("contract"), modalities.alias("modalities"))


@query("""SELECT doc_id AS entity_id, CASE doc_id % 5 WHEN 1 THEN 'sequential' WHEN 2 THEN 'conjunction' ELSE 'independent' END AS composition,
CASE WHEN doc_id % 4 = 3 THEN 'no modality' WHEN doc_id % 5 = 4 THEN 'no proof' WHEN doc_id % 5 = 3 THEN 'unknown:SIGNED' WHEN doc_id % 5 = 1 AND doc_id % 3 <> 0 THEN 'contract:CITATION' WHEN doc_id % 5 = 2 AND doc_id % 3 <> 0 THEN 'contract:INTEGRITY'
WHEN doc_id % 5 = 1 AND doc_id % 4 <> 0 THEN 'modality:PROVENANCE' WHEN doc_id % 5 = 2 AND doc_id % 4 = 1 THEN 'modality:INTEGRITY' END AS problem FROM documents""")
def proof_requests(d: Dataset) -> DataFrame:
    """How the proofs of a request compose, and its first problem."""
    return _requests(d).select("entity_id", P.composition(F.col("kinds")).alias("composition"), P.request_problem(F.col("kinds"), F.col("contract"), F.col("modalities")).alias("problem"))


@query("""SELECT doc_id AS entity_id, kind, circuit, fields, ms FROM documents JOIN (VALUES (0, 'EXISTENCE', 'existence-proof-v1', 3, 50), (1, 'PROVENANCE', 'provenance-proof-v1', 4, 300), (1, 'CITATION', 'citation-proof-v1', 3, 100),
(2, 'INTEGRITY', 'integrity-proof-v1', 3, 200), (2, 'FRESHNESS', 'freshness-proof-v1', 3, 100)) k(form, kind, circuit, fields, ms) ON doc_id % 5 = form""")
def proof_obligations(d: Dataset) -> DataFrame:
    return P.obligations(_requests(d)).select("entity_id", "kind", "circuit", F.size("witness").alias("fields"), "ms")


@query("""WITH e AS (SELECT user_id, max(ts) AS last FROM events GROUP BY 1)
SELECT d.doc_id AS entity_id, CASE WHEN l.doc_id IS NULL THEN 'existence' WHEN e.last IS NULL THEN 'provenance' WHEN l.toxic <> 0 THEN 'access' WHEN e.last < TIMESTAMP '2024-01-30 00:00:00' THEN 'freshness' END AS failed
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN e ON e.user_id = d.doc_id""")
def proof_conjunction(d: Dataset) -> DataFrame:
    """Proofs asked together: the first that fails, or null."""
    e = d.table("events").groupBy(F.col("user_id").alias("entity_id")).agg(F.max("ts").alias("last"))
    x = d.documents.select("entity_id").join(d.semantic, "entity_id", "left").join(e, "entity_id", "left")
    fresh = F.col("last") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz")
    return x.select("entity_id", P.first_failed({"existence": F.col("quality").isNotNull(), "provenance": F.col("last").isNotNull(), "access": F.col("toxic") == 0, "freshness": fresh}).alias("failed"))


@query("""SELECT doc_id AS entity_id, 'region' || doc_id % 7 AS contract, doc_id % 7 IN (SELECT r_regionkey FROM region) AS exists, coalesce(l.quality = 1, false) AND doc_id % 7 IN (SELECT r_regionkey FROM region) AS satisfied
FROM documents LEFT JOIN labels l USING (doc_id)""")
def contract_lookup(d: Dataset) -> DataFrame:
    """Whether the contract that a document cites is registered, and whether the document satisfies it (quality 1)."""
    cited = d.documents.select("entity_id", F.concat(F.lit("region"), (F.col("entity_id") % 7).cast("string")).alias("contract")).join(d.semantic, "entity_id", "left")
    known = d.table("region").select(F.concat(F.lit("region"), F.col("r_regionkey").cast("string")).alias("contract")).distinct().withColumn("known", F.lit(True))
    have = F.col("known").isNotNull()
    return cited.join(known, "contract", "left").select("entity_id", "contract", have.alias("exists"), (F.coalesce(F.col("quality") == 1, F.lit(False)) & have).alias("satisfied"))


CONTRACTS = [("c0", "EXISTENCE", ["ACCESS", "PROVENANCE", "EXISTENCE"]), ("c1", "ACCESS", ["EXISTENCE"]), ("c2", "PROVENANCE", ["CITATION"]), ("c3", "CITATION", ["PROVENANCE", "EXISTENCE"])]


@query("""WITH c(contract, kind, accepts) AS (VALUES ('c0', 'EXISTENCE', ['ACCESS', 'PROVENANCE', 'EXISTENCE']), ('c1', 'ACCESS', ['EXISTENCE']), ('c2', 'PROVENANCE', ['CITATION']), ('c3', 'CITATION', ['PROVENANCE', 'EXISTENCE'])),
r AS (SELECT doc_id, 0 AS i, 'c' || doc_id % 4 AS contract FROM documents UNION ALL SELECT doc_id, 1, 'c' || doc_id // 4 % 4 FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 2, 'c9' FROM documents WHERE doc_id % 11 = 0),
x AS (SELECT r.doc_id, r.i, c.kind, c.accepts FROM r LEFT JOIN c USING (contract))
SELECT a.doc_id AS entity_id, bool_and(b.i IS NULL OR coalesce(list_contains(a.accepts, b.kind) AND list_contains(b.accepts, a.kind), false)) AS composable FROM x a LEFT JOIN x b ON b.doc_id = a.doc_id AND b.i > a.i GROUP BY 1""")
def contract_composition(d: Dataset) -> DataFrame:
    """Whether the one to three contracts of a request stand together; every eleventh names one that isn't registered."""
    listed = F.filter(F.array(F.concat(F.lit("c"), (F.col("entity_id") % 4).cast("string")), F.when(F.col("entity_id") % 5 != 0, F.concat(F.lit("c"), (F.floor(F.col("entity_id") / 4) % 4).cast("string"))), F.when(F.col("entity_id") % 11 == 0, "c9")), lambda c: c.isNotNull())
    return P.composable(d.documents.select("entity_id", listed.alias("contracts")), d.spark.createDataFrame(CONTRACTS, "contract string, kind string, accepts array<string>"))


@query("""WITH q AS (SELECT event_id, user_id % 10 AS client, CASE user_id % 3 WHEN 0 THEN 'reader' WHEN 1 THEN 'writer' ELSE 'guest' END AS role, CASE WHEN event_type = 'click' THEN 'vector' ELSE 'document' END AS modality,
event_id % 50 AS entity_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'execute' ELSE 'admin' END AS permission FROM events),
g AS (SELECT *, CASE WHEN role = 'reader' AND permission IN ('read', 'execute') OR role = 'writer' AND permission IN ('read', 'write', 'execute') THEN 'global' WHEN role = 'guest' AND modality = 'document' AND permission = 'read' THEN 'modality'
WHEN permission = 'admin' AND EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = q.entity_id AND l.doc_id % 10 = q.client) THEN 'entity' ELSE 'denied' END AS reason FROM q)
SELECT event_id, reason <> 'denied' AS allowed, reason FROM g""")
def access_decisions(d: Dataset) -> DataFrame:
    """Each request's decision and its ground."""
    kind, who = F.col("event_type"), F.col("user_id") % 3
    asked = d.table("events").select(
        "event_id", (F.col("user_id") % 10).alias("client"), F.when(who == 0, "reader").when(who == 1, "writer").otherwise("guest").alias("role"), F.when(kind == "click", "vector").otherwise("document").alias("modality"),
        (F.col("event_id") % 50).alias("entity_id"), F.when(kind == "view", "read").when(kind == "purchase", "write").when(kind == "click", "execute").otherwise("admin").alias("permission"),
    )
    grants = [("reader", None, "read"), ("reader", None, "execute"), ("writer", None, "read"), ("writer", None, "write"), ("writer", None, "execute"), ("guest", "document", "read")]
    acl = d.semantic.select("entity_id", (F.col("entity_id") % 10).alias("client"), F.lit("admin").alias("permission"))
    return access.decide(asked, d.spark.createDataFrame(grants, "role string, modality string, permission string"), acl).select("event_id", "allowed", "reason")


@query("SELECT 'documents' AS store_id, count(*) AS n, false AS failed FROM documents UNION ALL SELECT 'labels', count(*), false FROM labels UNION ALL SELECT 'absent', 0, true")
def store_fan_out(d: Dataset) -> DataFrame:
    """Rows of each store that answers; one that doesn't counts as empty."""
    rows, errors = J.fan_out({k: lambda k=k: d.table(k).select("doc_id") for k in ("documents", "labels", "absent")})
    failed = d.spark.createDataFrame([(k, 0, True) for k in errors], "store_id string, n long, failed boolean")
    return rows.groupBy("store_id").agg(F.count("*").alias("n"), F.lit(False).alias("failed")).unionByName(failed)


@query(f"""WITH f AS (SELECT doc_id AS entity_id, (3 * len(list_filter({TOKENS.format('substr(text, 1, 40)')}, lambda x: levenshtein({CHARS}, 'thation') <= 2)))::DOUBLE AS t, (2 * len(list_filter({TOKENS.format('text')}, lambda x: levenshtein({CHARS}, 'thation') <= 2)))::DOUBLE AS b FROM documents WHERE text IS NOT NULL)
SELECT entity_id, CASE WHEN t >= b THEN 'title' ELSE 'body' END AS field, greatest(t, b) AS score FROM f WHERE greatest(t, b) > 0""")
def best_field_match(d: Dataset) -> DataFrame:
    return S.best_field_match(d.documents, "thation", {"title": 3.0, "body": 2.0})


@query("SELECT vec_id AS entity_id, 2 AS ndim, 64 AS numel, 0.0::DOUBLE AS zeros, 64.0::DOUBLE AS ones, len(embedding) = 64 AS consistent FROM embeddings")
def tensor_fills(d: Dataset) -> DataFrame:
    """Zeros and ones of each tensor's shape, by their sums."""
    shape = F.col("shape")
    total = lambda v: F.aggregate(N.filled(shape, v), F.lit(0.0), lambda s, x: s + x)
    return d.tensors.select("entity_id", F.size(shape).alias("ndim"), N.numel(shape).cast("int").alias("numel"), total(0.0).alias("zeros"), total(1.0).alias("ones"), N.is_consistent(shape, F.col("data")).alias("consistent"))


@query("""WITH v AS (SELECT user_id AS entity_id, event_type AS message, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events)
SELECT vec_id AS entity_id, round(list_sum(embedding[1:4]::DOUBLE[]), 6) AS fields, round((embedding[1] + embedding[2] + embedding[9] + embedding[10])::DOUBLE, 4) AS corner, v.message AS second FROM embeddings LEFT JOIN v ON v.entity_id = vec_id AND v.version = 2""")
def modality_projections(d: Dataset) -> DataFrame:
    """Parts of modalities: four fields of the vector, a 2 x 2 slice of the tensor, version 2."""
    block = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda r: F.slice("data", r * 8 + 1, F.lit(2))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    v = d.vectors.select("entity_id", F.round(total(F.slice("embedding", 1, 4)), 6).alias("fields"))
    t = d.tensors.select("entity_id", F.round(total(block), 4).alias("corner"))
    return v.join(t, "entity_id").join(d.versions.where("version = 2").select("entity_id", F.col("message").alias("second")), "entity_id", "left")


@query(f"SELECT subject, predicate, object FROM {EDGES} WHERE subject = 'customer/1' UNION ALL SELECT subject, predicate, object FROM {EDGES} WHERE object = 'nation/1'")
def triple_keys(d: Dataset) -> DataFrame:
    """Triples out of their two sort keys, by one subject and by one object."""
    keys = G.keyed(d.edges)
    return G.scan_keys(keys, "by_subject", "customer/1").unionByName(G.scan_keys(keys, "by_object", "nation/1"))


@query("SELECT doc_id AS entity_id, md5(base64(encode(text))) AS base64, md5(lower(hex(encode(text)))) AS hex, true AS same FROM documents WHERE text IS NOT NULL")
def binary_forms(d: Dataset) -> DataFrame:
    """UTF-8 bytes as base64 and hex, and back."""
    data = F.encode("body", "UTF-8")
    b64, hx = F.base64(data), F.lower(F.hex(data))
    back = (F.decode(F.unbase64(b64), "UTF-8") == F.col("body")) & (F.decode(F.unhex(hx), "UTF-8") == F.col("body"))
    return d.documents.where("body is not null").select("entity_id", F.md5(F.regexp_replace(b64, r"\s", "").cast("binary")).alias("base64"), F.md5(hx.cast("binary")).alias("hex"), back.alias("same"))


def _fresh(d: Dataset, name: str) -> str:
    return f"{shared_dir(d.spark)}/facetry/{name}-{uuid.uuid4().hex}"


@query("""SELECT 'has_scan' AS predicate, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT p, count(*) FROM lineitem, (VALUES ('has_weakness'), ('in_file'), ('has_category'), ('has_severity')) v(p) GROUP BY 1""")
def scan_ingest(d: Dataset) -> DataFrame:
    """Scan reports (an order with its lines as weak points, a thousand orders a file) written, read and turned into triples."""
    point = F.struct(F.col("l_returnflag").alias("category"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("location"), F.col("l_linestatus").alias("severity"))
    reports = d.table("lineitem").groupBy("l_orderkey").agg(F.collect_list(point).alias("weak_points"))
    one = F.struct(F.concat(F.lit("repo"), F.col("l_orderkey").cast("string")).alias("program_path"), F.lit("rust").alias("language"), "weak_points")
    path = _fresh(d, "scans")
    reports.groupBy(F.floor(F.col("l_orderkey") / 1000).alias("part")).agg(F.to_json(F.collect_list(one)).alias("value")).write.partitionBy("part").text(path)
    return files.scan_triples(files.read_scans(d.spark, path)).groupBy("predicate").agg(F.count("*").alias("n"))


@query("""SELECT user_id, count(*) AS whole, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND event_id % 50 <> 0 GROUP BY 1""")
def dated_logs(d: Dataset) -> DataFrame:
    """Logs of one folder a day, of which every fiftieth line is damaged, read back for the ten days of a glob."""
    line = F.to_json(F.struct("event_id", "user_id", "value"))
    path = _fresh(d, "logs")
    e = d.table("events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("damaged "), line)).otherwise(line).alias("value"))
    e.write.partitionBy("day").text(path)
    log = files.read_log(d.spark, f"{path}/day=2024-01-1*", "event_id long, user_id long, value double")
    return log.where("event_id is not null").groupBy("user_id").agg(F.count("*").alias("whole"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT form, count(*) AS n, sum(quality)::BIGINT AS quality, sum(doc_id)::BIGINT AS ids FROM labels, (VALUES ('json'), ('csv'), ('parquet')) f(form) GROUP BY 1")
def format_round_trip(d: Dataset) -> DataFrame:
    """Annotations written in each form and read back."""
    kind, out = "entity_id long, quality int, toxic int", []
    for form in ("json", "csv", "parquet"):
        path = _fresh(d, form)
        files.write(d.semantic, path, form)
        back = d.spark.read.schema(kind).option("header", True).format(form).load(path)
        out.append(back.agg(F.lit(form).alias("form"), F.count("*").alias("n"), F.sum("quality").alias("quality"), F.sum("entity_id").alias("ids")))
    return J.union(out)
