"""Vector and text search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..model import Dataset
from ..operators import search as S
from .registry import query

E = "(SELECT vec_id AS entity_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
Q = f"(SELECT e AS q FROM {E} WHERE entity_id = 0)"
TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
# DuckDB counts edits in bytes; other letters than the words' own are one byte here, and differ just as before
CHARS = "regexp_replace(x, '[^a-z0-9]', '_', 'g')"


def _knn(d: Dataset, metric: str) -> DataFrame:
    return S.knn(d.vectors, S.vector_of(d.vectors, 0), 10, metric).select("entity_id", F.round("score", 6).alias("score"))


@query(f"SELECT entity_id, round(list_cosine_similarity(e, q), 6) AS score FROM {E}, {Q} ORDER BY list_cosine_similarity(e, q) DESC, entity_id LIMIT 10")
def knn_cosine(d: Dataset) -> DataFrame:
    return _knn(d, "cosine")


@query(f"SELECT entity_id, round(list_dot_product(e, q), 6) AS score FROM {E}, {Q} ORDER BY list_dot_product(e, q) DESC, entity_id LIMIT 10")
def knn_dot(d: Dataset) -> DataFrame:
    return _knn(d, "dot")


@query(f"SELECT entity_id, round(1 / (1 + list_distance(e, q)), 6) AS score FROM {E}, {Q} ORDER BY 1 / (1 + list_distance(e, q)) DESC, entity_id LIMIT 10")
def knn_euclidean(d: Dataset) -> DataFrame:
    return _knn(d, "euclidean")


@query(f"SELECT entity_id, round(list_cosine_similarity(e, q), 6) AS score FROM {E}, {Q} WHERE list_cosine_similarity(e, q) >= 0.3")
def similar_within(d: Dataset) -> DataFrame:
    return S.similar(d.vectors, S.vector_of(d.vectors, 0), 0.3).select("entity_id", F.round("score", 6).alias("score"))


@query(f"""SELECT entity_id, round(1 - list_cosine_similarity(e, q), 6) AS cosine, round(list_distance(e, q), 6) AS l2, round(-list_dot_product(e, q), 6) AS dot FROM {E}, {Q}""")
def graph_index_distances(d: Dataset) -> DataFrame:
    q, e = S.vector_of(d.vectors, 0), F.col("embedding")
    return d.vectors.select("entity_id", F.round(V.cosine_graph_distance(e, q), 6).alias("cosine"), F.round(V.euclidean(e, q), 6).alias("l2"), F.round(-V.dot(e, q), 6).alias("dot"))


def _searches(metric: str) -> str:
    score = {"cosine": "list_cosine_similarity(x.e, q.e)", "dot": "list_dot_product(x.e, q.e)", "euclidean": "1 / (1 + list_distance(x.e, q.e))"}[metric]
    return f"""SELECT query_id, entity_id, round(s, 6) AS score FROM (SELECT q.entity_id AS query_id, x.entity_id, {score} AS s, row_number() OVER (PARTITION BY q.entity_id ORDER BY {score} DESC, x.entity_id) AS r
FROM {E} q, {E} x WHERE q.entity_id % 100 = 0) WHERE r <= 10"""


def _asked(d: Dataset) -> DataFrame:
    """The query set: every row whose id is divisible by 100."""
    return d.vectors.where("entity_id % 100 = 0")


def _search_all(d: Dataset, metric: str) -> DataFrame:
    return S.knn_search(d.vectors, _asked(d), 10, metric).select("query_id", "entity_id", F.round("score", 6).alias("score"))


@query(_searches("cosine"))
def knn_search_cosine(d: Dataset) -> DataFrame:
    return _search_all(d, "cosine")


@query(_searches("dot"))
def knn_search_dot(d: Dataset) -> DataFrame:
    return _search_all(d, "dot")


@query(_searches("euclidean"))
def knn_search_euclidean(d: Dataset) -> DataFrame:
    return _search_all(d, "euclidean")


@query()
def knn_index(d: Dataset) -> DataFrame:
    """Approximate neighbours of the query set by an inverted-file index over all vectors; a test holds its recall at 0.9 or more."""
    return S.ivf_knn(S.ivf_index(d.vectors), _asked(d), 10, probes=11).select("query_id", "entity_id", F.round("score", 6).alias("score"))


@query(f"SELECT a.entity_id AS \"left\", b.entity_id AS \"right\", round(list_cosine_similarity(a.e, b.e), 6) AS score FROM {E} a JOIN {E} b USING (label) WHERE a.entity_id % 100 = 0 AND list_cosine_similarity(a.e, b.e) >= 0.25")
def similarity_join(d: Dataset) -> DataFrame:
    """Pairs of the query set and all vectors of the same type, over a threshold."""
    return S.threshold_join(_asked(d), d.vectors, "label", 0.25).select("left", "right", F.round("score", 6).alias("score"))


@query(f"""SELECT CASE WHEN entity_id % 5 = 0 THEN 'new' ELSE 'old' END AS kind, count(*) AS n, round(sum(e[1] * CASE WHEN entity_id % 5 = 0 THEN 2 ELSE 1 END), 4) AS total FROM {E} WHERE entity_id % 3 <> 0 GROUP BY 1
UNION ALL SELECT 'rejected', sum((entity_id % 7 = 0)::INT)::BIGINT, NULL FROM {E} WHERE entity_id % 5 = 0 AND entity_id % 35 = 0""")
def vector_updates(d: Dataset) -> DataFrame:
    """Every fifth vector is replaced by its double, those of wrong length rejected, and every third deleted."""
    v, k = d.vectors.select("entity_id", "embedding"), F.col("entity_id")
    double = v.where("entity_id % 5 = 0").select("entity_id", F.transform("embedding", lambda x: x * 2).alias("embedding"))
    short = v.where("entity_id % 35 = 0").select((-k - 1).alias("entity_id"), F.slice("embedding", 1, 63).alias("embedding"))
    now, rejected = S.upsert_vectors(v, double.unionByName(short), 64)
    left = S.delete(now, v.where("entity_id % 3 = 0"))
    g = left.groupBy(F.when(k % 5 == 0, "new").otherwise("old").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum(F.get("embedding", F.lit(0))), 4).alias("total"))
    return g.unionByName(rejected.agg(F.lit("rejected").alias("kind"), F.count("*").alias("n"), F.lit(None).cast("double").alias("total")))


@query(f"""SELECT label, entity_id, round(s, 6) AS score FROM (SELECT label, entity_id, list_cosine_similarity(e, q) s, row_number() OVER (PARTITION BY label ORDER BY list_cosine_similarity(e, q) DESC, entity_id) r FROM {E}, {Q}) WHERE r <= 3""")
def knn_per_type(d: Dataset) -> DataFrame:
    s = S.scored(d.vectors, S.vector_of(d.vectors, 0))
    w = W.partitionBy("label").orderBy(F.desc("score"), "entity_id")
    return s.withColumn("r", F.row_number().over(w)).where("r <= 3").select("label", "entity_id", F.round("score", 6).alias("score"))


@query(f"SELECT count(*) AS n, sum((len(e) = 64 AND list_bool_and(list_transform(e, lambda x: isfinite(x))))::INT)::BIGINT AS valid FROM {E}")
def vector_validation(d: Dataset) -> DataFrame:
    return d.vectors.agg(F.count("*").alias("n"), F.sum(V.is_valid(F.col("embedding"), 64).cast("int")).alias("valid"))


@query(f"SELECT entity_id FROM {E} WHERE 'type_' || label = 'type_3'")
def lookup_by_type(d: Dataset) -> DataFrame:
    return d.vectors.withColumn("types", F.array(F.concat(F.lit("type_"), F.col("label").cast("string")))).where(F.array_contains("types", "type_3")).select("entity_id")


@query(f"""WITH v AS (SELECT entity_id FROM {E}, {Q} ORDER BY list_cosine_similarity(e, q) DESC, entity_id LIMIT 10),
t AS (SELECT doc_id AS entity_id FROM documents WHERE list_contains({TOKENS.format("text")}, 'the') ORDER BY doc_id LIMIT 10)
SELECT entity_id, 'text' AS via FROM t UNION ALL SELECT entity_id, 'vector' FROM v WHERE entity_id NOT IN (SELECT entity_id FROM t)""")
def combine_text_vector(d: Dataset) -> DataFrame:
    text = d.documents.where(T.contains_all(F.col("body"), "the")).orderBy("entity_id").limit(10).select("entity_id", F.lit("text").alias("via"))
    return S.combine(text, S.knn(d.vectors, S.vector_of(d.vectors, 0), 10).select("entity_id", F.lit("vector").alias("via")))


@query(f"SELECT d.doc_id AS entity_id FROM documents d JOIN (SELECT entity_id FROM {E}) e ON d.doc_id = e.entity_id WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def intersect_modalities(d: Dataset) -> DataFrame:
    return S.intersect(d.documents, d.vectors, d.semantic)


@query("""WITH t AS (SELECT doc_id AS entity_id, %s AS ts FROM documents), c AS (SELECT entity_id, len(ts) dl, len(list_filter(ts, lambda x: x = 'the')) a, len(list_filter(ts, lambda x: x = 'que')) b FROM t),
s AS (SELECT count(*) n, avg(dl) al, sum((a > 0)::INT) da, sum((b > 0)::INT) db FROM c)
SELECT entity_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / al)), 6) AS score
FROM c, s WHERE a + b > 0 ORDER BY ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / al)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / al)) DESC, entity_id LIMIT 20""" % TOKENS.format("substr(text, 1, 40) || ' ' || text"))
def bm25_topk(d: Dataset) -> DataFrame:
    return S.bm25(d.documents, "the que", 20).select("entity_id", F.round("score", 6).alias("score"))


@query(f"SELECT doc_id AS entity_id FROM documents WHERE list_contains({TOKENS.format('text')}, 'the') AND list_contains({TOKENS.format('text')}, 'with')")
def fulltext_contains(d: Dataset) -> DataFrame:
    return d.documents.where(T.contains_all(F.col("body"), "the with")).select("entity_id")


@query("SELECT doc_id AS entity_id FROM documents WHERE contains(lower(text), 'released under the mit')")
def fulltext_phrase(d: Dataset) -> DataFrame:
    return d.documents.where(T.contains_all(F.col("body"), '"released under the MIT"')).select("entity_id")


@query("SELECT doc_id AS entity_id FROM documents WHERE regexp_matches(text, 'Lic[a-z]+ under [A-Z]+')")
def fulltext_matches(d: Dataset) -> DataFrame:
    return d.documents.where(F.col("body").rlike("Lic[a-z]+ under [A-Z]+")).select("entity_id")


@query("""SELECT doc_id AS entity_id, regexp_replace(substr(text, greatest(instr(lower(text), 'license') - 30, 1)::BIGINT, 60), '(license)', '<b>\\1</b>', 'gi') AS snippet
FROM documents WHERE contains(lower(text), 'license')""")
def text_snippet(d: Dataset) -> DataFrame:
    return d.documents.select("entity_id", T.snippet(F.col("body"), "license").alias("snippet")).where("snippet is not null")


@query(f"""SELECT entity_id, score FROM (SELECT doc_id AS entity_id, (3 * len(list_filter({TOKENS.format('substr(text, 1, 40)')}, lambda x: levenshtein({CHARS}, 'that') <= 1)) + 2 * len(list_filter({TOKENS.format('text')}, lambda x: levenshtein({CHARS}, 'that') <= 1)))::DOUBLE AS score FROM documents) WHERE score > 0""")
def weighted_match(d: Dataset) -> DataFrame:
    return S.weighted_match(d.documents, "that", {"title": 3.0, "body": 2.0})


@query("""WITH g AS (SELECT doc_id AS entity_id, list_distinct(list_transform(range(1, greatest(length(substr(text, 1, 40)) - 1, 2)), lambda i: substr(lower(substr(text, 1, 40)), i, 3))) AS g FROM documents WHERE text IS NOT NULL),
q AS (SELECT list_distinct(list_transform(range(1, length('the thing') - 1), lambda i: substr('the thing', i, 3))) AS q)
SELECT entity_id, round(len(list_intersect(g, q)) / len(q), 6) AS score FROM g, q WHERE len(list_intersect(g, q)) > 0""")
def trigram_match(d: Dataset) -> DataFrame:
    q = T.trigrams(F.lit("the thing"))
    hits = F.size(F.array_intersect(T.trigrams(F.col("title")), q))
    return d.documents.where("title is not null").select("entity_id", F.round(hits / F.size(q), 6).alias("score")).where("score > 0")


@query("""SELECT entity_id, score, r AS rank, round(1 - 0.1 * r, 6) AS rank_score FROM (SELECT doc_id AS entity_id, n_chars AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS r FROM documents) WHERE r < 15""")
def rank_score(d: Dataset) -> DataFrame:
    hits = d.documents.select("entity_id", F.col("n_chars").alias("score"))
    return S.rank_score(hits, 15).select("entity_id", "score", F.col("rank").cast("long").alias("rank"), F.round("rank_score", 6).alias("rank_score"))


@query(f"""SELECT doc_id AS entity_id, list_contains(ws, 'the') AND NOT list_contains(ws, 'que') AND NOT contains(lower(text), 'released under') AS strict, list_contains(ws, 'the') OR lang = 'fr' AS loose
FROM (SELECT *, {TOKENS.format("text")} AS ws FROM documents WHERE text IS NOT NULL)""")
def text_boolean(d: Dataset) -> DataFrame:
    """+the -que -"released under", and: the OR lang:fr."""
    fields = {"body": F.col("body"), "lang": F.col("lang")}
    strict = T.boolean(fields, must=["body:the"], must_not=["body:que", 'body:"released under"'])
    return d.documents.where("body is not null").select("entity_id", strict.alias("strict"), T.boolean(fields, should=["body:the", "lang:fr"]).alias("loose"))


@query("SELECT doc_id AS entity_id, lang, source FROM documents WHERE lang = 'fr' AND source LIKE 'src1%' AND n_chars >= 500")
def field_filter(d: Dataset) -> DataFrame:
    return d.documents.where((F.col("lang") == "fr") & F.col("source").like("src1%") & (F.col("n_chars") >= 500)).select("entity_id", "lang", "source")


@query("SELECT doc_id AS entity_id FROM documents WHERE substr(text, 1, 40) LIKE 'Th%' OR text LIKE '%License%'")
def like_match(d: Dataset) -> DataFrame:
    return d.documents.where(F.col("title").like("Th%") | F.col("body").like("%License%")).select("entity_id")


@query("SELECT d.doc_id AS entity_id, d.lang, l.quality FROM documents d LEFT JOIN labels l USING (doc_id) WHERE contains(d.text, 'License')")
def text_to_entities(d: Dataset) -> DataFrame:
    return d.documents.where(F.col("body").contains("License")).join(d.semantic, "entity_id", "left").select("entity_id", "lang", "quality")
