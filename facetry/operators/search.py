"""Similarity and text search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..shared import checkpoint

#: Query vectors that travel to the tasks at once.
QUERY_BLOCK = 1024

SCORES = {"cosine": V.cosine, "dot": V.dot, "euclidean": V.euclidean_similarity}


def vector_of(vectors: DataFrame, entity_id: int) -> Column:
    """One stored vector as a literal."""
    row = vectors.where(F.col("entity_id") == entity_id).select("embedding").first()
    if row is None:
        raise LookupError(f"no vector for {entity_id}")
    return F.array(*(F.lit(float(x)) for x in row["embedding"]))


def scored(vectors: DataFrame, query: Column, metric: str = "cosine") -> DataFrame:
    return vectors.withColumn("score", SCORES[metric](F.col("embedding"), query))


def knn(vectors: DataFrame, query: Column, k: int, metric: str = "cosine") -> DataFrame:
    """The k most similar, exact; ties by entity_id. One scan and a top-k, no shuffle of vectors."""
    return scored(vectors, query, metric).orderBy(F.desc("score"), "entity_id").limit(k)


def similar(vectors: DataFrame, query: Column, threshold: float = 0.9, metric: str = "cosine") -> DataFrame:
    return scored(vectors, query, metric).where(F.col("score") >= threshold)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of a row's k best, ties by id."""
    if len(ids) > k:
        near = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[near], ids[near]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _similarities(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of all rows of q (down) against all rows of x (across)."""
    if metric == "cosine":
        norms = np.outer(np.linalg.norm(q, axis=1), np.linalg.norm(x, axis=1))
        return np.divide(q @ x.T, norms, out=np.zeros_like(norms), where=norms > 0)
    if metric == "dot":
        return q @ x.T
    return 1 / (1 + np.sqrt(np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T), 0)))


def _block_knn(vectors: DataFrame, queries: list, k: int, metric: str) -> DataFrame:
    """(query_id, entity_id, score): a task's k best for each query of a block. queries: rows (entity_id, embedding[, cells])."""
    ids, q = [r["entity_id"] for r in queries], np.array([r["embedding"] for r in queries], float)
    probes = [set(r["cells"]) for r in queries] if "cell" in vectors.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)
        for b in batches:
            if not b.num_rows:
                continue
            own, x = b.column(0).to_numpy(), np.array(b.column(1).to_pylist(), float)
            cells = b.column(2).to_numpy() if probes else None
            for c in np.unique(cells) if probes else [None]:
                here = slice(None) if c is None else cells == c
                asked = range(len(ids)) if c is None else [i for i, p in enumerate(probes) if c in p]
                if not len(asked):
                    continue
                scores = _similarities(x[here], q[list(asked)], metric)
                for i, s in zip(asked, scores):
                    best[i] = _best(np.concatenate([best[i][0], s]), np.concatenate([best[i][1], own[here]]), k)
        n = [len(x) for _, x in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), n)), pa.array(np.concatenate([x for _, x in best])), pa.array(np.concatenate([s for s, _ in best]))], names=["query_id", "entity_id", "score"])

    columns = ["entity_id", "embedding", *(["cell"] if probes else [])]
    return vectors.select(*columns).mapInArrow(run, "query_id long, entity_id long, score double")


def knn_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, entity_id, score): the k most similar of all vectors for every row of queries, exact; ties by entity_id.

    Queries come in blocks of about ``block`` rows, drawn by a hash; a block travels to the tasks, which score their
    vectors against it as one matrix product and keep the k best per query. Vectors are never shuffled. Where both have
    a cell (ivf_index), a query meets only the vectors of its cells.
    """
    blocks = max(1, -(-queries.count() // block))
    found = None
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("entity_id"), F.lit(blocks)) == i).collect()
        if rows:
            part = _block_knn(vectors, rows, k, metric)
            found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, entity_id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "entity_id")
    return found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def ivf_index(vectors: DataFrame, cells: int = 16, sample_rows: int = 10_000, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """(vectors with ``cell``, centroids): an inverted-file index. k-means is fitted on a sample of at most about
    ``sample_rows`` rows; every vector is put into the cell of its nearest centroid."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, sample_rows / max(1, vectors.count()))
    taken = vectors.where(F.pmod(F.xxhash64("entity_id", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))).select(array_to_vector("embedding").alias("features"))
    centroids = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(taken).clusterCenters())
    return vectors.withColumn("cell", F.element_at(_nearest_cells(centroids, 1), 1)), centroids


def _nearest_cells(centroids: np.ndarray, n: int) -> Column:
    """The numbers of the n centroids nearest to embedding, nearest first."""
    d = [F.struct(V.euclidean(F.col("embedding"), F.array(*(F.lit(float(x)) for x in c))).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centroids)]
    return F.slice(F.transform(F.array_sort(F.array(*d)), lambda s: s["i"]), 1, n)


def ivf_knn(index: tuple[DataFrame, np.ndarray], queries: DataFrame, k: int, probes: int, metric: str = "cosine") -> DataFrame:
    """(query_id, entity_id, score): approximate neighbours, ranked exactly among the vectors of a query's ``probes`` nearest cells."""
    vectors, centroids = index
    return knn_search(vectors, queries.withColumn("cells", _nearest_cells(centroids, probes)), k, metric)


def threshold_join(a: DataFrame, b: DataFrame, on: str, threshold: float, metric: str = "cosine") -> DataFrame:
    """(left, right, score): pairs of rows with an equal blocking key ``on`` and a similarity over the threshold."""
    x = a.select(on, F.col("entity_id").alias("left"), F.col("embedding").alias("x"))
    y = b.select(on, F.col("entity_id").alias("right"), F.col("embedding").alias("y"))
    return x.join(y, on).withColumn("score", SCORES[metric](F.col("x"), F.col("y"))).where(F.col("score") >= threshold).select("left", "right", "score")


def upsert(rows: DataFrame, new: DataFrame, key: str = "entity_id") -> DataFrame:
    """rows with those of new in place of or beside them; new has one row per key."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new.select(*rows.columns))


def upsert_vectors(vectors: DataFrame, new: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(vectors after the upsert, rejected rows of new): vectors of another length, or with values that aren't finite, are rejected."""
    good = F.coalesce(V.is_valid(F.col("embedding"), dimensions), F.lit(False))
    return upsert(vectors, new.where(good)), new.where(~good)


def delete(rows: DataFrame, gone: DataFrame, key: str = "entity_id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def postings(docs: DataFrame, *columns: str) -> DataFrame:
    """(entity_id, token, tf): one row per token of a document."""
    joined = F.concat_ws(" ", *columns)
    return docs.select("entity_id", F.explode(T.tokens(joined)).alias("token")).groupBy("entity_id", "token").agg(F.count("*").alias("tf"))


def _equals(word: str):
    return lambda t: t == F.lit(word)


def bm25(docs: DataFrame, query: str, k: int, columns: tuple[str, ...] = ("title", "body"), k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(entity_id, score): the k best by BM25 over any of the query's words.

    Texts are split once: the token array is a generated column, so no later expression repeats the split, and what is
    left of a document, its length and the words' counts, is stored. Statistics and scores come from that small table.
    """
    words = sorted(set(query.lower().split()))
    ts = docs.select("entity_id", F.explode(F.array(T.tokens(F.concat_ws(" ", *columns)))).alias("ts"))
    tf = [F.size(F.filter("ts", _equals(w))).alias(f"tf{i}") for i, w in enumerate(words)]
    counted = checkpoint(ts.select("entity_id", F.size("ts").alias("dl"), *tf))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(words))))
    parts = []
    for i in range(len(words)):
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        parts.append(idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl"))))
    hits = counted.where(sum((F.col(f"tf{i}") for i in range(len(words))), F.lit(0)) > 0)
    # one row of statistics
    return hits.crossJoin(F.broadcast(stats)).select("entity_id", sum(parts, F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "entity_id").limit(k)


def weighted_match(docs: DataFrame, word: str, weights: dict[str, float], fuzz: int = 1) -> DataFrame:
    """(entity_id, score): weight times tokens within ``fuzz`` edits of the word, summed over fields."""
    near = lambda c: F.size(F.filter(T.tokens(F.col(c)), lambda t: F.levenshtein(t, F.lit(word)) <= fuzz))
    return docs.select("entity_id", sum((near(c) * w for c, w in weights.items()), F.lit(0.0)).alias("score")).where("score > 0")


def best_field_match(docs: DataFrame, word: str, weights: dict[str, float]) -> DataFrame:
    """(entity_id, field, score) of the field that matches best: weight times its tokens within the edits that the word's
    length allows (none up to 2 letters, one up to 5, else two). Ties go to the field named first."""
    word = word.lower()
    edits = 0 if len(word) < 3 else 1 if len(word) < 6 else 2
    near = lambda c: F.size(F.filter(T.tokens(F.col(c)), lambda t: F.levenshtein(t, F.lit(word), edits) >= 0))
    scored = F.array(*(F.struct(F.coalesce(near(c) * w, F.lit(0.0)).alias("score"), F.lit(-i).alias("order"), F.lit(c).alias("field")) for i, (c, w) in enumerate(weights.items())))
    return docs.select("entity_id", F.array_max(scored).alias("best")).select("entity_id", "best.field", "best.score").where("score > 0")


def rank_score(hits: DataFrame, k: int) -> DataFrame:
    """The k best with their position in the ranking and 1 - 0.1 x position beside the true score: a top-k first, so the
    numbering sees k rows."""
    pos = F.row_number().over(W.orderBy(F.desc("score"), "entity_id")) - 1
    return hits.orderBy(F.desc("score"), "entity_id").limit(k).withColumn("rank", pos).withColumn("rank_score", 1 - 0.1 * F.col("rank"))


def combine(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by entity_id; of an entity in both, the row of first."""
    return first.unionByName(second.join(first, "entity_id", "left_anti"))


def intersect(*hits: DataFrame) -> DataFrame:
    """Entities in all hit lists."""
    out = hits[0].select("entity_id").distinct()
    for h in hits[1:]:
        out = out.join(h.select("entity_id"), "entity_id", "left_semi")
    return out
