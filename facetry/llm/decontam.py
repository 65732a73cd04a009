"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, stash

WIDTH, PERCENT = 5, 80


def _words(text: str) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: str, width: int, of) -> Column:
    """One value per run of ``width`` words, ``of`` applied to the words' columns; empty for fewer words."""
    w = F.col(words)
    every = F.transform(w, lambda x, i: of(x, *(F.get(w, i + k) for k in range(1, width))))
    return F.slice(every, 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))


def _item_shingles(width: int, of) -> Column:
    """An item's shingles: runs of ``width`` words, or the whole of a shorter item."""
    out = _shingles("w", width, of)
    for k in range(width - 1, 0, -1):
        out = F.when(F.size("w") == k, _shingles("w", k, of)).otherwise(out)
    return out


def _doc_shingles(widths: list[int], of) -> Column:
    """A document's shingles of all ``widths``."""
    return F.concat(*(_shingles("w", k, of) for k in widths))


def _joined(*words: Column) -> Column:
    return F.concat_ws(" ", *words)


def _least(n: Column, percent: int) -> Column:
    """The least number of n shingles that is ``percent`` of them, in whole numbers."""
    return F.expr(f"({percent} * {n} + 99) div 100") if isinstance(n, str) else F.floor((n * percent + 99) / 100)


def sketches(items: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(item_id, h, need): the MinHash values by which items are sought; (item_id, shingle, total): all shingles.

    Items are partitioned by the power of two of their shingle count. A partition's sketch size exceeds the most
    shingles that an item of it may miss, so whatever contains enough of an item contains part of its sketch:
    ``need`` of the values at least.
    """
    w = items.where("item_id is not null").select("item_id", _words("text").alias("w"))
    sh = w.select("item_id", F.array_distinct(_item_shingles(width, _joined)).alias("s"), F.array_distinct(_item_shingles(width, F.xxhash64)).alias("h"))
    # rows of one item_id are one item: its shingles are the union of theirs
    sh = sh.where("size(s) > 0").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_set("s"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("h")))).alias("h"))
    sized = sh.select("*", F.size("s").alias("total"))
    upper = F.expr("shiftleft(1, cast(floor(log2(total)) as int) + 1) - 1")
    miss = F.col("total") - _least(F.col("total"), percent)
    k = F.least(F.col("total"), upper - _least(upper, percent) + 1)
    found = sized.select("item_id", F.explode(F.slice("h", 1, k.cast("int"))).alias("h"), (k - miss).cast("long").alias("need"))
    return found, sized.select("item_id", F.explode("s").alias("shingle"), F.col("total").cast("long").alias("total"))


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, shared, total, containment): documents that hold ``percent`` of an item's distinct shingles.

    Candidates share the needed part of an item's sketch; each is verified by its exact shingles, as strings. No item
    that is contained is missed. An item of fewer than ``width`` words is one shingle, all of it; documents give shingles
    of the widths that items have. Items without a word are never reported; null texts are empty; rows that share a doc_id
    count as one document, and likewise items; null ids are left out. Other columns are ignored. Empty tables: no rows.
    """
    found, wanted = sketches(items, width, percent)
    found, wanted = stash(found, "sketches"), stash(wanted, "item-shingles")
    widths = sorted(r["k"] for r in wanted.select((F.size(F.split("shingle", " "))).alias("k")).distinct().collect()) or [width]  # at most ``width`` values
    words = docs.where("doc_id is not null").select("doc_id", _words("text").alias("w"))
    hits = words.select("doc_id", F.explode(_doc_shingles(widths, F.xxhash64)).alias("h")).join(bounded(found, broadcast_rows), "h")
    candidates = hits.groupBy("doc_id", "item_id").agg(F.countDistinct("h").alias("got"), F.max("need").alias("need")).where("got >= need")
    candidates = stash(candidates.select("doc_id", "item_id"), "candidates")
    near = docs.where("doc_id is not null").select("doc_id", "text").join(bounded(candidates.select("doc_id").distinct(), broadcast_rows), "doc_id", "left_semi")
    near = near.select("doc_id", _words("text").alias("w"))
    held = near.select("doc_id", F.explode(F.array_distinct(_doc_shingles(widths, _joined))).alias("shingle"))
    shared = candidates.join(wanted, "item_id").join(held.distinct(), ["doc_id", "shingle"])
    counts = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"), F.max("total").alias("total"))
    return counts.where(F.col("shared") * 100 >= F.col("total") * percent).select("doc_id", "item_id", "shared", "total", F.round(F.col("shared") / F.col("total"), 6).alias("containment"))


SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') w FROM benchmark WHERE text IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+k-1], ' ') s FROM d, (SELECT DISTINCT least(len(w), {WIDTH}) AS k FROM b WHERE len(w) > 0) widths, unnest(range(1, len(w) - k + 2)) t(i)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+{WIDTH - 1}], ' ') s FROM b, unnest(range(1, len(w) - {WIDTH - 2})) t(i)
    UNION SELECT item_id, array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND {WIDTH - 1}),
n AS (SELECT item_id, count(*) total FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS shared, max(total) AS total, round(count(*) / max(total), 6) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 100 >= max(total) * {PERCENT}
"""
