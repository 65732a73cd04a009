"""Line dedup by pairwise alignment of documents that share lines."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches, stash

#: Characters from which a line can bring documents together, and documents up to which a line is rare.
MIN_CHARS, RARE = 20, 10
#: Owners of a line: its first document in each of so many classes of documents (by a hash of doc_id).
OWNERS = 4
#: Classes for lines that no owner takes; after these, all documents with the line are asked.
WIDER = 64
#: Holders of a line in a part, when all are asked: a line of more is joined in several tasks.
PART = 1000


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i, j) with a[i] == b[j], ascending in both, by patience diff.

    Common ends are matched first; lines found once on either side are anchors, thinned to a longest increasing
    chain; the gaps between anchors are aligned the same way. A gap without anchors stays unaligned.
    """
    found, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        at = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1 and in_b.get(x) == 1}
        tops: list[int] = []
        piles: list[tuple[int, int, int]] = []  # (i, j, the entry that ends the pile to the left)
        last: list[int] = []
        for j in range(b0, b1):
            if (i := at.get(b[j])) is not None:
                k = bisect_left(tops, i)
                piles.append((i, j, last[k - 1] if k else -1))
                tops[k : k + 1] = [i]
                last[k : k + 1] = [len(piles) - 1]
        chain, k = [], last[-1] if last else -1
        while k >= 0:
            i, j, k = piles[k]
            chain.append((i, j))
        right = (a1, b1)
        for i, j in chain:
            todo.append((i + 1, right[0], j + 1, right[1]))
            found.append((i, j))
            right = (i, j)
        if chain:
            todo.append((a0, right[0], b0, right[1]))
    return sorted(found)


def blocks(pairs: list[tuple[int, int]], telling: list[bool]) -> list[tuple[int, int]]:
    """Runs [start, end) of the later document's lines that are aligned line by line and hold a telling one."""
    out: list[list[int]] = []
    before = None
    for i, j in pairs:
        if before == (i - 1, j - 1):
            out[-1][1] = j + 1
        else:
            out.append([j, j + 1])
        before = (i, j)
    return [(x, y) for x, y in out if any(telling[x:y])]


def removed_runs(docs: DataFrame, min_chars: int = MIN_CHARS, rare: int | None = RARE) -> DataFrame:
    """(doc_id, runs): the runs of line numbers [s, e) to remove, for documents that have any.

    With ``rare`` None, what aligning every pair of documents with a common line of ``min_chars`` or more removes: see
    every_pair(). Else a stricter rule, by owners: the smallest doc_ids that have a line, one in each of OWNERS classes of
    documents. A later document pairs with an owner if they share a line that at most ``rare`` documents have, or two such
    lines of any frequency.
    """
    small_batches(docs.sparkSession, 2000)
    trimmed = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)).alias("ls"))
    hashes, long_ones = F.transform("ls", lambda x: F.xxhash64(x)), F.transform("ls", lambda x: F.length(x) >= min_chars)
    seqs = trimmed.select("doc_id", F.md5(F.array_join("ls", "\n")).alias("digest"), hashes.alias("hs"), long_ones.alias("telling"))
    runs = every_pair(seqs) if rare is None else aligned(rare_pairs(trimmed, min_chars, rare), seqs)
    return runs.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))


def owners_of(part: Column) -> list[Column]:
    """Aggregates: the smallest doc_id of each class."""
    return [F.min(F.when(part == k, F.col("doc_id"))).alias(f"first{k}") for k in range(OWNERS)]


def rare_pairs(trimmed: DataFrame, min_chars: int, rare: int) -> DataFrame:
    """(owner, doc_id) by the stricter rule."""
    lines = trimmed.select("doc_id", F.explode(F.array_distinct(F.transform(F.filter("ls", lambda x: F.length(x) >= min_chars), lambda x: F.xxhash64(x)))).alias("h"))
    owners = lines.groupBy("h").agg(*owners_of(class_of(OWNERS)), F.count("*").alias("df")).where("df > 1")
    owners = stash(owners, "line-owners")  # both sides of the join below are then plain shuffles, so a hot line can be split
    of = F.filter(F.array(*(f"first{k}" for k in range(OWNERS))), lambda x: x < F.col("doc_id"))
    pairs = lines.join(owners, "h").select("doc_id", "df", F.explode(of).alias("owner")).groupBy("owner", "doc_id").agg(F.count("*").alias("shared"), F.min("df").alias("rarest"))
    return pairs.where((F.col("rarest") <= rare) | (F.col("shared") > 1)).select("owner", "doc_id")


def class_of(classes: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(classes))


def aligned(pairs: DataFrame, seqs: DataFrame) -> DataFrame:
    """(doc_id, run): the distinct runs that the pairs (owner, doc_id) take from doc_id."""
    both = pairs.join(seqs.select("doc_id", "hs", "telling"), "doc_id").join(seqs.select(F.col("doc_id").alias("owner"), F.col("hs").alias("of_owner")), "owner")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for b in batches:
            runs = [
                [{"s": s, "e": e} for s, e in blocks(patience(x.as_py(), y.as_py()), t.as_py())]
                for x, y, t in zip(b.column(1), b.column(2), b.column(3))
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, kind)], names=["doc_id", "runs"])

    found = both.select("doc_id", "of_owner", "hs", "telling").mapInArrow(align, "doc_id long, runs array<struct<s: int, e: int>>")
    return found.select("doc_id", F.explode("runs").alias("run")).distinct()


def line_keys(hs: list[int], telling: list[bool]) -> dict[int, list[int]]:
    """Line numbers by key. A pair takes a line from the later document only if both have one of its keys.

    A telling line is its own key. A short one goes in a block with a telling line, so with all lines from it to the next
    telling one on either side: these two runs of lines, hashed, are its keys.
    """
    at: dict[int, list[int]] = defaultdict(list)
    for salt, order in ((1, range(len(hs))), (2, range(len(hs) - 1, -1, -1))):
        key = None
        for j in order:
            if telling[j]:
                key = hs[j]
                if salt == 1:
                    at[key].append(j)
            elif key is not None:
                key = hash((key, hs[j], salt))  # of integers: the same in every process
                at[key].append(j)
    return at


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(d, k, at) for d, *x in zip(*(c.to_pylist() for c in b.columns)) for k, at in line_keys(*x).items()]
        columns = zip(*rows) if rows else ([], [], [])
        types = pa.int64(), pa.int64(), pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "key", "at"])


def meeting_keys(hs: list[int], telling: list[bool]) -> tuple[set[int], dict[int, tuple[int, int]]]:
    """(ends, anchors): a pair takes lines only if the documents share an end, or an anchor with other values in both places.

    What patience() aligns are the common ends, and more only if a line occurs once between them on either side. In both
    documents the occurrence before such an anchor, if any, lies in the common start, and the one after it in the common
    end; so start and end up to these are part of its key. Its values are the start up to the anchor and the end from it: where
    one of them is common, the line is no anchor but lies in that start or end. Ends count with a telling line: all documents
    that share one take the same from a later document.
    """
    chain = lambda xs: list(accumulate(xs, lambda h, x: hash((h, x)), initial=0))
    starts, tails = chain(hs), chain(reversed(hs))[::-1]  # of the first j lines, and of the lines from j
    before, after, seen = [], [], {}
    for j, x in enumerate(hs):
        before.append(seen.get(x, 0))
        seen[x] = starts[j + 1]
    seen = {}
    for j in range(len(hs) - 1, -1, -1):
        after.append(seen.get(hs[j], 0))
        seen[hs[j]] = tails[j]
    anchors = {hash(k): values for k, values in zip(zip(hs, before, reversed(after)), zip(starts[1:], tails))}
    at = [j for j, t in enumerate(telling) if t]
    ends = {hash((1, h)) for h in starts[at[0] + 1 :]} | {hash((2, h)) for h in tails[: at[-1] + 1]} if at else set()
    return ends, anchors


def _meeting_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [(d, *meeting_keys(*x)) for d, *x in zip(*(c.to_pylist() for c in b.columns))]
        rows = [(d, m, None, None) for d, ends, _ in found for m in ends] + [(d, m, *values) for d, _, anchors in found for m, values in anchors.items()]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "meet", "upto", "since"])


def varied(anchors: DataFrame, *by: str) -> DataFrame:
    """Rows of groups whose anchor isn't in the same start or the same end throughout."""
    groups = anchors.groupBy(*by).agg(F.min("upto").alias("u"), F.max("upto").alias("v"), F.min("since").alias("s"), F.max("since").alias("t"))
    return anchors.join(bounded(groups.where("u < v and s < t").select(*by)), list(by), "left_semi")


def meeting_pairs(left: DataFrame, held: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc_id, owner): for the open lines left, all earlier holders not asked that can take any; see meeting_keys().

    Of documents with a common end the first is enough. The rest must share an anchor besides the open line's key.
    """
    holders = held.select("doc_id", "key", "df").join(bounded(left.select("key").distinct()), "key", "left_semi")
    of_holders = texts.select("doc_id", "hs", "telling").join(bounded(holders.select("doc_id").distinct()), "doc_id", "left_semi")
    meets = stash(of_holders.mapInArrow(_meeting_keys, "doc_id long, meet long, upto long, since long"), "line-meets")

    ends = meets.where("upto is null").select("doc_id", "meet")
    first = ends.groupBy("meet").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last")
    of_ends = ends.join(bounded(left.select("doc_id").distinct()), "doc_id", "left_semi").join(bounded(first), "meet").where("owner < doc_id")

    anchors = stash(varied(meets.where("upto is not null"), "meet"), "line-anchors")
    parts = F.ceil(F.col("df") / PART)
    to = varied(holders.join(anchors, "doc_id"), "key", "meet").withColumn("part", F.pmod(F.xxhash64("doc_id"), parts)).alias("to")
    asking = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).join(anchors, "doc_id").alias("by")
    open_to = "to.doc_id < by.doc_id and to.upto <> by.upto and to.since <> by.since and not array_contains(by.asked, to.doc_id)"
    pairs = asking.join(to, [F.col(f"by.{c}") == F.col(f"to.{c}") for c in ("key", "part", "meet")]).where(open_to)
    return of_ends.select("doc_id", "owner").union(pairs.select("by.doc_id", "to.doc_id")).distinct()


def every_pair(seqs: DataFrame) -> DataFrame:
    """(doc_id, run): what aligning each document with all earlier ones removes; seqs: (doc_id, digest, hs, telling).

    Documents of the same lines are one: the first stands for all, and the others go whole. Of the rest, a document is first
    aligned with the owners of its keys (line_keys()), one in each of OWNERS classes of documents. A line taken by then is
    settled, whatever other documents have it. Only lines that are left, and that more earlier documents have, ask on: one
    document in each of WIDER classes, and at last all that have a key of such a line and share an end or an anchor besides
    (meeting_pairs()). So every line that some pair takes goes, while pairs that can add nothing are never made.
    """
    whole = seqs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("hs").alias("hs"), F.first("telling").alias("telling"))
    texts = stash(whole.where(F.exists("telling", lambda x: x)), "line-texts")
    again = bounded(texts.where("n > 1").select("digest", F.col("doc_id").alias("first"), F.size("hs").alias("e")))
    copies = seqs.select("doc_id", "digest").join(again, "digest").where("doc_id > first").select("doc_id", F.struct(F.lit(0).alias("s"), "e").alias("run"))

    keys = stash(texts.select("doc_id", "hs", "telling").mapInArrow(_keys, "doc_id long, key long, at array<int>"), "line-keys")
    owners = keys.groupBy("key").agg(*owners_of(class_of(OWNERS)), F.count("*").alias("df")).where("df > 1")
    asked = F.filter(F.array(*(f"first{k}" for k in range(OWNERS))), lambda x: x.isNotNull())
    owners = stash(owners.select("key", "df", asked.alias("asked")), "line-owners")  # plain shuffles on both sides of the join, so a hot line can be split
    held = stash(keys.join(owners, "key"), "line-holders")
    earlier = lambda to: F.explode(F.filter(to, lambda x: x < F.col("doc_id"))).alias("owner")

    def open_lines(rows: DataFrame, runs: DataFrame) -> DataFrame:
        """rows whose lines the runs leave and of whose earlier holders some weren't asked."""
        gone = runs.groupBy("doc_id").agg(F.collect_list("run").alias("gone"))
        taken = lambda p: F.exists("gone", lambda r: (p >= r["s"]) & (p < r["e"]))
        rows = rows.where((F.array_min("asked") < F.col("doc_id")) & (F.col("df") > F.size("asked"))).join(gone, "doc_id", "left")
        rest = F.when(F.col("gone").isNull(), F.col("at")).otherwise(F.filter("at", lambda p: ~taken(p)))
        return stash(rows.select("doc_id", "key", "df", "asked", rest.alias("at")).where("size(at) > 0"), "line-left")

    found = [copies, stash(aligned(held.select("doc_id", earlier("asked")).distinct(), texts), "line-runs")]
    left = open_lines(held, found[-1])
    if not left.isEmpty():
        of_left = held.select("key", "doc_id").join(bounded(left.select("key").distinct()), "key", "left_semi")
        wider = of_left.groupBy("key", class_of(WIDER).alias("part")).agg(F.min("doc_id").alias("owner")).groupBy("key").agg(F.collect_list("owner").alias("wider"))
        left = left.join(wider, "key")
        found.append(stash(aligned(left.select("doc_id", earlier(F.array_except("wider", "asked"))).distinct(), texts), "line-runs"))
        left = open_lines(left.withColumn("asked", F.array_union("asked", "wider")), found[-1])
    if not left.isEmpty():
        found.append(stash(aligned(meeting_pairs(left, held, texts), texts), "line-runs"))
    return reduce(DataFrame.unionByName, found).distinct()


def without(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """docs with the runs' lines taken from text, and n_lines and n_removed; the other columns stay."""
    parts = F.split("text", "\n", -1)
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = docs.select(*own).join(removed.select("doc_id", F.col("runs").alias("_runs_to_remove")), "doc_id", "left")
    kept = F.filter(parts, lambda x, i: ~F.exists("_runs_to_remove", lambda r: (i >= r["s"]) & (i < r["e"])))
    out = out.withColumn("_lines_kept", F.when(F.col("_runs_to_remove").isNotNull(), kept))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts))
    cut = F.col("_lines_kept").isNotNull()
    text = F.when(cut, F.array_join("_lines_kept", "\n")).otherwise(F.col("text"))
    counts = [n.cast("long").alias("n_lines"), F.when(cut, n - F.size("_lines_kept")).otherwise(0).cast("long").alias("n_removed")]
    return out.select(*(text.alias("text") if c == "text" else F.col(c) for c in own), *counts)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, rare: int | None = RARE) -> DataFrame:
    """doc_id, text without the removed lines, n_lines, n_removed; one row for every row of docs.

    Lines are compared without outer spaces. Documents that removed_runs() pairs are aligned (with ``rare`` None to the
    effect of all pairs with a common line), and aligned blocks with a line of ``min_chars`` go from the later one. A null text stays null with no line. Rows that share a doc_id count
    as one document and lose the same blocks; rows without doc_id stay. Other columns are ignored. Empty table: no rows.
    """
    return without(docs.select("doc_id", "text"), removed_runs(docs, min_chars, rare))
