"""Exact substring dedup by a distributed merge sort of suffixes.

Sorting every suffix of a corpus is neither needed nor affordable. A byte goes if a 100-byte string that covers it also
starts earlier, and equal 100-byte strings hold equal anchors: the leftmost least hash among their 20-byte grams. So
only suffixes at anchors count (about one byte in forty), and of those only the ones whose gram recurs in unlike
surroundings need to be compared byte by byte:

1. anchors with the window starts they serve, and a digest of the bytes those windows cover;
2. per gram and digest the first occurrence; later ones are removed whole, without their bytes being shipped;
3. grams with several digests: the suffixes of the first occurrences are sorted into front-coded runs, exchanged, and
   merged by a loser tree that carries common prefix lengths; windows of neighbours in that order are then compared.

A gram may stand in a third of all texts, each time in other surroundings; its suffixes would all meet in one task. The
windows of such hot grams are digested one by one instead, and meet by digest like the copies of step 2: exact as well,
in more rows, and spread over the cluster. A sample of documents tells the hottest grams beforehand, a bounded number;
any other gram with too many first occurrences for one merge goes the same way after step 2. Only the way depends on it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stash

#: Bytes of a window and of a gram. SPAN: grams in a window.
WINDOW, GRAM = 100, 20
SPAN = WINDOW - GRAM + 1
#: Bytes hashed at once, and bytes of suffixes that a task sorts into one run for each target.
SEGMENT, RUN_BYTES = 1 << 20, 8 << 20

#: First occurrences from which a gram is hot, suffixes that a merge takes on average, and the share of documents (one in
#: so many) that tells the hottest grams beforehand: those of one anchor in HOTTEST or more, so at most HOTTEST of them.
HOT, MERGED, SAMPLE, HOTTEST = 50_000, 50_000, 16, 100_000

_PLACE = np.uint64((1 << 21) - 1)
_ODD = 0x9E3779B97F4A7C15 | 1
_ENTRY = struct.Struct("<HHHqq")


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_ODD, n, 1 << 64))


def _gram_hashes(buf: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the GRAM bytes from each position, by doubling: 1, 2, 4, 8, 16, then 16 + 4."""
    h = {1: buf.astype(np.uint64) + np.uint64(1)}
    for w in (1, 2, 4, 8):
        h[2 * w] = h[w][:-w] * _power(w) + h[w][w:]
    n = len(buf) - GRAM + 1
    x = h[16][:n] * _power(4) + h[4][16 : 16 + n]
    for shift, odd in ((32, 0xD6E8FEB86659FD93), (29, 0xA3B195354A39B70D)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
    return x ^ (x >> np.uint64(32))


def anchors(buf: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    """(span number, anchor position, first and last window start it serves, gram hash) inside the spans of buf."""
    x = _gram_hashes(buf)
    key = (x & ~_PLACE) | np.arange(len(x), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = np.minimum(key[: len(key) - (SPAN - width)], key[SPAN - width :])  # overlapping halves
    starts = np.concatenate([np.arange(s, e - WINDOW + 1) for s, e in spans])
    at = (key[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    pos = at[first]
    return np.searchsorted([s for s, _ in spans], pos, side="right") - 1, pos, starts[first], starts[last], x[pos].view(np.int64)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (doc_id, offset, bytes) of about SEGMENT bytes; a long text comes in pieces that share WINDOW - 1 bytes."""
    held, size = [], 0
    for b in batches:
        for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
            data = text.as_py() or b""
            for base in range(0, len(data) - WINDOW + 1, SEGMENT):
                part = data[base : base + SEGMENT + WINDOW - 1]
                if size + len(part) > SEGMENT and held:
                    yield held
                    held, size = [], 0
                held.append((doc_id, base, part))
                size += len(part)
    if held:
        yield held


def anchor_rows(texts: DataFrame, combine: bool, hot: frozenset[int] = frozenset()) -> DataFrame:
    """(h, ctx, doc, at[, n]) per anchor; combine: one row for equal (h, ctx) of a segment, the first, with their number.

    For anchors whose gram is hot, a row for each of their windows, (h, ctx) being the window's own 128-bit digest.

    at packs the anchor's position with the distances to the first and between the window starts it serves, so equal
    documents order by position.
    """

    grams = np.array(sorted(hot), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _segments(batches):
            raw = b"".join(p for _, _, p in held)
            ends = np.cumsum([len(p) for _, _, p in held]).tolist()
            spans = list(zip([0, *ends], ends))
            k, pos, p0, p1, h = anchors(np.frombuffer(raw, np.uint8), spans)
            digest = xxhash.xxh3_64_intdigest
            ctx = np.array([digest(raw[a:b]) for a, b in zip(p0.tolist(), (p1 + WINDOW).tolist())], np.uint64).view(np.int64)
            if len(grams) and (each := np.isin(h, grams)).any():
                n = (p1 - p0 + 1)[each]
                start = np.repeat(p0[each] - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[a : a + WINDOW]) for a in start.tolist()]), np.int64).reshape(-1, 2)
                rest = ~each
                k = np.concatenate([k[rest], np.repeat(k[each], n)])
                h, ctx = np.concatenate([h[rest], both[:, 0]]), np.concatenate([ctx[rest], both[:, 1]])
                pos, p0, p1 = (np.concatenate([x[rest], start]) for x in (pos, p0, p1))
            doc = np.array([d for d, _, _ in held], np.int64)[k]
            shift = np.array([base - s for (_, base, _), (s, _) in zip(held, spans)], np.int64)[k]
            at = ((pos + shift) << 14) | ((pos - p0) << 7) | (p1 - p0)
            cols = [h, ctx, doc, at]
            if combine:
                order = np.lexsort((at, doc, ctx, h))
                new = np.flatnonzero(np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])]))
                n = np.diff(np.concatenate([new, [len(order)]]))
                back = np.argsort(order[new])  # in the order of the text, which compresses better
                cols = [c[order[new]][back] for c in cols] + [n[back]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "ctx", "doc", "at", "n"][: len(cols)])

    return texts.mapInArrow(run, "h long, ctx long, doc long, at long" + ", n long" * combine)


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no comparison."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def write_run(entries: list[tuple[bytes, bytes, int, int]]) -> bytes:
    """Front-coded run of (suffix, left bytes, doc, at), sorted: each suffix by its common prefix with the one before."""
    out, before = [], b""
    for right, left, doc, at in sorted(entries):
        same = common_prefix(before, right)
        out += [_ENTRY.pack(same, len(right) - same, len(left), doc, at), right[same:], left]
        before = right
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(common prefix with the entry before, suffix, left bytes, doc, at)."""
    at, before = 0, b""
    while at < len(run):
        same, n, m, doc, place = _ENTRY.unpack_from(run, at)
        at += _ENTRY.size
        before = before[:same] + run[at : at + n]
        yield same, before, run[at + n : at + n + m], doc, place
        at += n + m


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """All entries in order, each with its common prefix with the entry before: a loser tree over the runs.

    Every loser keeps the length of its common prefix with the entry that beat it. The longer prefix with the last
    winner is the smaller suffix without a look at a byte; only equal lengths are compared, from that length on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    streams = [read_run(r) for r in runs]
    now: list[tuple | None] = [next(s, None) for s in streams] + [None] * (size - len(runs))
    same = [0] * size

    def beats(x: int, y: int) -> bool:
        """Whether x goes up against y; the loser's prefix length is brought up to date."""
        if now[x] is None or now[y] is None:
            return now[y] is None
        if same[x] != same[y]:
            return same[x] > same[y]
        a, b = now[x][1], now[y][1]
        k = common_prefix(a, b, same[x])
        first = a[k : k + 1] <= b[k : k + 1]
        same[y if first else x] = k
        return first

    losers = [0] * size
    level = list(range(size))
    node = size
    while len(level) > 1:
        node //= 2
        up = []
        for k in range(0, len(level), 2):
            x, y = level[k], level[k + 1]
            win, lose = (x, y) if beats(x, y) else (y, x)
            losers[node + k // 2] = lose
            up.append(win)
        level = up
    top = level[0]
    while now[top] is not None:
        yield (same[top], *now[top][1:])
        now[top] = next(streams[top], None)
        same[top] = now[top][0] if now[top] else 0
        node = (size + top) // 2
        while node:
            if not beats(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


def _later_windows(group: list[tuple[int, bytes, bytes, int, int]]) -> Iterator[tuple[int, int]]:
    """(doc, packed interval) of windows in a group of one gram's suffixes that an earlier one of the group also has."""
    n = len(group)
    spans = []
    for i, (same, right, left, doc, at) in enumerate(group):
        reach = max(same if i else 0, group[i + 1][0] if i + 1 < n else 0)  # the longest prefix shared with any other
        back = (at >> 7) & 127
        spans.append((max(back - (at & 127), WINDOW - reach), back))
    for r in range(min(lo for lo, _ in spans), max(hi for _, hi in spans) + 1):
        best: dict[bytes, tuple[int, int]] = {}
        own = []
        for (_, right, left, doc, at), (lo, hi) in zip(group, spans):
            if lo <= r <= hi:
                window = left[len(left) - r :] + right[: WINDOW - r]
                place = (doc, at >> 14)
                own.append((window, place))
                if best.get(window, place) >= place:
                    best[window] = place
        for window, place in own:
            if best[window] < place:
                yield place[0], (place[1] - r) << 8


def digested_windows(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, cut) as merged_windows gives, but every window meets its like by a 128-bit digest: for grams of any number of first occurrences."""
    by_doc = reps.groupBy("doc").agg(F.collect_list("at").alias("marks"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, text, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data, at = text.as_py(), marks.values.to_numpy()
                first, n = (at >> 14) - ((at >> 7) & 127), (at & 127) + 1
                start = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[a : a + WINDOW]) for a in start.tolist()]), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(start), doc)), pa.array(start)], names=["d1", "d2", "doc", "start"])

    every = texts.join(by_doc, "doc").select("doc", "text", "marks").mapInArrow(digests, "d1 long, d2 long, doc long, start long")
    first = every.groupBy("d1", "d2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = stash(first.select("d1", "d2", "first"), "first-windows")  # both sides of the join are then plain shuffles, so a hot window can be split
    return every.join(first, ["d1", "d2"]).where(F.struct("doc", "start") > F.col("first").cast("struct<doc: bigint, start: bigint>")).select("doc", F.shiftleft("start", 8).alias("cut"))


def merged_windows(reps: DataFrame, texts: DataFrame, targets: int) -> DataFrame:
    """(doc, cut) for the windows of first occurrences that an unlike first occurrence of the same gram has earlier.

    reps: (h, doc, at). A target gets whole grams; what it reads is its share of the first occurrences' bytes.
    """
    by_doc = reps.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("marks"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            blobs = [(t, write_run(e)) for t, e in sorted(held.items())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())], names=["target", "run"])

        held: dict[int, list] = {}
        size = 0
        for b in batches:
            for doc, text, marks in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                data = text.as_py()
                for mark in marks.as_py():
                    at = mark["at"]
                    pos, back = at >> 14, (at >> 7) & 127
                    end = pos - back + (at & 127) + WINDOW
                    held.setdefault(mark["h"] % targets, []).append((data[pos:end], data[pos - back : pos], doc, at))
                    size += end - pos + back + 100
                if size > RUN_BYTES:
                    yield made()
                    size = 0
        if held:
            yield made()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        group: list[tuple] = []
        for entry in merge_runs(pdf["run"].tolist()):
            if group and entry[0] < GRAM:
                found += _later_windows(group) if len(group) > 1 else ()
                group = []
            group.append(entry)
        found += _later_windows(group) if len(group) > 1 else ()
        return pd.DataFrame(found, columns=["doc", "cut"], dtype="int64")

    dealt = texts.join(by_doc, "doc").select("doc", "text", "marks").mapInArrow(runs, "target int, run binary")
    return dealt.groupBy("target").applyInPandas(merge, "doc long, cut long")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): every byte removed that a WINDOW-byte string covers which also starts earlier.

    Earlier: in a document of smaller doc_id, or before in the same; strings are judged on the input and lie in one
    document. A null text counts as empty. Rows that share a doc_id are one document of unlike versions: strings are
    not held against each other at equal places, and each row loses the places found for the id; a null doc_id counts
    as the smallest. Other columns are ignored; an empty table gives no rows. Nothing is capped.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    least = F.lit(-(1 << 63)).cast("long")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), least).alias("doc"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    part = anchor_rows(texts.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0), combine=True)
    part = stash(part.groupBy("h").agg(F.sum("n").alias("n")), "sampled-grams")
    total = part.agg(F.sum("n")).first()[0] or 0
    hot = frozenset(r["h"] for r in part.where((F.col("n") * SAMPLE >= HOT) & (F.col("n") * HOTTEST >= total)).select("h").collect())
    firsts = anchor_rows(texts, combine=True, hot=hot).repartition("h").groupBy("h", "ctx").agg(F.min(F.struct("doc", "at")).alias("first"), F.sum("n").alias("n"))
    firsts = firsts.withColumn("unlike", F.count("*").over(W.partitionBy("h"))).where("n > 1 or unlike > 1")
    firsts = stash(firsts.select("h", "ctx", "first.doc", "first.at", "n", "unlike"), "first-anchors")
    copies = anchor_rows(texts, combine=False, hot=hot).join(firsts.where("n > 1").select("h", "ctx", F.col("doc").alias("doc1"), F.col("at").alias("at1")), ["h", "ctx"])
    copies = copies.where("doc > doc1 or (doc = doc1 and at > at1)")
    cuts = copies.select("doc", F.expr("shiftleft(shiftright(at, 14) - (shiftright(at, 7) & 127), 8) | (at & 127)").alias("cut"))
    few, many = firsts.where(F.col("unlike").between(2, HOT)), firsts.where(F.col("unlike") > HOT)
    if n := few.count():
        targets = max(-(-n // MERGED), int(spark.conf.get("spark.sql.shuffle.partitions")))
        cuts = cuts.unionByName(merged_windows(few.select("h", "doc", "at"), texts, targets))
    if not many.isEmpty():
        cuts = cuts.unionByName(digested_windows(many.select("doc", "at"), texts))
    cuts = cuts.groupBy("doc").agg(F.collect_list("cut").alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, spans, kept = [], [], [], []
            for text, marks in zip(b.column(1), b.column(2)):
                data = text.as_py()
                n.append(len(data))
                if not marks.is_valid:
                    removed.append(0), spans.append(0), kept.append(data)
                    continue
                packed = np.sort(marks.values.to_numpy())
                start, end = packed >> 8, np.maximum.accumulate((packed >> 8) + (packed & 255) + WINDOW)
                head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
                s, e = start[head].tolist(), end[np.concatenate([head[1:], [len(start)]]) - 1].tolist()
                removed.append(sum(e) - sum(s)), spans.append(len(s))
                kept.append(b"".join(data[x:y] for x, y in zip([0, *e], [*s, len(data)])))
            cols = [pa.array(x, pa.int64()) for x in (n, removed, spans)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    out = texts.join(cuts, "doc", "left").select("doc", "text", "cuts").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))


def brute_force(rows: list[tuple[int, bytes]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The same by definition, for tests: doc_id: (bytes, removed, spans, SHA-256 of the rest)."""
    seen, out = set(), {}
    for doc_id, data in sorted(rows):
        gone = bytearray(len(data))
        for p in range(len(data) - window + 1):
            s = data[p : p + window]
            if s in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(s)
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[doc_id] = (len(data), sum(gone), sum(1 for p in range(len(gone)) if gone[p] and not (p and gone[p - 1])), hashlib.sha256(kept).hexdigest())
    return out


SQL = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
part AS (SELECT doc_id, q * 1024 AS base, b[q * 1024 + 1:q * 1024 + {1024 + WINDOW - 1}] AS part FROM d, unnest(range(0, n // 1024 + 1)) u(q)),
w AS (SELECT doc_id, base + p AS p, md5(part[p + 1:p + {WINDOW}]) AS k FROM part, unnest(range(0, greatest(0, least(1024, octet_length(part) - {WINDOW - 1})))) t(p)),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
marked AS (SELECT doc_id, p, (coalesce(p > lag(p) OVER o + {WINDOW}, true))::INT AS fresh FROM later WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
runs AS (SELECT doc_id, min(p) AS s, max(p) + {WINDOW} AS e FROM (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM runs),
cut AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans, max(e) AS last, string_agg(hex(b[before + 1:s]), '' ORDER BY s) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(unhex(kept) || b[last + 1:n], b)) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)
"""
