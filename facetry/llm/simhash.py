"""SimHash near-duplicate classes through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, small_batches, stash
from .components import connected_components

#: Most rows of one block of a candidate group that a task compares with another block.
BLOCK_ROWS = 2048
#: Pairs held at once while a group is compared.
PAIRS_AT_ONCE = 1 << 20
#: Reference fingerprints of the distance tables.
PIVOTS = 24
#: Most rows of one block of a component whose shingle sets a task compares with another block.
SET_ROWS = 1024
#: Documents sampled for frequent shingles, and most of these.
SAMPLE_ROWS, HOT_SHINGLES = 5000, 50_000

_BITS = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)


def shingle_digests(text: bytes, width: int) -> bytes:
    """XXH64 (seed 42, big-endian) of every shingle of ``width`` words, one after another.

    A-Z count as a-z; words are runs without ASCII white space. Fewer words than ``width``: the whole
    sequence is the only shingle. No word: nothing.
    """
    words = text.lower().split()
    if not words:
        return b""
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - width].tolist()]
    digest = xxhash.xxh64_digest
    return b"".join([digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())])


def _counts(octets: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set, octets: rows of 8 bytes."""
    if len(octets) <= 256:
        return np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    return np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """A further 64-bit hash from one, by a multiply-xorshift round that depends on the word's number."""
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * word) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def fingerprint(text: bytes, width: int = 4, words: int = 1, repeats: bool = True) -> bytes:
    """SimHash of 64 x ``words`` bits: a bit is set if it is set in over half the shingle hashes, repeats included or not."""
    octets = np.frombuffer(shingle_digests(text, width), np.uint8).reshape(-1, 8)
    if not repeats:
        octets = np.unique(octets.reshape(-1).view("u8")).view(np.uint8).reshape(-1, 8)
    return _majority(octets, words)


def _majority(octets: np.ndarray, words: int) -> bytes:
    """SimHash of 64 x ``words`` bits of shingle hashes, rows of 8 bytes."""
    n = len(octets)
    if not n:
        return bytes(8 * words)
    parts = [octets]
    if words > 1:
        h = octets.reshape(-1).view(">u8").astype(np.uint64)
        parts += [_mixed(h, k).astype(">u8").view(np.uint8).reshape(-1, 8) for k in range(1, words)]
    return b"".join(np.packbits(_counts(p) * 2 > n).tobytes() for p in parts)


def distinct_shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending."""
    return np.unique(np.frombuffer(shingle_digests(text, width), ">u8").astype(np.uint64))


def fingerprints(docs: DataFrame, width: int = 4, words: int = 1, repeats: bool = True) -> DataFrame:
    """(doc_id, fp binary) for every row; a null text counts as empty, whose fingerprint is zero."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", width, words, repeats) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.binary())], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary")


def pigeonhole_masks(max_distance: int) -> list[list[int]]:
    """Bit sets of which two 64-bit fingerprints within ``max_distance`` agree on at least one: exact.

    The bits are cut into max_distance + 2 segments; at most max_distance of them differ, so two agree.
    """
    segments = [s.tolist() for s in np.array_split(np.arange(64), max_distance + 2)]
    return [a + b for a, b in combinations(segments, 2)]


def band_masks(words: int, bands: int, bits: int, seed: int = 7) -> list[list[int]]:
    """Random bit sets for fingerprints of several words; recall per pair is 1 - (1 - (1 - p)^bits)^bands, p: share of differing bits."""
    rng = np.random.default_rng(seed)
    return [sorted(rng.choice(64 * words, bits, replace=False).tolist()) for _ in range(bands)]


def _pivots(words: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, (PIVOTS, words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int16)


def _join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the classes of a[i] and b[i] are merged; a label is the class's first index."""
    while True:
        x, y = labels[a], labels[b]
        if not (differ := x != y).any():
            return labels
        np.minimum.at(labels, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while ((up := labels[labels]) != labels).any():
            labels = up


def pivot_distances(fps: np.ndarray) -> np.ndarray:
    """Rows of PIVOTS bytes: the Hamming distances to the reference fingerprints, 255 at most (which keeps them a lower bound)."""
    return np.stack([np.minimum(_distance(fps, p), 255) for p in _pivots(fps.shape[1])], axis=1).astype(np.uint8)


def with_pivots(classes: DataFrame, words: int) -> DataFrame:
    """classes (node long, fp binary) with ``pivots`` binary, the row of the distance table: made once per fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
            table = [r.tobytes() for r in pivot_distances(fps)] if len(fps) else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(table, pa.binary())], names=["node", "fp", "pivots"])

    return classes.select("node", "fp").mapInArrow(run, "node long, fp binary, pivots binary")


def _linked(fps: np.ndarray, tables: np.ndarray, group: np.ndarray, own: np.ndarray, crossed: np.ndarray, limit: int) -> np.ndarray:
    """Labels of rows linked inside their group. tables: a row of distances per pivot; group: sorted group numbers; crossed: the group compares rows of unlike own only."""
    n = len(fps)
    labels = np.arange(n)
    ends = np.searchsorted(group, group, side="right")  # a row's partners are the later rows of its group
    fan = ends - np.arange(n) - 1
    done = np.cumsum(fan)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        a = np.repeat(np.arange(at, to), fan[at:to])
        b = np.arange(len(a)) - np.repeat(np.cumsum(fan[at:to]) - fan[at:to], fan[at:to]) + a + 1
        keep = ~crossed[a] | (own[a] != own[b])
        keep &= labels[a] != labels[b]
        a, b = a[keep], b[keep]
        for t in tables:  # triangle inequality: a pair over the limit in any coordinate is over it in full
            keep = np.abs(t[a] - t[b]) <= limit
            a, b = a[keep], b[keep]
        keep = _distance(fps[a], fps[b]) <= limit
        labels = _join_labels(labels, a[keep], b[keep])
        at = to
    return labels


def links(classes: DataFrame, masks: list[list[int]], words: int, max_distance: int) -> DataFrame:
    """(a, b): links of at most ``max_distance`` bits that connect all that the masks bring together.

    classes: (node long, fp binary, pivots binary), one row per distinct fingerprint. Rows that agree on a mask's bits form a group.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            raw = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            bits = np.unpackbits(raw, axis=1).astype(np.int64)
            for k, mask in enumerate(masks):
                key = bits[:, mask] @ (1 << np.arange(len(mask))) + (k << 32)
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0)], names=["key", "node"])

    return group_links(classes.select("node", "fp").mapInArrow(keyed, "key long, node long"), classes, words, max_distance)


def group_links(keys: DataFrame, classes: DataFrame, words: int, max_distance: int) -> DataFrame:
    """(a, b): links of at most ``max_distance`` bits that connect all that shares a key. keys: (key long, node long).

    Groups over BLOCK_ROWS are cut into blocks and each pair of blocks is one unit of work, so no task gets an
    unbounded group. A unit gives a spanning forest of its links, never all pairs.
    """
    # stored, so that the join below has plain shuffles on both sides and a hot key can be split
    counts = stash(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key-counts")
    parts = F.ceil(F.col("n") / BLOCK_ROWS)
    units = (
        keys.join(counts, "key")
        .select("key", "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("own"))
        .select("key", "node", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node")
        .join(classes.select("node", "fp", "pivots"), "node")  # fingerprints travel only with keys that recur
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            i, j, own, node = (t.column(c).to_numpy() for c in ("i", "j", "own", "node"))
            fps = np.frombuffer(b"".join(t.column("fp").to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)
            tables = np.frombuffer(b"".join(t.column("pivots").to_pylist()), np.uint8).reshape(-1, PIVOTS).T.astype(np.int16)
            key = t.column("key").to_numpy()
            group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))])
            labels = _linked(fps, tables, group, own, i != j, max_distance)
            at = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(node[labels[at]]), pa.array(node[at])], names=["a", "b"])

        for b in batches:  # sorted by group: solve all but the last group, which may go on
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([*held, b])
            last = [t.column(c)[-1].as_py() for c in ("key", "i", "j")]
            same = np.logical_and.reduce([t.column(c).to_numpy() == x for c, x in zip(("key", "i", "j"), last)])
            cut = int(np.argmax(same))
            if cut:
                yield solve(t.slice(0, cut))
            held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held))

    # sorted by node as well, the smallest node is the root of a unit's forest, so units that overlap give equal links
    dealt = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    # A node has at most one root per unit it is in. Its other roots are tied to the smallest one in its place, which
    # keeps what is connected and leaves about two links a node.
    roots = dealt.mapInArrow(compare, "a long, b long").groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("roots"))
    tied = roots.select("b", F.element_at("roots", 1).alias("a"), F.explode("roots").alias("root"))
    return tied.select("a", F.when(F.col("a") == F.col("root"), F.col("b")).otherwise(F.col("root")).alias("b")).distinct()


def simhash_classes(docs: DataFrame, width: int = 4, words: int = 1, max_distance: int = 4, masks: list[list[int]] | None = None, repeats: bool = True) -> DataFrame:
    """(doc_id, fp binary, component_id): component_id is the smallest doc_id reachable by links.

    Fingerprints link at ``max_distance`` differing bits or fewer. With one word the default masks lose no link.
    Null and empty texts have fingerprint zero and link like any other; equal texts share a class; repeated rows
    each get a row; a null doc_id keeps its row and takes the class's id. An empty table gives no rows.
    Columns besides doc_id and text are ignored.
    """
    masks = masks or pigeonhole_masks(max_distance)
    small_batches(docs.sparkSession)
    fps = stash(fingerprints(docs, width, words, repeats), "fingerprints")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    classes = stash(with_pivots(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), words), "classes")
    found = links(classes.where("node is not null"), masks, words, max_distance)
    labels = connected_components(found, "a", "b")
    named = classes.join(labels, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def _hot_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """Shingle hashes that recur in a sample of about SAMPLE_ROWS documents, ascending. They only order the prefixes: any set gives the same links."""
    n = docs.count()
    if not n:
        return np.array([], np.uint64)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 40)) < int((1 << 40) * min(1.0, SAMPLE_ROWS / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(distinct_shingles(t.as_py() or b"", width).view(np.int64))], names=["h"])

    taken = docs.where(draw).select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "h long")
    often = taken.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(HOT_SHINGLES)
    return np.sort(np.array([r["h"] for r in often.collect()], np.int64).view(np.uint64))


def jaccard_classes(docs: DataFrame, width: int, words: int, max_distance: int, percent: int) -> DataFrame:
    """(doc_id, component_id): documents linked by a Jaccard similarity of ``percent`` or more of their distinct shingles.

    Prefixes find the candidates and lose none: in any one order of all shingles, two sets that similar share one of
    the first n - ceil(n * percent / 100) + 1 shingles of both. Frequent shingles come last in the order. Candidates
    within ``max_distance`` bits of SimHash meet in components; inside these every pair not yet connected is compared
    by its exact shingle sets, in blocks of SET_ROWS. Equal sets are one node; null doc_ids are left out.
    """
    small_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    hot = _hot_shingles(rows, width)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(1):
                s = distinct_shingles(t.as_py() or b"", width)
                k = len(s) - (len(s) * percent + 99) // 100 + 1 if len(s) else 0
                late = hot[np.searchsorted(hot, s) % len(hot)] == s if len(hot) else np.zeros(len(s), bool)
                first = np.concatenate([s[~late], s[late]])[:k].view(np.int64)
                out.append((xxhash.xxh3_128_digest(s.tobytes()), _majority(s.astype(">u8").view(np.uint8).reshape(-1, 8), words), first))
            cols = [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "digest", "fp", "prefix"])

    made = stash(rows.mapInArrow(sets, "doc_id long, digest binary, fp binary, prefix array<long>"), "shingle-prefixes")
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    named = stash(made.select("doc_id", "digest").groupBy("digest").agg(F.min("doc_id").alias("node")), "set-classes")
    nodes = stash(made.join(named.withColumnRenamed("node", "doc_id"), ["digest", "doc_id"]).dropDuplicates(["doc_id", "digest"]).select(F.col("doc_id").alias("node"), "digest", "fp", "prefix"), "set-nodes")
    keys = nodes.select(F.explode("prefix").alias("key"), "node")
    wide = stash(connected_components(group_links(keys, stash(with_pivots(nodes, words), "node-pivots"), words, max_distance), "a", "b"), "wide-components")
    sizes = wide.groupBy("label").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / SET_ROWS)
    members = stash(wide.join(sizes, "label").select("label", "node", parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).alias("own")), "wide-members")
    small_batches(docs.sparkSession)
    texts = rows.join(bounded(members.withColumnRenamed("node", "doc_id")), "doc_id")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [distinct_shingles(t.as_py() or b"", width).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(k) for k in (2, 3, 4)), pa.array(kept, pa.binary())], names=["node", "label", "parts", "own", "s"])

    held = texts.select("doc_id", "text", "label", "parts", "own").mapInArrow(whole, "node long, label long, parts long, own long, s binary")
    units = held.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    units = units.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "s")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(unit: list[tuple[int, int, np.ndarray]], crossed: bool) -> pa.RecordBatch:
            own, n = np.array([u[0] for u in unit]), np.array([len(u[2]) for u in unit])
            labels, ends = np.arange(len(unit)), []
            for y, (_, node, s) in enumerate(unit):
                may = 100 * np.minimum(n[:y], n[y]) >= percent * np.maximum(n[:y], n[y])
                if crossed:
                    may &= own[:y] != own[y]
                x = -1
                while len(rest := np.flatnonzero(may[x + 1 :] & (labels[x + 1 : y] != labels[y]))):
                    for x in (rest + x + 1).tolist():
                        both = len(np.intersect1d(s, unit[x][2], assume_unique=True))
                        if 100 * both >= percent * (n[x] + n[y] - both):
                            labels[labels == labels[y]] = labels[x]
                            ends.append((unit[x][1], node))
                            break
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in ends], pa.int64()), pa.array([b for _, b in ends], pa.int64())], names=["a", "b"])

        key, unit = None, []
        for b in batches:
            for label, i, j, own, node, s in zip(*(b.column(k).to_pylist() for k in range(6))):
                if (label, i, j) != key and unit:
                    yield solve(unit, key[1] != key[2])
                    unit = []
                key = (label, i, j)
                unit.append((own, node, np.frombuffer(s, np.uint64)))
        if unit:
            yield solve(unit, key[1] != key[2])

    found = units.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j", "node").mapInArrow(compare, "a long, b long")
    # unlike texts under one doc_id are one document: their nodes are tied
    of = stash(made.select("doc_id", "digest").join(named, "digest").select("doc_id", "node"), "documents-nodes")
    tied = of.groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("bs")).where("size(bs) > 1").select("a", F.explode("bs").alias("b"))
    labels = connected_components(stash(found.unionByName(tied), "near-links"), "a", "b")
    return of.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("component_id"))
