"""Packing of token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import math
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 2048
#: Windows that one differencing fills, their planned filling, and most ids of a piece that takes part.
WINDOWS, FILL, PIECE = 96, 0.995, 512
END_ID = 1
#: Most distinct words of which a worker keeps the ids, and characters of text that it encodes at once: together they bound
#: its memory, since encoding takes over ten bytes for each character.
WORDS_KEPT, TEXT_CHARS = 300_000, 1 << 20

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``ways`` parts with nearly equal sums.

    The two partial partitions with the widest spread are merged, largest part with smallest, until one is left.
    """
    if not sizes:
        return [[] for _ in range(ways)]
    sums = np.zeros((len(sizes), ways), np.int64)
    sums[:, -1] = sizes
    heap = [(-s, k, row) for k, (s, row) in enumerate(zip(sizes, sums))]
    heapq.heapify(heap)
    merged: list[tuple[int, int, np.ndarray]] = []  # the two that met, and which sum went to which place
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        both = a + b[::-1]  # each ascending: large meets small
        order = np.argsort(both, kind="stable")
        both = both[order]
        both -= both[0]
        heapq.heappush(heap, (-int(both[-1]), len(sizes) + len(merged), both))
        merged.append((i, j, order))
    parts: list[list[int]] = [[] for _ in range(ways)]
    todo = [(heap[0][1], np.arange(ways))]  # with the part that each place belongs to
    while todo:
        k, at = todo.pop()
        if k < len(sizes):
            parts[at[-1]].append(k)
            continue
        i, j, order = merged[k - len(sizes)]
        of_a = np.empty_like(at)
        of_a[order] = at
        todo += [(j, of_a[::-1]), (i, of_a)]
    return parts


def windows(sizes: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Parts that all hold at most ``capacity``; the count rises from the least possible until they do."""
    ways = max(1, math.ceil(sum(sizes) / capacity))
    while True:
        parts = differencing(sizes, ways)
        if all(sum(sizes[k] for k in p) <= capacity for p in parts):
            return [p for p in parts if p]
        ways += 1


class Encoder:
    """Ids of whole texts, as little-endian 16-bit words for vocabularies that fit them.

    White space always parts words of this tokenizer, and so does a change between letters and other characters, so ids
    are kept per word. A word is cut before its trailing punctuation only if normalization leaves letters alone in what
    comes before. A Python worker keeps them from task to task, up to WORDS_KEPT words.
    """

    made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.kept = Tokenizer.from_file(path), {}
        self.unit = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.ends[k] = token.endswith("</w>")

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.unit).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _plain(core: str) -> bool:
        """Whether a core is letters only, in lower case and composed form too (the dotted capital I gives a letter and a mark)."""
        return core.isalpha() and (core.isascii() or "\u0130" not in core and unicodedata.is_normalized("NFC", core))

    def _letters(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words of letters only.

        Lower-case ASCII words pass normalization and pre-tokenization unchanged, so they go to the model at once. The others
        are encoded in one go and parted after each token that ends a word.
        """
        simple = [w for w in words if w.isascii() and w.islower()]
        tokenize = self.tokenizer.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in simple]
        ids, ends = np.fromiter(chain.from_iterable(found), self.unit), np.cumsum([len(x) for x in found], dtype=int)
        others = list(set(words).difference(simple))
        if others:
            more = np.frombuffer(self._ids([" ".join(others)])[0], self.unit)
            more_ends = np.flatnonzero(self.ends[more]) + 1
            if len(more_ends) != len(others):
                apart = self._ids(others)
                more, more_ends = np.frombuffer(b"".join(apart), self.unit), np.cumsum([len(x) // ids.itemsize for x in apart])
            ids, ends = np.concatenate((ids, more)), np.concatenate((ends, more_ends + len(ids)))
        data = ids.tobytes()
        cuts = [0, *(ends * ids.itemsize).tolist()]
        return {w: data[x:y] for w, x, y in zip(simple + others, cuts, cuts[1:])}

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, END_ID last. About TEXT_CHARS are encoded at once; a longer text comes whole."""
        part = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // TEXT_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for x, y in zip(cuts, cuts[1:]):
            yield from self._encoded(texts[x:y])

    def _encoded(self, texts: list[str]) -> Iterator[np.ndarray]:
        plain = []
        for text in texts:
            if "\u03a3" not in text and "\u0130" not in text:  # the two letters whose lower case depends on more than the letter
                text = text.lower()
            plain.append(text.replace("\n", " ").replace("\t", " ").replace("\r", " "))
        by_text = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = by_text.values.dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        found = self.kept
        if new := [w for w in words if w not in found]:
            if len(found) > WORDS_KEPT:
                found = {w: ids for w in words if (ids := self.kept.get(w)) is not None}
            parts = [(w, core, w[len(core) :]) for w in new if self._plain(core := w.rstrip(".,!?;:"))]
            if cores := list({core for _, core, _ in parts}.difference(found)):
                found.update(self._letters(cores))
            if rest := list({x for _, _, x in parts}.difference(found) | set(new).difference([w for w, _, _ in parts])):
                found.update(zip(rest, self._ids(rest)))
            for w, core, mark in parts:
                if mark:
                    found[w] = found[core] + found[mark]
        ids = [found[w] for w in words]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // np.dtype(self.unit).itemsize
        data, starts, sizes_at = np.frombuffer(b"".join(ids), self.unit), np.cumsum(sizes) - sizes, sizes[at]
        ends = np.concatenate(([0], np.cumsum(sizes_at)))
        all_ids = data[np.repeat(starts[at] - ends[:-1], sizes_at) + np.arange(ends[-1])]
        bounds = ends[by_text.offsets.to_numpy()].tolist()
        for x, y in zip(bounds, bounds[1:]):
            out = np.empty(y - x + 1, "<u4")
            out[:-1], out[-1] = all_ids[x:y], END_ID
            yield out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = WINDOW) -> DataFrame:
    """One row per piece of a document (FIELDS): every id of every row lies in exactly one piece.

    Each task packs the documents of its own partition as they pass, so nothing is shuffled: whole windows are cut
    from a document first; the rest, in near-equal pieces, waits with others until it fills about WINDOWS windows,
    which differencing then balances. sequence_id holds the partition number in its upper bits. A null text is
    empty: its one id is END_ID. Repeated rows are packed each; a null doc_id stays null. Columns besides doc_id and text
    are ignored, whatever their names. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.of(tokenizer_path)
        serial = TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        waiting: list[tuple] = []
        held = 0
        most = int(WINDOWS * capacity * FILL)

        def flush() -> None:
            nonlocal serial, held
            for part in windows([w[2] for w in waiting], capacity):
                offset = 0
                for k in part:
                    out.append((*waiting[k], serial, offset))
                    offset += waiting[k][2]
                serial += 1
            waiting.clear()
            held = 0

        def batch() -> pa.RecordBatch:
            names = [f.split()[0] for f in FIELDS.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))], names=names)
            out.clear()
            return made

        for b in batches:
            for doc_id, ids in zip(b.column(0).to_pylist(), encode([t or "" for t in b.column(1).to_pylist()])):
                n, at = len(ids), 0
                while n - at >= capacity:
                    out.append((doc_id, at, capacity, zlib.crc32(ids[at : at + capacity].tobytes()), n, serial, 0))
                    serial, at = serial + 1, at + capacity
                cuts = np.linspace(at, n, math.ceil((n - at) / PIECE) + 1).astype(int).tolist() if n > at else []
                for x, y in zip(cuts, cuts[1:]):
                    if held + y - x > most:
                        flush()
                    waiting.append((doc_id, x, y - x, zlib.crc32(ids[x:y].tobytes()), n))
                    held += y - x
            if out:
                yield batch()
        if waiting:
            flush()
        if out:
            yield batch()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, FIELDS)
