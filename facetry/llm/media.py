"""Ogg media columns: payloads stored as 8-bit samples in two multiplexed logical streams, and read back."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

UNIT = 192
RATE = 48_000
#: Samples of a packet; packet i belongs to stream i % STREAMS.
BLOCK, STREAMS = 20 * UNIT, 2
_HEAD = struct.Struct("<4sBBqIIIB")
_INFO = struct.Struct("<8sIBBIQ")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """Ogg's checksum (polynomial 0x04c11db7, start 0, bits not reflected) out of zlib's reflected one."""
    raw = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(raw.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    bare = _HEAD.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + lacing + body
    return bare[:22] + struct.pack("<I", page_crc(bare)) + bare[26:]


def _stream_pages(serial: int, packets: list[tuple[int, bytes]]) -> list[bytes]:
    """Pages of (end sample, packet) pairs after the header page: 255 lacing values a page, packets run over page ends."""
    lacing, done, body = bytearray(), [], b"".join(p for _, p in packets)
    for end, p in packets:
        lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
        done.append((len(lacing), end))
    pages, at, k = [], 0, 0
    for number, i in enumerate(range(0, len(lacing), 255), 1):
        part = bytes(lacing[i : i + 255])
        granule = -1
        while k < len(done) and done[k][0] <= i + 255:
            granule, k = done[k][1], k + 1
        kind = (1 if i and lacing[i - 1] == 255 else 0) | (4 if i + 255 >= len(lacing) else 0)
        pages.append(_page(kind, granule, serial, number, part, body[at : (at := at + sum(part))]))
    return pages


def mux(payload: bytes) -> bytes:
    """Ogg bytes of a payload of 8-bit samples."""
    packets: list[list[tuple[int, bytes]]] = [[] for _ in range(STREAMS)]
    for i, at in enumerate(range(0, len(payload), BLOCK)):
        part = payload[at : at + BLOCK]
        packets[i % STREAMS].append((at + len(part), part))
    heads, rest = [], []
    for s in range(STREAMS):
        info = _INFO.pack(b"PCM8\0\0\0\0", RATE, STREAMS, s, BLOCK, len(payload))
        heads.append(_page(2 | (0 if packets[s] else 4), 0, s + 1, 0, bytes([len(info)]), info))
        rest.append(_stream_pages(s + 1, packets[s]))
    mixed = [p[i] for i in range(max(map(len, rest))) for p in rest if i < len(p)]
    return b"".join([*heads, *mixed])


def demux(media: bytes) -> tuple[dict[int, list[tuple[int, bytes]]], int]:
    """(stream serial: (end sample, packet) in order, the header first with end 0), pages. Raises ValueError on damage."""
    streams: dict[int, list[tuple[int, bytes]]] = {}
    open_, numbers, ended, at, pages = {}, {}, set(), 0, 0
    while at < len(media):
        magic, version, kind, granule, serial, number, crc, n = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if magic != b"OggS" or version or end > len(media):
            raise ValueError("not an Ogg page")
        if page_crc(media[at : at + 22] + b"\0\0\0\0" + media[at + 26 : end]) != crc:
            raise ValueError("page checksum differs")
        if number != numbers.get(serial, -1) + 1 or bool(kind & 2) != (number == 0) or serial in ended:
            raise ValueError("pages of a stream are out of order")
        if bool(kind & 1) != bool(open_.get(serial)):
            raise ValueError("continued packet is missing")
        packet, at, whole = open_.pop(serial, []), at + 27 + n, []
        for x in lacing:
            packet.append(media[at : at + x])
            at += x
            if x < 255:
                whole.append(b"".join(packet))
                packet = []
        if packet:
            open_[serial] = packet
        got = streams.setdefault(serial, [])
        if number == 0:
            got.append((0, whole[0]))
        elif whole:
            # the granule is the end of the last whole packet; those before it end a round of streams earlier each
            last = (granule - 1) // BLOCK
            step = _INFO.unpack(got[0][1])[2]
            got += [(granule if k == 0 else (last - step * k + 1) * BLOCK, p) for k, p in zip(range(len(whole) - 1, -1, -1), whole)]
        numbers[serial], pages = number, pages + 1
        if kind & 4:
            ended.add(serial)
    if any(open_.values()) or ended != set(streams):
        raise ValueError("a stream has no end")
    return streams, pages


def read_back(media: bytes) -> tuple[bytes, str]:
    """(payload, feature) of stored bytes; packets of all streams are put in the order of their timestamps."""
    streams, pages = demux(media)
    packets = sorted((end, p) for s in streams.values() for end, p in s[1:])
    payload = b"".join(p for _, p in packets)
    rate, total = (_INFO.unpack(next(iter(streams.values()))[0][1])[k] for k in (1, 5))
    if len(payload) != total or any(a[0] + len(b[1]) != b[0] for a, b in zip(packets, packets[1:])):
        raise ValueError("samples are missing")
    x = np.frombuffer(payload, np.uint8)
    return payload, f"streams={len(streams)};pages={pages};packets={len(packets)};samples={total};duration_us={total * 1_000_000 // rate};last_start_us={(packets[-1][0] - len(packets[-1][1])) * 1_000_000 // rate};mean={x.mean():.4f};rms={np.sqrt(np.mean(np.square(x, dtype=np.float64))):.4f};peak={x.max()}"


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media binary): every whole text as UTF-8, padded with bytes 32 to a positive multiple of UNIT.

    A null text counts as empty (one padded unit). Equal texts give equal media; repeated rows each get a row.
    """
    small_batches(docs.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, media = [], []
            for t in b.column(1):
                data = t.as_py() or b""
                n.append(len(data))
                media.append(mux(data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Digests and features from stored bytes, read back with all checks; damage fails the job."""
    fields = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(2):
                stored = m.as_py()
                payload, feature = read_back(stored)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=[f.split()[0] for f in fields.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, fields)
