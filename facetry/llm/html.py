"""Main text of web pages: page structure, and token runs that a host's suffix array shows to recur on its pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded, small_batches, stash

#: Tokens from which a run counts as long (block breaks count as tokens), and the pages that make it boilerplate: so many,
#: and such a share of the host's distinct pages.
RUN, PAGES, SHARE = 8, 3, 0.2
#: Share of a block's tokens from which covering runs remove all of it.
WHOLE = 0.8
#: Pages and characters of which one suffix array is made; a larger host has several.
PART_PAGES, PART_CHARS = 128, 1 << 20

# HTML's element kinds, and the words in class, id and role that name what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input".split())
NOT_TEXT = frozenset("head title script style noscript template iframe object svg math canvas audio video".split())
ASIDE = frozenset("nav header footer aside button select textarea dialog menu".split())
MAIN = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar footer masthead comment comments disqus respond share sharing social related recommended widget toolbar pagination pager "
    "login signup search complementary contentinfo dialog".split()
)
#: Words that may stand beside them in a compound name (site-footer, related-posts); has-sidebar or related-work is no such name.
BESIDE = frozenset("area bar block bottom box buttons container content-info form global google header icons inner item items left links list main outer page post posts primary right secondary section site slot thread top unit wrapper".split())

_BREAK = "\x1d"


def names_aside(name: str) -> bool:
    """Whether one class, id or role names what isn't the article."""
    parts = [p for p in re.split(r"[^a-z]+", name) if p]
    return not ASIDE_WORDS.isdisjoint(parts) and all(p in ASIDE_WORDS or p in BESIDE for p in parts)


class Blocks(HTMLParser):
    """Text blocks of a page in order: (kind, text); kind 0 lies in the declared article, 1 in none, 2 in what isn't it.

    What a name or a form sets aside is taken back where it holds the page's only article, or a form all of its prose.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple] = []  # (element, state before it)
        self.parts: list[str] = []
        self.blocks: list[tuple[tuple, str]] = []
        self.state: tuple[int, bool, tuple[int, ...]] = (2, False, ())  # 0 no text / 1 aside / 2 open; in an article; named asides around
        self.soft: list[str] = []  # the named asides' elements
        self.holds: set[int] = set()  # those with an article inside
        self.prose: set[int] = set()  # those with paragraphs or headings
        self.free = False  # an article outside all of them

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append((self.state, text))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID and tag != "hr":
            return
        if tag not in INLINE:
            self.flush()
        if tag == "hr":
            return
        level, article, soft = self.state
        if tag in NOT_TEXT:
            level = 0
        elif level == 2:
            named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower().split()
            if tag in ASIDE or any(k == "hidden" or k == "aria-hidden" and v == "true" for k, v in attrs):
                level = 1
            elif tag == "form" or tag not in ("html", "body") and any(map(names_aside, named)):
                soft = (*soft, len(self.soft))
                self.soft.append(tag)
            if tag in MAIN and level == 2:
                self.holds.update(soft)
                self.free |= not soft
            if tag in PROSE:
                self.prose.update(soft)
        state = (level, article or tag in MAIN, soft)
        if tag in INLINE and state != self.state:
            self.flush()
        self.open.append((tag, self.state))
        self.state = state

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag), None)
        if tag not in INLINE:
            self.flush()
        if at is not None:
            back = self.open[at][1]
            if back != self.state:
                self.flush()
            self.state = back
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if self.state[0]:
            self.parts.append(data)

    def kinds(self) -> list[tuple[int, str]]:
        back = set() if self.free else set(self.holds)
        told = lambda: [(2 if s[0] == 1 or not back.issuperset(s[2]) else 0 if s[1] else 1, t) for s, t in self.blocks]
        if all(k == 2 for k, _ in told()):
            back |= {k for k in self.prose if self.soft[k] == "form"}
        return told()


def page_blocks(html: str) -> list[tuple[int, str]]:
    parser = Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    return parser.kinds()


def page_tokens(texts: list[str]) -> list[str]:
    """The token stream of a page: its blocks' tokens, with a break before each and at the end."""
    out = []
    for t in texts:
        out.append(_BREAK)
        out += t.split(" ")
    return [*out, _BREAK] if out else []


def _name(tokens: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(tokens), 9) - (1 << 63)


def short_blocks(tokens: list[str]) -> list[tuple[int, int]]:
    """[start, end) of the blocks too short to hold a run, with their breaks."""
    at = [k for k, t in enumerate(tokens) if t == _BREAK]
    return [(a, b + 1) for a, b in zip(at, at[1:]) if b + 1 - a < RUN]


def recurring(streams: list[list[str]], least: int) -> dict[int, int]:
    """Runs of RUN tokens, and whole shorter blocks, that ``least`` of the streams have, by name, with that number.

    The streams are concatenated and their suffix array is made by prefix doubling, to the depth of a run: suffixes
    of equal rank share RUN tokens, and lie side by side in the array.
    """
    page = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    tokens = [t for s in streams for t in s]
    found: dict[int, int] = {}
    if len(tokens) >= RUN:
        rank = pd.factorize(np.array(tokens, object))[0].astype(np.int64)
        width = 1
        while width < RUN:  # rank of the first ``width`` tokens, then of twice as many
            step = min(width, RUN - width)
            key = rank[: len(rank) - step] * (rank.max() + 1) + rank[step:]
            rank = np.unique(key, return_inverse=True)[1]
            width += step
        start = np.flatnonzero(page[: len(rank)] == page[RUN - 1 :])  # no run goes over a page's end
        order = start[np.lexsort((page[start], rank[start]))]  # the suffix array
        r, p = rank[order], page[order]
        new = np.concatenate([[True], r[1:] != r[:-1]])[: len(r)]
        pages = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])[: len(r)]
        head = np.flatnonzero(new)
        n = np.add.reduceat(pages.astype(np.int64), head) if len(head) else np.zeros(0, np.int64)
        for at, k in zip(order[head[n >= least]].tolist(), n[n >= least].tolist()):
            found[_name(tokens[at : at + RUN])] = k
    whole: dict[str, set[int]] = {}
    for k, s in enumerate(streams):
        for a, b in short_blocks(s):
            whole.setdefault(" ".join(s[a:b]), set()).add(k)
    found.update((_name(t.split(" ")), len(ks)) for t, ks in whole.items() if len(ks) >= least)
    return found


def runs_at(tokens: list[str]) -> list[tuple[int, int, int]]:
    """(start, end, name) of all runs and short blocks of a stream."""
    ends = [(k, k + RUN) for k in range(len(tokens) - RUN + 1)] + short_blocks(tokens)
    return [(a, b, _name(tokens[a:b])) for a, b in ends]


def main_text(kinds: list[int], texts: list[str], marks: set[int]) -> str:
    """The page's main text: its article, or what no structure sets aside, without what the marked runs cover.

    A block outside the declared article goes whole if runs cover most of it; else a long run at its start or end goes,
    never words from within. The declared article stays as it is: what it shares with other pages is quoted or copied
    text. It is the whole main text unless it has less than what is left outside of it.
    """
    blocks = [t.split(" ") for t in texts]
    left = list(map(list, blocks))
    if marks:
        tokens = page_tokens([t for t, kind in zip(texts, kinds) if kind])
        gone = np.zeros(len(tokens), bool)
        for a, b, name in runs_at(tokens):
            if name in marks:
                gone[a:b] = True
        at = 1
        for k, (words, kind) in enumerate(zip(blocks, kinds)):
            if kind == 0:
                continue
            covered = gone[at : at + len(words)]
            at += len(words) + 1
            unique = np.flatnonzero(~covered)
            if len(unique) <= (1 - WHOLE) * len(words):
                left[k] = []
            else:
                head, tail = unique[0], len(words) - 1 - unique[-1]
                left[k] = words[head if head >= RUN else 0 : len(words) - (tail if tail >= RUN else 0)]
    size = [sum(len(w) for w, kind in zip(left, kinds) if kind == which) for which in (0, 1)]
    kept = (0,) if size[0] and size[0] >= size[1] else (0, 1)
    return "\n\n".join(" ".join(w) for w, kind in zip(left, kinds) if kind in kept and w)


def _streams(batch: pa.RecordBatch, column: int) -> list[list[str]]:
    return [page_tokens([x["text"] for x in blocks]) for blocks in batch.column(column).to_pylist()]


def host_runs(parsed: DataFrame) -> DataFrame:
    """(host, marks): the names of the runs that are boilerplate of a host, for hosts that have any.

    parsed: (row, host, digest, chars, blocks). Streams are what lies outside declared articles; pages of equal text, article
    included, count once, as the first row of them. A host's distinct pages are dealt, by their text, into parts of bounded
    size; each part has its suffix array. A run that a share of all pages has is had by that share in one part at least, so
    a part names candidates, and those of hosts of several parts are counted on all pages.
    """
    parsed = parsed.select("row", "host", "digest", "chars", F.filter("blocks", lambda b: b["kind"] != 0).alias("blocks"))
    distinct = parsed.groupBy("host", "digest").agg(F.min("row").alias("row"), F.max("chars").alias("chars"))
    hosts = distinct.groupBy("host").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).where(F.col("n") >= PAGES)
    parts = F.ceil(F.greatest(F.col("n") / PART_PAGES, F.col("chars") / PART_CHARS)).cast("long")
    hosts = stash(hosts.select("host", "n", F.greatest(F.lit(PAGES), F.ceil(F.col("n") * SHARE)).cast("long").alias("least"), parts.alias("parts")), "hosts")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            keys = list(zip(b.column(0).to_pylist(), b.column(5).to_pylist()))
            fresh = [k not in seen and not seen.add(k) for k in keys]
            yield b.filter(pa.array(fresh, pa.bool_()))

    dealt = parsed.join(bounded(hosts), "host").select("host", "n", "least", "parts", F.pmod(F.xxhash64("digest"), F.col("parts")).alias("part"), "digest", "row", "blocks")
    dealt = dealt.mapInArrow(once, dealt.schema).repartition("host", "part").sortWithinPartitions("host", "part", "digest", "row")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            host, n, least, parts, _ = key
            found = recurring(streams, -(-least * len(streams) // n))
            streams.clear()
            return pa.RecordBatch.from_arrays([pa.array([host] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64()), pa.array([parts] * len(found), pa.int64())], names=["host", "run", "n", "parts"])

        key = last = None
        streams: list[list[str]] = []
        for b in batches:
            for *now, digest, stream in zip(*(b.column(k).to_pylist() for k in range(6)), _streams(b, 7)):
                if now != key and streams:
                    yield solve()
                if now != key or digest != last:  # sorted: equal texts from several tasks follow each other
                    streams.append(stream)
                key, last = now, digest
        if streams:
            yield solve()

    found = stash(dealt.mapInArrow(find, "host string, run long, n long, parts long"), "host-runs")
    sure = found.where("parts = 1").select("host", "run")
    asked = found.where("parts > 1").groupBy("host").agg(F.collect_set("run").alias("asked"))
    if not asked.isEmpty():
        asked = _sized(stash(asked, "asked-runs"), "asked")
        rows = parsed.join(bounded(distinct.select("row")), "row", "left_semi").join(asked, "host").select("host", "asked", "blocks")

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                n: dict[tuple[str, int], int] = {}
                for host, runs, stream in zip(b.column(0).to_pylist(), b.column(1), _streams(b, 2)):
                    for name in {name for _, _, name in runs_at(stream)}.intersection(runs.values.to_pylist()):
                        n[host, name] = n.get((host, name), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in n], pa.string()), pa.array([r for _, r in n], pa.int64()), pa.array(list(n.values()), pa.int64())], names=["host", "run", "n"])

        counted = rows.mapInArrow(count, "host string, run long, n long").groupBy("host", "run").agg(F.sum("n").alias("total"))
        sure = sure.unionByName(counted.join(bounded(hosts.select("host", "least")), "host").where("total >= least").select("host", "run"))
    return _sized(stash(sure.groupBy("host").agg(F.collect_set("run").alias("marks")), "host-marks"), "marks")


def _sized(hosts: DataFrame, runs: str) -> DataFrame:
    """One row per host, for a broadcast if all their runs together are few."""
    few = (hosts.agg(F.sum(F.size(runs) + 4)).first()[0] or 0) <= BROADCAST_ROWS
    return F.broadcast(hosts) if few else hosts


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of pages.

    Structure first: blocks inside menus, headers, asides, forms and the like, or elements whose class, id or role names
    them, aren't the article; blocks in article or main are. What neither tells, the host does: the token streams of all
    its pages outside declared articles, over block ends, are searched for runs of RUN tokens (breaks count), and whole shorter blocks, that PAGES
    pages and SHARE of the host's distinct pages have; what they cover goes (main_text). Character references are decoded, white space is one
    space, blocks are joined by an empty line. Whole pages are read, however long. A null or empty html, or one with markup
    alone, gives an empty text; pages whose url is null or names no host are one host; repeated rows each give a row and
    count as one page. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    small_batches(pages.sparkSession, 300)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z]+://([^/:?#]+)", 1))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", host.alias("host"), "html")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("text", pa.string())]))
        for b in batches:
            found = [page_blocks(h or "") for h in b.column(4).to_pylist()]
            digest = [xxhash.xxh64_intdigest("\n".join(t for k, t in x if k < 2), 3) - (1 << 63) for x in found]
            chars = [sum(len(t) for _, t in x) for x in found]
            blocks = pa.array([[{"kind": k, "text": t} for k, t in x] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(digest, pa.int64()), pa.array(chars, pa.int64()), blocks], names=["row", "page_id", "url", "host", "digest", "chars", "blocks"])

    parsed = stash(rows.mapInArrow(parse, "row long, page_id long, url string, host string, digest long, chars long, blocks array<struct<kind: int, text: string>>"), "page-blocks")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text([x["kind"] for x in blocks], [x["text"] for x in blocks], set(marks or ())) for blocks, marks in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    made = parsed.join(host_runs(parsed), "host", "left").select("page_id", "url", "blocks", "marks").mapInArrow(build, "page_id long, url string, text string")
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
