"""Media, packing, language, licenses, decontamination, chat, HTML and the pipeline."""

import os
import random
import re
import textwrap
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from facetry.llm import chat, decontam, html, language, licenses, media, packing, queries
from tests.test_parity import compare


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_match_sql(name, spark, duck, sf_dir):
    compare(spark, duck, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def crc_by_definition(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_ogg_checksum():
    for data in (b"", b"OggS", bytes(range(256))):
        assert media.page_crc(data) == crc_by_definition(data)


@pytest.mark.parametrize("units", [1, 2, 20, 21, 40, 41, 600, 6000])
def test_ogg_round_trip(units):
    payload = random.Random(units).randbytes(media.UNIT * units)
    stored = media.mux(payload)
    back, feature = media.read_back(stored)
    assert back == payload and f"samples={len(payload)}" in feature
    streams, _ = media.demux(stored)
    assert set(streams) == {1, 2}
    ends = sorted(end for s in streams.values() for end, _ in s[1:])
    assert ends == [min(len(payload), k + media.BLOCK) for k in range(0, len(payload), media.BLOCK)]


def test_ogg_damage():
    stored = bytearray(media.mux(bytes(media.UNIT * 50)))
    for at in (5, 30, 200, len(stored) - 1):
        bad = bytearray(stored)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.read_back(bytes(bad))
    with pytest.raises(ValueError):
        media.read_back(bytes(stored[: len(stored) // 2]))


def test_media_edges(make, edge_rows):
    rows = media.media_features(media.to_media(make(edge_rows))).collect()
    assert len(rows) == len(edge_rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].n_bytes == 0 and by[1].payload_bytes == 192 and by[1].payload_sha256 == by[2].payload_sha256
    assert by[5].media_sha256 == by[6].media_sha256 and by[10].tail_crc32 == zlib.crc32(b" " * 16)
    assert media.media_features(media.to_media(make([]))).count() == 0


def test_differencing_is_near_equal():
    rng = random.Random(1)
    for ways in (1, 2, 5, 16):
        sizes = [rng.randint(1, 512) for _ in range(ways * 9)]
        parts = packing.differencing(sizes, ways)
        assert sorted(k for p in parts for k in p) == list(range(len(sizes)))
        sums = [sum(sizes[k] for k in p) for p in parts]
        assert max(sums) - min(sums) <= 60
    assert packing.differencing([], 3) == [[], [], []]


def test_window_count_rises():
    parts = packing.windows([1500, 1500, 1000], 2048)
    assert len(parts) == 3  # two windows would hold the sum, but not these pieces


def check_packed(rows, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    got = sorted((r.doc_tokens, r.start, r.length, r.ids_crc32) for r in rows)
    for r in rows:
        assert 1 <= r.length <= 2048
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(map(len, want))
    return want, got, by


def test_packing_covers_every_id(sf_docs):
    docs = sf_docs.where("doc_id < 300")
    rows = packing.pack(docs.repartition(3), queries.tokenizer_path()).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    want, _, by = check_packed(rows, texts.values())
    ids = dict(zip(texts, want))
    for d in texts:
        at = 0
        for r in sorted((r for r in rows if r.doc_id == d), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[d][at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[d])
    assert sum(r.length for r in rows) / (2048 * len(by)) > 0.93


def test_packing_edges(make, edge_rows):
    rows = packing.pack(make(edge_rows), queries.tokenizer_path()).collect()
    check_packed(rows, [t for _, t in edge_rows])
    assert packing.pack(make([]), queries.tokenizer_path()).count() == 0


def test_words_apart_equal_whole_texts():
    e = packing.Encoder.of(queries.tokenizer_path())
    texts = ["Héllo WORLD's don't  a b é 12ab ... !!a, b.c x_y", "ΣΑΣ İstanbul <|endoftext|> ok", "á é\n\n\tA!! b!!. c.,", "\x1c wide space no-break", "日本語 テキスト", "don't. it's, we'll!"]
    for text, ids in zip(texts, e(texts)):
        assert ids.tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids + [1]


def test_words_apart_equal_whole_texts_fuzzed():
    """Random texts of letters with and without marks, dotted capitals, punctuation, digits and spaces."""
    e, rng = packing.Encoder.of(queries.tokenizer_path()), random.Random(12)
    pieces = ["İ", "I", "ı", "i̇", "é", "e\u0301", "\u0301", "Σ", "ς", "ß", "ﬁ", "ǰ", "ŉ", "ΐ", "\u0345", "K", "Å", "한", "\u1112\u1161", "日", "a", "B", "z's", "'t", "1", ".", ",", "!", "?", ";", ":", "-", " ", "\n", "\t", "\u00a0", "\u200d", "ा", "क", "😀"]
    texts = ["KÜLTÜR VE TURİZM BAKANLIĞI, ANKARA BELEDİYESİ, açıkladı."] + ["".join(rng.choices(pieces, k=rng.randint(1, 14))) for _ in range(20_000)]
    wrong = [t for t, ids, whole in zip(texts, e(texts), e.tokenizer.encode_batch(texts, add_special_tokens=False)) if ids.tolist() != whole.ids + [1]]
    assert wrong == []


def test_words_of_tables_and_past_the_kept_ones(sf_docs, monkeypatch):
    """Whole documents, while words are kept and when no more are."""
    texts = [r.text or "" for r in sf_docs.where("doc_id < 300").collect()] + ["", " ", "\n", "Don't WAIT... ok;", "ﬁ ŉ क़. ᾳ"]
    e = packing.Encoder(queries.tokenizer_path())
    want = [x.ids + [1] for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for kept in (packing.WORDS_KEPT, 100):
        monkeypatch.setattr(packing, "WORDS_KEPT", kept)
        e.kept = {}
        assert [ids.tolist() for k in range(0, len(texts), 50) for ids in e(texts[k : k + 50])] == want
    assert list(e([])) == [] and len(e.kept) > 100


def test_encoding_holds_part_of_a_batch():
    """The memory for encoding follows TEXT_CHARS, not the batch's text; the ids are those of the texts one by one."""
    e, rng = packing.Encoder(queries.tokenizer_path()), random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(500)]
    texts = [" ".join(rng.choices(words, k=n)) for n in [600] * 2000 + [0, 1, 400_000, 2]]
    alone = [zlib.crc32(next(e([t])).tobytes()) for t in texts]
    tracemalloc.start()
    at_once = [zlib.crc32(ids.tobytes()) for ids in e(texts)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at_once == alone and peak < 5 * sum(map(len, texts))


def test_one_word_a_model_call():
    """Lower-case ASCII words skip the text passes: no call encodes them as texts, and the ids are the same."""
    e = packing.Encoder(queries.tokenizer_path())
    want = e.tokenizer.encode("plain words here", add_special_tokens=False).ids + [1]
    ids_of = e._ids
    e._ids = lambda texts: pytest.fail("encoded as a text") if any(texts) else ids_of(texts)
    assert next(e(["plain words here"])).tolist() == want


def test_language_accuracy(sf_docs):
    found = language.identify(sf_docs, language.learn(sf_docs)).join(sf_docs, "doc_id").where(language.held_out(F.col("doc_id")))
    hit, n, rejected = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*"), F.avg(F.col("rejected").cast("int"))).first()
    assert n > 200 and hit > 0.95 and rejected < 0.02


def test_very_long_text_keeps_its_language(sf_docs, make):
    """5 MB of one language is told with a margin."""
    known = language.learn(sf_docs)
    rows = []
    for k, lang in enumerate(sorted(known)):
        words = " ".join(r.text for r in sf_docs.where((F.col("lang") == lang) & F.col("text").isNotNull()).orderBy("doc_id").collect()).split()
        rows.append((k, " ".join(random.Random(k).choices(words, k=900_000))[:5_000_000]))
    got = {r.doc_id: r for r in language.identify(make(rows), known).collect()}
    assert [(got[k].lang_pred, got[k].rejected) for k, _ in rows] == [(x, False) for x in sorted(known)]


def test_dictionaries_learn_from_whole_texts(make):
    """A word that stands at the end of long texts enters the dictionary; held-out rows teach nothing."""
    rows = [(k, "filler " * 3000 + "lastword") for k in range(12)]
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert held and language.learn(make(rows))["en"].split() == [b"filler", b"lastword"]
    assert language.learn(make([r for r in rows if r[0] in held])) == {}


def test_language_edges(make, edge_rows, spark):
    found = language.identify(make(edge_rows), {"de": b"der die das und ist ein", "en": b"the a of and is in quick brown"}).collect()
    by = {r.doc_id: r for r in found if r.doc_id is not None}
    assert len(found) == len(edge_rows)
    for k in (1, 2, 3, 7):
        assert (by[k].lang_pred, by[k].score, by[k].rejected) == ("und", 0.0, True)
    assert by[5].lang_pred == "en" and 0 <= by[5].score <= 1
    assert language.learn(make([])) == {} and language.learn(make([(1, None)])) == {}
    assert {r.lang_pred for r in language.identify(make([(1, "abc")]), {}).collect()} == {"und"}
    tie = language.identify(make([(1, "xyz qrs"), (1, "xyz qrs")]), {"b": b"same words here", "a": b"same words here"}).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in tie] == [("a", 0.5, True)] * 2
    assert language.identify(make([]), {"en": b"the a of and"}).count() == 0
    unlabelled = make(edge_rows).withColumn("lang", F.lit(None).cast("string"))
    assert language.learn(unlabelled) == {}


def test_licenses_on_tables(sf_docs):
    """Every planted line is found, at its line, with its license; nothing else is."""
    names = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    want = {(r.doc_id, i, names[x]) for r in sf_docs.collect() for i, x in enumerate((r.text or "").split("\n")) if x in names}
    got = licenses.scan_licenses(sf_docs).collect()
    assert {(r.doc_id, r.line, r.license) for r in got} == want and all(r.differing_words == 0 for r in got)


@pytest.mark.parametrize("form", sorted(licenses.TEMPLATES))
def test_templates_find_themselves(form):
    """On a line of its own, wrapped at 30 columns, and within one long line of prose, before, after and between other words."""
    s = licenses.Scanner(licenses.TEMPLATES)
    text, prose = licenses.TEMPLATES[form], " ".join(f"word{k} and more" for k in range(60))
    for before, own, after in (("some words\n", text, ""), ("", textwrap.fill(text, 30, break_on_hyphens=False, break_long_words=False), ""), (prose + " ", text, " " + prose), (prose + "\n", textwrap.fill(text, 30, break_on_hyphens=False, break_long_words=False), "\n" + prose)):
        found = s.scan(before + own + after)
        assert [f[2] for f in found] == [form] and found[0][4] == 0
        assert (before + own + after)[found[0][0] : found[0][1]].rstrip(".:") == own.rstrip(".:")


def test_several_notices_in_one_line():
    s = licenses.Scanner(licenses.TEMPLATES)
    line = " and then some prose goes on ".join(licenses.TEMPLATES[k] for k in ("MIT/short", "GPL-3.0/short", "Apache-2.0/notice", "MIT/short"))
    assert [f[2] for f in s.scan(line)] == ["MIT/short", "GPL-3.0/short", "Apache-2.0/notice", "MIT/short"]


def test_license_wording_decides():
    s = licenses.Scanner(licenses.TEMPLATES)
    assert s.scan("This work is licensed under the GNU General Public License, version 2.")[0][2] == "GPL-2.0/short"
    assert s.scan("copyright is a word in this sentence and nothing more than that") == []
    changed = licenses.TEMPLATES["MIT/full"].replace("free of charge", "at no cost").replace("NONINFRINGEMENT", "TITLE")
    (_, _, form, _, differ, missing, extra) = s.scan(f"Copyright (c) 2020 Some One\n\n{changed}\n\nint main")[0]
    assert form == "MIT/full" and differ == 4 and missing == "free of charge noninfringement" and extra == "at no cost title"


def licenses_by_definition(text, s):
    """Every word position and every template: the best confirmed notice at each place, without cue, bag or compression."""
    words, out, end = licenses._words(text), [], 0
    for x in range(len(words)):
        if x < end:
            continue
        best = None
        for k, want in s.words.items():
            have = words[x : x + len(want)]
            if have[:1] == want[:1] and have == want and (best is None or len(want) > len(s.words[best])):
                best = k
        if best:
            out.append(best)
            end = x + len(s.words[best])
    return out


def test_license_scan_equals_definition(sf_docs):
    """Planted anywhere in real texts, exact notices are found as by comparing all templates at all words."""
    s, rng = licenses.Scanner(licenses.TEMPLATES), random.Random(8)
    forms = sorted(licenses.TEMPLATES)
    for r in sf_docs.where("doc_id < 120 and text is not null").collect():
        words = r.text.split(" ")
        for _ in range(rng.randint(0, 3)):
            words.insert(rng.randint(0, len(words)), licenses.TEMPLATES[rng.choice(forms)])
        text = " ".join(words)
        assert [f[2] for f in s.scan(text)] == licenses_by_definition(text, s)


def test_license_edges(make, edge_rows):
    assert licenses.scan_licenses(make(edge_rows)).count() == 0 and licenses.scan_licenses(make([])).count() == 0
    twice = licenses.scan_licenses(make([(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, "Released under the MIT License.")]))
    assert twice.count() == 3
    long = "one long line of prose without end " * 50_000
    got = licenses.scan_licenses(make([(1, f"{long} Licensed under CC BY 4.0. {long}"), (2, "copyright " * 3_000)])).collect()
    assert [(r.doc_id, r.line, r.license, r.start) for r in got] == [(1, 0, "CC-BY-4.0", len(long) + 1)]


def items(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in rows], "item_id long, text string, doc_id long")


def test_contamination_edges(spark, make, edge_rows):
    line = edge_rows[4][1]
    words = line.split()
    bench = items(spark, [(1, line), (2, None), (3, ""), (4, "too few words"), (5, " ".join(words[:15])), (5, " ".join(words[:15])), (None, line), (6, "Completely, other words; that no document has!")])
    got = {(r.doc_id, r.item_id) for r in decontam.contamination(make(edge_rows), bench).collect()}
    assert got == {(d, i) for d in (4, 5, 6, 9) for i in (1, 5)}
    tiny = items(spark, [(1, "in the old town"), (2, "Fox"), (3, "the fox"), (4, "a"), (5, "12345")])
    got = {(r.doc_id, r.item_id, r.shared, r.containment) for r in decontam.contamination(make(edge_rows), tiny).collect()}
    assert got == {(d, i, 1, 1.0) for d in (4, 5, 6, 9) for i in (1, 2)} | {(10, 4, 1, 1.0), (7, 5, 1, 1.0)}
    assert decontam.contamination(make([]), bench).count() == 0 and decontam.contamination(make(edge_rows), items(spark, [])).count() == 0


def test_contamination_threshold(spark, make):
    """Each share of an item's words, at every size, broadcast or shuffled."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    bench, docs, want = [], [], set()
    for i, n in enumerate((5, 6, 9, 14, 20, 33, 64, 100)):
        w = [word() for _ in range(n)]
        bench.append((i, " ".join(w)))
        for cut in range(0, n - 4, max(1, n // 10)):
            d = len(docs)
            docs.append((d, " ".join([word() for _ in range(40)] + [x.upper() for x in w[: n - cut]] + [word() for _ in range(40)])))
            if 100 * (n - cut - 4) >= 80 * (n - 4):
                want.add((d, i))
    for rows in (decontam.BROADCAST_ROWS, 0):
        got = decontam.contamination(make(docs), items(spark, bench), broadcast_rows=rows).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want


def test_contamination_of_repeated_items_equals_sql(spark, make):
    """Rows of one item, equal or not, count as one: shared, total and the threshold are those of the SQL."""
    words = [f"w{k}" for k in range(40)]
    items = [(1, " ".join(words[:15])), (1, " ".join(words[:15])), (2, " ".join(words[:15])), (2, " ".join(words[20:35])), (None, "a b c d e"), (7, "w2, w3"), (8, "W39")]
    docs = [(1, " ".join(words[:15])), (2, " ".join(words[:9])), (3, " ".join(words[:15] + ["x"] + words[20:35])), (4, " ".join(words[20:35])), (5, None)]
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)"), con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.sql("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)"), con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    want = sorted(con.sql(decontam.SQL).fetchall())
    got = decontam.contamination(make(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r) for r in got.collect()) == want and [r[:2] for r in want] == [(1, 1), (1, 7), (2, 7), (3, 1), (3, 2), (3, 7)]


def test_contamination_is_native(sf_docs, spark):
    plan = decontam.contamination(sf_docs, spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_chat_edges(spark):
    rows = [
        (1, 0, "user", "hi", 9), (1, 1, "assistant", "yo", 9), (2, 0, "user", "hi", 9), (3, 0, "user", "hi", 9), (3, 1, "assistant", "yo", 9),
        (4, 0, None, None, 9), (5, None, "user", "x <|im_end|>", 9), (6, 0, "user", "a", 9), (6, 0, "user", "a", 9), (None, 0, "user", "lost", 9), (7, 0, "user", "hi", 9), (7, 1, "assistant", "no", 9),
    ]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, pos int")
    got = {r.conv_id: r.text for r in chat.render(chat.maximal_conversations(t)).collect()}
    assert set(got) == {1, 4, 5, 6, 7}  # 2 is a prefix, 3 a copy
    assert got[1] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert got[5].count("<|im_end|>") == 1 and got[6].count("im_start") == 1
    assert chat.render(chat.maximal_conversations(t.limit(0))).count() == 0
    long = "word " * 400_000
    rows = [(k, p, "user", f"{p} {long}") for k in range(3) for p in range(1 + k % 2)]
    got = chat.render(chat.maximal_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert [(r.conv_id, len(r.text)) for r in got] == [(1, 2 * (len(long) + 30))]


def test_chat_shuffles_texts_once(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = chat.maximal_conversations(t)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("hashpartitioning(conv_id") - plan.count("ReusedExchange") <= 2 and "hashpartitioning(conv_id#" in plan
    assert "turn#" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "conv_id" not in x)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav><!-- c -->
<div class="ad">Buy</div><article><h1>Head&amp;line</h1><p><b>One <i>two</i>
 three<br><p>Four&nbsp;five &lt;6&gt;<aside>Side</aside><p hidden>Gone</p><div class="comments"><p>First!</p></div></article><footer>&copy; host</footer></body></html>"""


def page_rows(spark, rows):
    return spark.createDataFrame([(*r, "b") for r in rows], "page_id long, url string, html string, blocks string")


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html.extract(page_rows(spark, rows)).collect()}


def test_html_structure(spark):
    rows = [(1, "http://h/1", PAGE), (2, None, None), (3, "http://h/3", ""), (4, "http://h/4", "<nav>only menu</nav>"), (5, "bad url", "plain text, no markup"), (5, "bad url", "plain text, no markup")]
    got = {r.page_id: r for r in html.extract(page_rows(spark, rows)).collect()}
    assert got[1].text == "Head&line\n\nOne two three\n\nFour five <6>" and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[4].text == "" and got[2].n_chars == 0
    assert got[5].text == "plain text, no markup"
    assert html.extract(page_rows(spark, [])).count() == 0
    assert html.extract(page_rows(spark, rows)).count() == len(rows)


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="content has-sidebar"><article><p>Words</article></div>', "Words"),
        ('<div class="sidebar"><article><p>Words</article></div>', "Words"),  # the only article
        ('<div class="sidebar"><article><p>Teaser</article></div><article><p>Words of the article</article>', "Words of the article"),
        ('<form action=x><div class="menu">Menu</div><h1>Title</h1><p>Words</p><input></form>', "Title\n\nWords"),
        ("<form><label>Name <input></label></form><p>Words</p>", "Words"),
        ("<form><label>Name <input></label></form>", ""),
        ('<article><p>Words</p><section id="related-work"><p>Older papers</p></section><div class="search-algorithm">Steps</div></article>', "Words\n\nOlder papers\n\nSteps"),
        ('<article><p>Words</p><div class="related-posts">More</div><div id="comments"><article>First!</article></div></article>', "Words"),
        ('<div class="site-footer">Foot</div><div class="cookie-notice">Cookies</div><p>Words', "Words"),
        ("<main><p>Short</main><p>A far longer text outside of what the page declares as main", "Short\n\nA far longer text outside of what the page declares as main"),
        ("<article><p>A long enough article here</article><p>Small print", "A long enough article here"),
        ("<p>a<br>b&amp;c&#x41;&nbsp;<b>d</b><table><tr><td>e<td>f</table><script>x</script><template>y</template>", "a b&cA d\n\ne\n\nf"),
    ],
)
def test_html_one_page(page, want):
    kinds, texts = zip(*html.page_blocks(page)) if html.page_blocks(page) else ((), ())
    assert html.main_text(list(kinds), list(texts), set()) == want


def bare_pages(rng, host, n, common=("Home", "About us", "Contact and terms"), own=40):
    """Pages whose menu, notice and footer are plain divs on every page; (page_id, url, html) and the true text of each."""
    word = lambda: "".join(rng.choices("abcdefghijkl", k=rng.randint(2, 8)))
    notice = " ".join(word() for _ in range(25))
    rows, want = [], {}
    for k in range(n):
        paragraphs = [" ".join(word() for _ in range(rng.randint(3, own))) for _ in range(rng.randint(1, 5))]
        blocks = [*common, *paragraphs, notice, f"page {word()} of this site, all rights reserved by its owners and friends"]
        rows.append((f"{host}{k}", f"http://{host}/{k}", "".join(f"<div>{b}</div>" for b in blocks)))
        want[f"{host}{k}"] = "\n\n".join(paragraphs)
    return rows, want


def numbered(parts):
    rows = [r for p, _ in parts for r in p]
    ids = {name: i for i, (name, _, _) in enumerate(rows)}
    return [(ids[n], u, h) for n, u, h in rows], {ids[n]: t for _, w in parts for n, t in w.items()}


def test_html_host_runs(spark, monkeypatch):
    """Menus, notices and footers that only their recurrence tells go, on small hosts and on hosts of several suffix arrays."""
    monkeypatch.setattr(html, "PART_PAGES", 16)
    rng = random.Random(11)
    rows, want = numbered([bare_pages(rng, h, n) for h, n in (("a.org", 150), ("b.org", 9), ("c.org", 3))])
    got = texts_of(spark, rows)
    assert got == want
    alone = texts_of(spark, rows[:2])
    assert all(alone[k].startswith("Home\n\nAbout us") for k in (0, 1))  # two pages tell nothing


def test_html_runs_equal_definition(spark, monkeypatch):
    """Against counting every run of every page in a dictionary."""
    rng = random.Random(3)
    parts = [bare_pages(rng, h, n, own=12) for h, n in (("a.org", 70), ("b.org", 12), ("c.org", 5))]
    rows, _ = numbered(parts)
    rows += [(k + 1000, u, h) for k, u, h in rows[:20]]  # pages of equal text count once
    rows += [(2000 + k, f"http://a.org/x{k}", f"<p>{'the same eight words on one page in four ' * 2}{k} {k} {k}") for k in range(16)]
    rows += [(3000, "http://b.org/long", "<p>" + "very long page " * 60_000)]
    want = {}
    for host in {u.split("/")[2] for _, u, _ in rows}:
        pages = {k: html.page_blocks(h) for k, u, h in rows if u.split("/")[2] == host}
        distinct = {"\n".join(t for _, t in b): b for b in pages.values()}
        seen = {}
        for key, blocks in distinct.items():
            tokens = html.page_tokens([t for _, t in blocks])
            runs = {tuple(tokens[i : i + html.RUN]) for i in range(len(tokens) - html.RUN + 1)} | {("\x1d", *t.split(" "), "\x1d") for _, t in blocks if len(t.split(" ")) + 2 < html.RUN}
            for r in runs:
                seen.setdefault(r, set()).add(key)
        marks = {html._name(list(r)) for r, ks in seen.items() if len(ks) >= max(html.PAGES, -(-len(distinct) // 5))}
        want |= {k: html.main_text([x for x, _ in b], [t for _, t in b], marks) for k, b in pages.items()}
    for size in (128, 7):
        monkeypatch.setattr(html, "PART_PAGES", size)
        assert texts_of(spark, rows) == want


def test_html_articles_published_often_stay(spark):
    """Declared or bare, on a small host or a large one, an article of several addresses keeps its words."""
    rng = random.Random(5)
    pages = [(k, f"http://h/{k}", PAGE) for k in range(5)]
    assert set(texts_of(spark, pages).values()) == {"Head&line\n\nOne two three\n\nFour five <6>"}
    bare, want = numbered([bare_pages(rng, "big.org", 200)])
    again = [(1000 + k, f"http://big.org/again{k}", bare[7][2]) for k in range(3)]
    got = texts_of(spark, bare + again)
    assert all(got[k] == want[k] for k in want) and {got[r[0]] for r in again} == {want[7]}


def test_html_articles_of_the_tables(spark):
    """Every page of the tables declares its article; that is what comes out, whole."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        own = "".join(re.findall(r"<article>.*?</article>", r.html, flags=re.S))
        assert got[r.page_id] == "\n\n".join(t for _, t in html.page_blocks(own))


def test_pipeline(spark, sf_dir):
    from facetry.llm import pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = cp.stash(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns and docs.count() <= kept
        kept = docs.count()
    assert decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    pieces = cp.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == kept
    assert entry.queries()["pipeline"].__module__ == "facetry.llm.pipeline"


def test_pipeline_equals_definition(spark, sf_dir):
    """run() against every stage by brute force in plain Python; language alone is taken from the operator's compressors."""
    from facetry.llm import pipeline as cp
    from tests.llm.test_dedup import lines_by_definition

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = {r.doc_id for r in language.identify(docs, language.learn(docs)).where("not rejected").collect()}
    texts = {r.doc_id: r.text for r in docs.collect() if r.doc_id in told}
    texts = lines_by_definition(sorted(texts.items()), rare=len(texts))
    grams = {d: {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} for d, t in texts.items() for ws in [t.encode().lower().split()]}
    label, by_gram = {d: d for d in texts}, {}
    for d in sorted(grams):
        for g in grams[d]:
            by_gram.setdefault(g, []).append(d)
    near = {(a, b) for ds in by_gram.values() for b in ds for a in ds if a < b}
    edges = [(a, b) for a, b in near if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    while any(label[a] != label[b] for a, b in edges):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    texts = {d: t for d, t in texts.items() if label[d] == d}
    word = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    items = [word(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    shingles = lambda ws, n: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
    clean = {}
    for d, t in texts.items():
        ws = word(t)
        held = shingles(ws, 5)
        if not any(len(held & (s := shingles(i, 5))) * 100 >= 80 * len(s) for i in items):
            clean[d] = t
    assert min(map(len, items)) >= 5 and len(clean) < len(texts)
    rows = cp.run(spark, sf_dir).collect()
    check_packed(rows, clean.values())
    assert {r.doc_id for r in rows} == set(clean)


def test_pipeline_edges(spark, make, edge_rows, sf_dir):
    from facetry.llm import pipeline as cp

    kept = []
    for rows in (edge_rows, []):
        docs = make(rows)
        columns = docs.columns
        for name, stage in cp.STAGES:
            docs = cp.stash(stage(spark, docs, sf_dir), name)
            if name != "packing":
                assert docs.columns == columns
                kept.append([r.doc_id for r in docs.collect()])
        assert {r.doc_id for r in docs.collect()} == set(kept[-1])
    told, deduped, single, clean = (sorted(k, key=str) for k in kept[:4])
    assert {1, 2, 3, 7}.isdisjoint(told) and told == deduped and {4, 5} <= set(told)
    assert clean == single == sorted(set(single), key=str) and 4 in single and kept[4:] == [[], [], [], []]
