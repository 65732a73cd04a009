"""Line, SimHash and suffix dedup."""

import random
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from facetry.llm import lines, simhash, suffixes
from facetry.llm.components import connected_components


def simhash_by_definition(text, width=4):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes_by_definition(fps, limit=4):
    """doc_id: smallest id reachable; fps: list of (doc_id, int)."""
    top = {}
    distinct = sorted({f for _, f in fps})
    up = {f: f for f in distinct}

    def find(f):
        while up[f] != f:
            f = up[f]
        return f

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if (a ^ b).bit_count() <= limit:
                up[find(a)] = find(b)
    for d, f in fps:
        if d is not None:
            top[find(f)] = min(d, top.get(find(f), d))
    return [(d, f"{f:016x}", top.get(find(f))) for d, f in fps]


def rows_of(df):
    return sorted(((r.doc_id, bytes(r.fp).hex(), r.component_id) for r in df.collect()), key=str)


def test_simhash_equals_definition(sf_docs, spark):
    rows = [(r.doc_id, r.text) for r in sf_docs.where("doc_id < 700").collect()]
    want = classes_by_definition([(d, simhash_by_definition(t)) for d, t in rows])
    assert rows_of(simhash.simhash_classes(sf_docs.where("doc_id < 700"))) == sorted(want, key=str)


def test_simhash_edges(make, edge_rows):
    want = classes_by_definition([(d, simhash_by_definition(t)) for d, t in edge_rows])
    assert rows_of(simhash.simhash_classes(make(edge_rows))) == sorted(want, key=str)
    assert simhash.simhash_classes(make([])).count() == 0


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    """Fingerprints that all share keys, in many blocks, give the classes of comparing all pairs."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 9))) for _ in range(900)})
    df = simhash.with_pivots(spark.createDataFrame([(i, bytearray(f.to_bytes(8, "big"))) for i, f in enumerate(fps)], "node long, fp binary"), 1)
    monkeypatch.setattr(simhash, "BLOCK_ROWS", 40)
    labels = {r.node: r.label for r in connected_components(simhash.links(df, simhash.pigeonhole_masks(4), 1, 4), "a", "b").collect()}
    want = {d: c for d, _, c in classes_by_definition(list(enumerate(fps)))}
    assert {i: labels.get(i, i) for i in range(len(fps))} == want


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 63, (300, 1), dtype=np.uint64)
    fps[150:] = fps[:150] ^ np.uint64(0b1011)
    tables = simhash.pivot_distances(fps).T.astype(np.int16)
    labels = simhash._linked(fps, tables, np.zeros(300, int), np.zeros(300, int), np.zeros(300, bool), 3)
    assert (labels[150:] == np.arange(150)).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_stage_settings_find_near_copies(spark, make):
    """Copies with a few words changed, Jaccard similarity from 0.8 up, are linked by the pipeline's settings; others aren't."""
    from facetry.llm import pipeline as cp

    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    rows, pairs = [], []
    for k in range(150):
        words = rng.choices(vocabulary, k=rng.randint(150, 500))
        copy = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) // 70)):
            copy[at] = rng.choice(vocabulary)
        grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
        j = len(grams(words) & grams(copy)) / len(grams(words) | grams(copy))
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
        pairs.append((2 * k, 2 * k + 1, j))
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, make(rows), "").collect()}
    near = [b for _, b, j in pairs if j >= 0.8]
    assert len(near) > 100 and sum(b not in kept for b in near) / len(near) >= 0.95
    assert all(a in kept for a, _, _ in pairs)


def test_stage_equals_exact_similarity(spark, make, monkeypatch):
    """Every pair of similarity 0.8 or more is found, barely similar ones too, and none below it goes."""
    from facetry.llm import pipeline as cp

    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    common = " ".join(rng.choices(vocabulary, k=30))
    texts = {0: "", 1: None, 2: "a b", 3: "a b"}
    for k in range(4, 400, 2):
        words = rng.choices(vocabulary, k=rng.choice([8, 30, 150, 400]))
        copy = list(words)
        for at in rng.sample(range(len(words)), max(1, len(words) * rng.choice([15, 20, 25, 30, 40]) // 1000)):
            copy[at] = rng.choice(vocabulary)
        tail = [common] if k % 3 == 0 else []
        texts |= {k: " ".join(words + tail), k + 1: " ".join(copy + tail)}
    grams = {d: {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} for d, t in texts.items() if (ws := (t or "").split()) or True}
    up = {d: d for d in texts}

    def find(d):
        return d if up[d] == d else find(up[d])

    near = far = 0
    for b in grams:
        for a in range(b):
            j = len(grams[a] & grams[b]) / len(grams[a] | grams[b])
            near, far = near + (0.8 <= j < 0.86), far + (0.65 <= j < 0.8)
            if j >= 0.8:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    assert near > 15 and far > 15
    for rows in (1024, 2):
        monkeypatch.setattr(simhash, "SET_ROWS", rows)
        kept = {r.doc_id for r in cp.drop_near_duplicates(spark, make(list(texts.items())), "").collect()}
        assert kept == {find(d) for d in texts}


def test_patience():
    a, b = [1, 2, 3, 4, 5, 9], [1, 7, 3, 4, 8, 9]
    assert lines.patience(a, b) == [(0, 0), (2, 2), (3, 3), (5, 5)]
    assert lines.patience([], [1]) == [] and lines.patience([1, 1, 2], [1, 2]) == [(0, 0), (2, 1)]
    rng = random.Random(2)
    for _ in range(300):
        x, y = ([rng.randint(0, 12) for _ in range(rng.randint(0, 15))] for _ in range(2))
        got = lines.patience(x, y)
        assert all(x[i] == y[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def part_of(doc_id):
    return xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42) % lines.OWNERS


def lines_by_definition(rows, min_chars=lines.MIN_CHARS, rare=lines.RARE, every_pair=False):
    """Text per doc_id, pair by pair; every_pair: all documents that share a line, not the owners alone."""
    seqs = {d: [x.strip(" ") for x in t.split("\n")] for d, t in rows if t is not None}
    holders = defaultdict(set)
    for d, ls in seqs.items():
        for x in ls:
            if len(x) >= min_chars:
                holders[x].add(d)
    owners = {x: sorted(h) if every_pair else [min(ds) for k in range(lines.OWNERS) if (ds := [d for d in h if part_of(d) == k])] for x, h in holders.items()}
    gone = defaultdict(set)
    for d, ls in seqs.items():
        pairs = defaultdict(set)
        for x in {x for x in ls if len(x) >= min_chars}:
            for o in owners[x]:
                if o < d:
                    pairs[o].add(x)
        for o, shared in pairs.items():
            if len(shared) > 1 or min(len(holders[x]) for x in shared) <= rare:
                for s, e in lines.blocks(lines.patience(seqs[o], ls), [len(x) >= min_chars for x in ls]):
                    gone[d].update(range(s, e))
    return {d: "\n".join(x for i, x in enumerate(dict(rows)[d].split("\n")) if i not in gone[d]) for d in seqs}


def test_lines_recall_of_all_pairs(spark):
    """Of the lines that go when every pair of documents with a common line is aligned, nearly all go, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    whole = {d: len(t.split("\n")) for d, t in rows if t is not None}
    want, got = lines_by_definition(rows, rare=len(rows), every_pair=True), {r.doc_id: r.text for r in lines.dedup_lines(docs, rare=None).collect() if r.text is not None}
    count = lambda texts: sum(n - len(texts[d].split("\n")) * bool(texts[d]) for d, n in whole.items())
    assert count(got) >= 0.97 * count(want) and count(want) > 1000
    for d in whole:
        left = iter(got[d].split("\n"))
        assert all(x in left for x in want[d].split("\n") if x)  # what all pairs leave is left, in order


def test_lines_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.text for r in lines.dedup_lines(docs, rare=None).collect() if r.text is not None}
    assert got == lines_by_definition(rows, rare=len(rows), every_pair=True)


@pytest.mark.parametrize("wider", [4, lines.WIDER])
def test_lines_that_owners_leave(make, monkeypatch, wider):
    """Recurring, crossing, blank and short lines, copies among them; no document takes what no pair takes."""
    monkeypatch.setattr(lines, "WIDER", wider)
    rng = random.Random(wider)
    pool = [f"line number {k} that many documents hold" for k in range(7)] + ["", "", "short", " brief "]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(1, 7)) + [f"own {rng.randint(0, 9)}"] * rng.randint(0, 1))) for k in range(500)]
    rows += [(k, f"words that open document {k}\n{pool[0]}") for k in range(500, 700)] + [(700, f"{pool[0]}\nwords of 700\n{pool[0]}\n"), (701, f"{pool[0]}\n701\n{pool[0]}\n"), (702, rows[9][1])]
    got = {r.doc_id: r.text for r in lines.dedup_lines(make(rows), rare=None).collect()}
    want = lines_by_definition(rows, rare=len(rows), every_pair=True)
    assert [d for d in want if got[d] != want[d]] == [] and want != lines_by_definition(rows, rare=len(rows))


def test_stage_takes_lines_that_owners_leave(spark, make):
    """A line twice in four documents, after 200 that have it once and own all its classes."""
    from facetry.llm import pipeline as cp

    line = "a line that many documents hold, at their end"
    rows = [(k, f"words that open document {k}\n{line}") for k in range(200)] + [(k, f"{line}\nwords of {k} alone here\n{line}\nend {k}") for k in range(200, 204)]
    want = lines_by_definition(rows, rare=len(rows), every_pair=True)
    assert want != lines_by_definition(rows, rare=len(rows))
    assert {r.doc_id: r.text for r in cp.dedup_lines(spark, make(rows), "").collect()} == want


def test_stage_asks_no_holder_in_vain(spark, make, monkeypatch):
    """A line that all documents hold twice and none takes: beyond the owners, only pairs with a common start (one) or anchor (six)."""
    from facetry.llm import pipeline as cp

    line = "a line that all documents hold twice in them"
    rows = [(k, f"{k} opens\n{line}\nwords of {k}\n{line}\n{k} ends\n") for k in range(400)]
    rows += [(k, f"{line}\n{k} opens\n{line}\n{k} ends") for k in (400, 401)]
    rows += [(k, f"{k} opens\n{line}\nanchor\n{k} between\n{line}\nwords {k}\n{line}\n{k} ends") for k in range(402, 406)]
    made, aligned = [], lines.aligned

    def counted(pairs, seqs):
        made.append(pairs.count())
        return aligned(pairs, seqs)

    monkeypatch.setattr(lines, "aligned", counted)
    monkeypatch.setattr(lines, "WIDER", 4)
    monkeypatch.setattr(lines, "PART", 50, raising=False)
    got = {r.doc_id: r.text for r in cp.dedup_lines(spark, make(rows), "").collect()}
    assert got == lines_by_definition(rows, rare=len(rows), every_pair=True)
    assert got[401] == "401 opens\n401 ends" and got[405].count(line) == 2 and got[399] == rows[399][1]
    assert made[-1] <= 1 + 4 * 3 // 2 and sum(made) < 5 * len(rows)


def test_meeting_keys_lose_no_pair():
    """A pair without common key takes nothing; one without common anchor outside its ends takes these alone."""
    rng = random.Random(7)
    for _ in range(5000):
        first, last, telling = [rng.choices(range(6), k=rng.randint(0, 2)) for _ in range(2)] + [set(rng.sample(range(6), 3))]
        o, d = (first + rng.choices(range(6), k=rng.randint(1, 6)) + last for _ in range(2))
        marks = [[x in telling for x in ls] for ls in (o, d)]
        taken = {j for s, e in lines.blocks(lines.patience(o, d), marks[1]) for j in range(s, e)}
        (ends, anchors), (ends_d, anchors_d) = lines.meeting_keys(o, marks[0]), lines.meeting_keys(d, marks[1])
        if not any(u != v and s != t for (u, s), (v, t) in ((anchors[m], anchors_d[m]) for m in anchors.keys() & anchors_d.keys())):
            p = next((k for k, (x, y) in enumerate(zip(o, d)) if x != y), min(len(o), len(d)))
            q = next((k for k, (x, y) in enumerate(zip(o[p:][::-1], d[p:][::-1])) if x != y), min(len(o), len(d)) - p)
            assert taken <= set(range(p)) | set(range(len(d) - q, len(d))) and (not taken or ends & ends_d)


def test_lines_equal_definition(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    got = {r.doc_id: r.text for r in lines.dedup_lines(sf_docs).collect()}
    assert got == lines_by_definition(rows)


def test_lines_edges(make, edge_rows):
    got = lines.dedup_lines(make(edge_rows)).collect()
    assert len(got) == len(edge_rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[1].text is None and by[1].n_lines == 0 and by[2].text == "" and by[9].text == "end" and by[9].n_removed == 4000
    assert by[4].n_removed == 0 and by[6].text == ""
    assert lines.dedup_lines(make([])).count() == 0


def test_common_line_alone_stays(make):
    """A single line of many documents is no overlap; with a second one it is."""
    notice, other = "licensed to everyone under these terms", "a second line that a few documents share"
    rows = [(k, f"document {k} has words of its own\n{notice}") for k in range(30)] + [(50, f"{notice}\n{other}"), (51, f"own words of fifty-one here\n{notice}\n{other}")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(make(rows)).collect()}
    assert got[29].endswith(notice) and got[51] == "own words of fifty-one here"


def test_queries_pair_lines_of_any_frequency(spark, make, tmp_path):
    """op1 and the stage take a passage of 15 documents from all later ones, and a block whose lines are first seen apart."""
    from facetry.llm import pipeline as cp
    from facetry.llm import queries

    passage, one, two = "a passage of one line that many documents hold", "the first line of a common block", "the second line of a common block"
    rows = [(k, f"own words of document number {k}\n{passage}") for k in range(15)]
    rows += [(k, f"words of document {k} alone here\n{one if k % 2 else two}") for k in range(20, 44)] + [(k, f"{one}\n{two}\nwords that only {k} has in it") for k in range(50, 65)]
    make(rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = lines_by_definition(rows, rare=len(rows))
    assert want[14] == "own words of document number 14" and want[64] == "words that only 64 has in it"
    assert {r.doc_id: r.text for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in cp.dedup_lines(spark, make(rows), "").collect()} == want


def test_lines_of_any_frequency_equal_definition(sf_docs):
    rows = [(r.doc_id, r.text) for r in sf_docs.collect()]
    assert {r.doc_id: r.text for r in lines.dedup_lines(sf_docs, rare=None).collect()} == lines_by_definition(rows, rare=len(rows))


@pytest.fixture(scope="module")
def repeats():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdef é", k=rng.randint(1, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    rows = []
    for k in range(120):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(3)]
        text = rng.choice(passages).join(parts[:2]) + rng.choice(["", passages[0][10:250], "a" * 300, "xy" * 130]) + parts[2]
        rows.append((k, text))
    rows += [(200, rows[3][1]), (201, rows[3][1][:-1] + "!"), (202, "z" * 99), (203, "z" * 100), (204, "z" * 101), (205, ""), (206, None)]
    return rows


def suffix_rows(df):
    import hashlib

    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()}


def test_suffixes_equal_definition(make, repeats):
    want = suffixes.brute_force([(d, (t or "").encode()) for d, t in repeats])
    assert suffix_rows(suffixes.dedup_substrings(make(repeats).repartition(5))) == want


def test_hot_grams_take_the_other_ways(make, repeats, monkeypatch):
    """The same bytes go whether grams are digested before or after the first aggregation, all or the frequent ones, or merged."""
    want = suffixes.brute_force([(d, (t or "").encode()) for d, t in repeats])
    for hot, sample, hottest in ((1, 1, 10**9), (20, 1, 10**9), (20, 1, 1), (1, 16, 1), (4, 16, 1), (10**9, 16, 1)):
        monkeypatch.setattr(suffixes, "HOT", hot)
        monkeypatch.setattr(suffixes, "SAMPLE", sample)
        monkeypatch.setattr(suffixes, "HOTTEST", hottest)
        assert suffix_rows(suffixes.dedup_substrings(make(repeats).repartition(3))) == want


def test_suffixes_in_small_segments(make, repeats, monkeypatch):
    """Texts cut into many segments, and many runs for each target, give the same."""
    import facetry.llm.suffixes as s

    monkeypatch.setattr(s, "SEGMENT", 350)
    rows = [(d, p) for d, p in repeats]
    want = s.brute_force([(d, (t or "").encode()) for d, t in rows])
    batch = [pa_batch(rows)]
    held = [x for part in s._segments(iter(batch)) for x in part]
    assert max(len(x[2]) for x in held) <= 350 + s.WINDOW - 1
    assert want[200][1] == want[200][0]


def pa_batch(rows):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows]), pa.array([(t or "").encode() for _, t in rows])], names=["doc", "text"])


def test_suffixes_on_tables(sf_docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in sf_docs.where("doc_id < 400").collect()]
    assert suffix_rows(suffixes.dedup_substrings(sf_docs.where("doc_id < 400"))) == suffixes.brute_force(rows)


def test_suffix_edges(make, edge_rows):
    got = suffixes.dedup_substrings(make(edge_rows)).collect()
    assert len(got) == len(edge_rows) and suffixes.dedup_substrings(make([])).count() == 0
    assert {r.n_bytes for r in got if r.doc_id in (1, 2)} == {0}


def test_merge_never_loses_order():
    rng = random.Random(6)
    entries = [(bytes(rng.choices(b"ab", k=rng.randint(1, 12))), b"left", k, k) for k in range(400)]
    runs = [suffixes.write_run(entries[k::7]) for k in range(7)] + [b""]
    merged = list(suffixes.merge_runs(runs))
    assert [m[1] for m in merged] == sorted(e[0] for e in entries) and sorted(m[3] for m in merged) == list(range(400))
    assert all(m[0] == suffixes.common_prefix(a[1], m[1]) for a, m in zip(merged, merged[1:]))
    assert list(suffixes.merge_runs([])) == []
