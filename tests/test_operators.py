"""Operators on small inputs with known answers."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from facetry.functions import drift, geo, hashing, text, vectors
from facetry.model import Dataset
from facetry.operators import access, entities, federation, graph, normalize, proofs, provenance, search, semantic, spatial, temporal, tensors
from facetry.streaming import drift_state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def arr(*xs):
    return F.array(*(F.lit(float(x)) for x in xs))


def test_knn_order(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0])], "entity_id long, embedding array<double>")
    assert [r.entity_id for r in search.knn(v, arr(1, 0, 0), 2).collect()] == [1, 2]
    assert [r.entity_id for r in search.similar(v, arr(1, 0, 0)).orderBy("entity_id").collect()] == [1, 2]
    with pytest.raises(LookupError):
        search.vector_of(v, 9)


def test_vector_edges(spark):
    assert one(spark, vectors.cosine(arr(0, 0), arr(1, 0))) == 0
    assert one(spark, vectors.cosine_drift(F.array().cast("array<double>"), arr(1))) == 0.5
    assert one(spark, vectors.cosine_drift(arr(0, 0), arr(1, 0))) == 1.0
    assert one(spark, vectors.cosine_drift(arr(1, 0, 5), arr(1, 0))) == 0.0
    assert one(spark, vectors.consistency("dot_product", F.lit(None).cast("array<double>"), arr(1))) == 0
    assert one(spark, vectors.jaccard(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5
    assert not one(spark, vectors.is_valid(arr(1, float("nan")), 2)) and not one(spark, vectors.is_valid(arr(1), 2))
    assert one(spark, F.size(vectors.byte_fingerprint(F.lit("abcdefghij")))) == 4


def test_distances(spark):
    paris = one(spark, geo.haversine(F.lit(51.5074), F.lit(-0.1278), F.lit(48.8566), F.lit(2.3522)))
    far = one(spark, geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)))
    assert 330 < paris < 360 and 19_000 < far < 21_000
    for lat, lon in ((91.0, 0.0), (0.0, 181.0), (float("nan"), 0.0)):
        assert not one(spark, geo.is_wgs84(F.lit(lat), F.lit(lon)))


def test_radius_matches_all_points(spark):
    rows = [(f"p{i}", -89.5 + (i * 37 % 180) * 0.99, -179.0 + (i * 91 % 359)) for i in range(400)]
    p = spark.createDataFrame(rows, "entity_id string, lat double, lon double")
    for lat, lon in ((0.0, 179.5), (88.0, 10.0), (-45.0, -100.0)):
        want = p.where(geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) <= 1500).count()
        assert spatial.within_radius(p, lat, lon, 1500.0).count() == want
    with pytest.raises(ValueError):
        spatial.within_radius(p, 0.0, 0.0, 0.0)
    pairs = p.alias("a").crossJoin(p.alias("b")).where(geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")) <= 800).count()
    assert spatial.distance_join(p, p, 800.0).count() == pairs


def test_versions(spark):
    v = spark.createDataFrame([(1, "2024-01-01 00:00:00", 1, "alice"), (1, "2024-01-02 00:00:00", 2, "bob"), (2, "2024-01-05 00:00:00", 3, "eve")], "entity_id long, ts string, k long, payload string")
    v = temporal.number_versions(v.withColumn("ts", F.col("ts").cast("timestamp_ntz")), "entity_id", "ts", "k")
    assert {r.entity_id: r.payload for r in temporal.latest(v, ["payload"]).collect()} == {1: "bob", 2: "eve"}
    assert [r.payload for r in temporal.at_version(v, 1).orderBy("entity_id").collect()] == ["alice", "eve"]
    assert temporal.as_of(v, "2024-01-01 12:00:00", ["payload"]).collect()[0].payload == "alice"
    change = {r.entity_id: r.change for r in temporal.diff(temporal.at_version(v, 1), temporal.at_version(v, 2), "payload").collect()}
    assert change == {1: "Changed", 2: "Removed"}
    asked = spark.createDataFrame([(1, "2023-01-01 00:00:00", "q1"), (1, "2024-01-01 00:00:00", "q2")], "entity_id long, ts string, q string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert {r.q: r.payload for r in temporal.as_of_join(asked, v, ["payload"]).collect()} == {"q1": None, "q2": "alice"}
    with pytest.raises(ValueError):
        temporal.in_range(v, "2024-01-02", "2024-01-01")


def test_chain_and_tampering(spark):
    r = spark.createDataFrame([("e", k, t, "a\"ä", "2024-01-01T00:00:00", None, "d") for k, t in enumerate(("created", "modified", "normalized"), 1)], "entity_id string, seq long, event_type string, actor string, ts string, source string, description string")
    chain = provenance.append(r)
    assert provenance.verify(chain).first().chain_valid
    assert chain.orderBy("seq").first().parent_hash == hashing.GENESIS
    bad = provenance.verify(chain.withColumn("description", F.when(F.col("seq") == 2, "x").otherwise(F.col("description")))).first()
    assert (bad.chain_valid, bad.first_bad, bad.fault) == (False, 2, "altered_record")
    cut = provenance.verify(chain.where("seq <> 2")).first()
    assert cut.fault == "broken_link"


def test_graph_cycle(spark):
    e = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "q", "d")], "subject string, predicate string, object string")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.neighborhood(e, seed, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)}
    assert graph.insert(e, e).count() == 4 and graph.delete(e, e.where("predicate = 'q'")).count() == 3
    assert sorted((r.node, r.depth) for r in graph.paths(e, "a", 3).collect()) == [("a", 3), ("b", 1), ("c", 2), ("d", 3)]


def test_tensors(spark):
    t = spark.createDataFrame([(1, [2, 3], [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "entity_id long, shape array<int>, data array<double>")
    rows = lambda axis, how: [r.value for r in tensors.reduce_axis(t, axis, how).orderBy("at").collect()]
    assert rows(0, "sum") == [5, 7, 9] and rows(1, "prod") == [6, 120] and rows(1, "mean") == [2, 5]
    assert rows(2, "sum") == []
    s = one(spark, tensors.statistics(arr(1, 3, float("nan"), float("inf"))))
    assert (s["mean"], s["std"], s["has_nan"], s["has_inf"]) == (2, 1, True, True)
    assert one(spark, F.size(tensors.filled(F.array(F.lit(2), F.lit(3)), 1.0))) == 6


@pytest.mark.parametrize("kind,table", [("and", (0, 0, 0, 1)), ("or", (0, 1, 1, 1)), ("xor", (0, 1, 1, 0))])
def test_gates(spark, kind, table):
    rows = []
    for k, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        for out in (0, 1):
            rows += [(f"{k}{out}", w, float(v)) for w, v in enumerate((a, b, out))]
    witness = spark.createDataFrame(rows, "circuit string, wire int, value double")
    terms = spark.createDataFrame(proofs.gate(0, kind, 0, 1, 2), "constraint int, side string, wire int, coefficient double")
    got = {r.circuit: r.holds for r in proofs.constraints_hold(witness.select("circuit").distinct().crossJoin(terms), witness).collect()}
    assert got == {f"{k}{out}": out == table[k] for k in range(4) for out in (0, 1)}


def test_merkle_sizes(spark):
    import hashlib

    def root(xs):
        level = [hashlib.sha256(x.encode()).digest() for x in xs]
        while len(level) > 1:
            level = [hashlib.sha256(level[i] + level[min(i + 1, len(level) - 1)]).digest() for i in range(0, len(level), 2)]
        return level[0].hex()

    sizes = [*range(1, 10), 33, 100]
    rows = [(n, i, f"leaf{i}") for n in sizes for i in range(n)]
    leaves = spark.createDataFrame(rows, "tree long, idx long, data string")
    roots = {r.tree: r.root for r in proofs.merkle_roots(leaves).collect()}
    assert roots == {n: root([f"leaf{i}" for i in range(n)]) for n in sizes}
    paths = proofs.merkle_paths(leaves).join(proofs.merkle_roots(leaves), "tree")
    assert paths.count() == len(rows) and paths.where(proofs.path_root(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert one(spark, proofs.path_root(F.sha2(F.lit("x"), 256), F.array().cast("array<struct<h: string, left: boolean>>"))) != roots[1]
    assert proofs.merkle_roots(leaves.limit(0)).count() == 0


def test_chains_of_odd_entities(spark):
    """Large ids stay exact, and records without an entity are one chain."""
    big = 2**60 + 1
    rows = [(e, s, "created", "a", "t", None, f"{s}") for e in (big, big + 1, None) for s in (1, 2, 3)]
    r = spark.createDataFrame(rows, "entity_id long, seq long, event_type string, actor string, ts string, source string, description string")
    chain = provenance.append(r)
    assert {x.entity_id for x in chain.collect()} == {big, big + 1, None}
    assert {(x.entity_id, x.length, x.chain_valid) for x in provenance.verify(chain).collect()} == {(e, 3, True) for e in (big, big + 1, None)}


def test_folds_by_chunks(spark):
    """Averages and trust folded in chunks equal the fold over all in order."""
    import random

    rng = random.Random(2)
    rows = [(rng.choice("ab"), datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randint(0, 3000)), k, rng.random()) for k in range(700)]
    df = spark.createDataFrame(rows, "kind string, ts timestamp, seq long, score double")
    for seeds in (False, True):
        got = {r.kind: (r.average, r.n) for r in drift_state.ewma(df, "kind", first_seeds=seeds).collect()}
        for kind in "ab":
            xs = [x for k, t, s, x in sorted(rows, key=lambda r: (r[1], r[2])) if k == kind]
            s = xs[0] if seeds else 0.0
            for x in xs[1:] if seeds else xs:
                s = s * 0.9 + x * 0.1
            assert abs(got[kind][0] - s) < 1e-12 and got[kind][1] == len(xs)
    outcomes = spark.createDataFrame([(k, s, x > (0.3 if k == "a" else 0.75)) for k, _, s, x in rows], "store_id string, seq long, ok boolean")
    for chunk in (7, 10_000):
        got = {r.store_id: r.trust for r in federation.trust_fold(outcomes, chunk=chunk).collect()}
        for kind in "ab":
            t = 1.0
            for k, _, s, x in rows:
                if k == kind:
                    t = min(max(t + (0.05 if x > (0.3 if k == "a" else 0.75) else -0.1), 0.0), 1.0)
            assert abs(got[kind] - t) < 1e-9


def test_distance_join_of_all_places(spark):
    """Against all pairs: near the poles, over the date line, in small and large radii."""
    import math
    import random

    rng = random.Random(4)
    place = lambda: (rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), -89.9]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), rng.uniform(-180, -178)]))
    rows = [(k, *place()) for k in range(250)]
    p = spark.createDataFrame(rows, "entity_id long, lat double, lon double")

    def km(a, b):
        (_, y1, x1), (_, y2, x2) = a, b
        h = math.sin(math.radians(y2 - y1) / 2) ** 2 + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))

    for radius in (30.0, 400.0, 2500.0, 9000.0):
        want = {(a[0], b[0]) for a in rows for b in rows if km(a, b) <= radius}
        got = [(r.left, r.right) for r in spatial.distance_join(p, p, radius).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_proof_requests(spark):
    m = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    by = lambda *xs: one(spark, proofs.composition(m(*xs)))
    assert (by(), by("EXISTENCE"), by("PROVENANCE", "CITATION"), by("ACCESS", "EXISTENCE")) == ("independent", "independent", "sequential", "conjunction")
    problem = lambda kinds, contract, modalities: one(spark, proofs.request_problem(m(*kinds), F.lit(contract).cast("string"), m(*modalities)))
    assert problem(["NOPE", "INTEGRITY"], None, ["all"]) == "unknown:NOPE" and problem(["INTEGRITY"], "", ["all"]) == "contract:INTEGRITY"
    assert problem(["CITATION"], "c", ["graph"]) == "modality:CITATION" and problem(["CITATION"], "c", ["graph", "document"]) is None
    assert problem([], "c", []) == "no modality" and problem([], "c", ["all"]) == "no proof"
    r = spark.createDataFrame([(1, ["CUSTOM", "NOPE"], "mine"), (2, ["CUSTOM"], None)], "entity_id long, kinds array<string>, contract string")
    assert {(x.entity_id, x.circuit, x.ms) for x in proofs.obligations(r).collect()} == {(1, "mine", 500), (2, "custom-circuit", 500)}


def test_conflicts(spark):
    m = lambda *xs: F.array(*map(F.lit, xs))
    assert one(spark, normalize.resolve("lww", m("document", "vector"), F.lit(0.5))) == "vector"
    assert one(spark, normalize.resolve("priority", m("vector", "document"), F.lit(0.5), ["semantic", "document"])) == "document"
    assert one(spark, normalize.resolve("priority", m("vector", "tensor"), F.lit(0.5), ["semantic"])) == "vector"
    assert one(spark, normalize.resolve("merge", m("vector"), F.lit(0.8))) == "manual"
    assert one(spark, normalize.regenerate_from(m("vector", "document"), F.lit("document"), F.lit(0.4))) == "vector"
    assert one(spark, normalize.regenerate_from(m("vector"), F.lit("document"), F.lit(0.3))) is None


def test_drift_labels(spark):
    assert [one(spark, drift.severity(F.lit(x))) for x in (0.5, 0.51, 0.71, 0.91)] == ["Info", "Warning", "Critical", "Emergency"]
    tied = spark.createDataFrame([(0.4, 0.4, 0.1)], "a double, b double, c double").select(drift.primary(["a", "b", "c"]).alias("x")).first()
    assert tied.x == "b"
    assert one(spark, drift.provenance(F.lit(True), F.lit(0), F.lit(30.0), F.lit(10.0))) == pytest.approx(0.8)
    assert one(spark, drift.graph_document(F.array(F.lit("acme")), F.array(F.lit("acme corp"), F.lit("x")))) == 0.25


def test_policies(spark):
    r = spark.createDataFrame([(1, "s1", 1, "x"), (1, "s2", 2, "y"), (2, "s1", 1, "z"), (2, "s2", 2, "z")], "entity_id long, store_id string, ts long, value string")
    got = lambda p: sorted((x.entity_id, x.store_id, x.value) for x in federation.apply_policy(r, p, ["value"]).collect())
    assert got("STRICT") == [(2, "s1", "z"), (2, "s2", "z")] and got("LATEST") == [(1, "s2", "y"), (2, "s2", "z")]
    assert got("REPAIR")[0] == (1, "s1", "y") and len(got("TOLERATE")) == 4
    assert one(spark, federation.matches(F.lit("eu/a"), "eu/*")) and not one(spark, federation.matches(F.lit("us/a"), "eu/*"))
    assert one(spark, federation.store_score(F.lit(1.0), F.lit(None).cast("double"))) == pytest.approx(0.85)


def test_text(spark):
    d = spark.createDataFrame([("d1", "Rust Programming"), ("d2", "Python Tutorial"), ("d3", None)], "entity_id string, body string")
    assert [r.entity_id for r in d.where(text.contains_all(F.col("body"), "rust")).collect()] == ["d1"]
    assert [r.entity_id for r in search.bm25(d, "rust", 5, ("body",)).collect()] == ["d1"]
    assert one(spark, text.snippet(F.lit("some Rust here"), "rust")) == "some <b>Rust</b> here"
    assert one(spark, text.local_name(F.lit("http://x/y#z"))) == "y#z" and one(spark, text.local_name(F.lit("a#b"))) == "b"


def test_types(spark):
    t = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "type string, parent string")
    assert semantic.hierarchy(t).where("type = 'a'").count() == 3  # a cycle ends
    facts = spark.createDataFrame([(1, "T", {"n": "7", "s": "ab"}), (2, "T", {"n": "x"})], "entity_id long, type string, properties map<string,string>")
    c = spark.createDataFrame([("T", "n", "range", None, 0.0, 5.0), ("T", "s", "required", None, None, None), ("T", "s", "odd", None, None, None)], "type string, property string, kind string, argument string, low double, high double")
    got = {(r.entity_id, r.property, r.broken) for r in semantic.validate(facts, c).collect()}
    assert got == {(1, "n", "range"), (2, "s", "required"), (1, "s", "unknown"), (2, "s", "required"), (2, "s", "unknown")}


def test_log_and_slots(spark):
    log = spark.createDataFrame([(1, 1, "put", "a"), (1, 2, "put", "b"), (2, 1, "put", "c"), (2, 2, "delete", None)], "entity_id long, seq long, op string, payload string")
    assert [tuple(r)[:2] + (r.payload,) for r in entities.current(log).collect()] == [(1, 2, "b")]
    wide = spark.createDataFrame([(1, ("t",), None)], "entity_id long, document struct<title: string>, vector struct<label: int>")
    assert entities.select_slots(wide, ["*"]).columns == ["entity_id", "vector", "document"]
    assert entities.project(wide, "document.title").columns == ["entity_id", "document.title"]


def test_sources(spark, tmp_path):
    from facetry.sources import files

    entity = {"id": "e1", "document": {"title": "t", "body": "b"}, "graph": {"relationships": [{"predicate": "relatedTo", "target": "e2"}]}, "vector": {"embedding": [0.1, 0.2]}}
    (tmp_path / "e.jsonl").write_text(json.dumps(entity) + "\n{broken\n")
    t = files.entity_tables(files.read_entities(spark, str(tmp_path / "e.jsonl")))
    assert t["document"].count() == 1 and t["graph"].first().object == "e2" and t["tensor"].count() == 0
    (tmp_path / "scans").mkdir()
    (tmp_path / "scans" / "s.json").write_text(json.dumps({"program_path": "p", "language": "rust", "weak_points": [{"category": "c", "severity": "High"}]}, indent=1))
    assert files.read_scans(spark, str(tmp_path / "scans")).first().severity == "High"
    files.write(t["vector"], str(tmp_path / "v"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "v")).first().embedding == "[0.1,0.2]"
    with pytest.raises(ValueError):
        files.write(t["vector"], str(tmp_path / "w"), "xml")




def test_fan_out(spark):
    def broken():
        raise RuntimeError("store is down")

    rows, errors = federation.fan_out({"a": lambda: spark.range(2), "b": broken, "c": lambda: spark.range(1).withColumn("x", F.lit(1))})
    assert sorted((r.id, r.store_id, r.x) for r in rows.collect()) == [(0, "a", None), (0, "c", 1), (1, "a", None)] and errors == {"b": "store is down"}
    assert federation.fan_out({"b": broken})[0] is None


def test_composable(spark):
    rules = spark.createDataFrame([("a", "A", ["B", "C"]), ("b", "B", ["A"]), ("c", "C", ["A", "B"])], "contract string, kind string, accepts array<string>")
    r = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b", "c"]), (3, ["x"]), (4, ["a", "x"])], "entity_id long, contracts array<string>")
    assert {(x.entity_id, x.composable) for x in proofs.composable(r, rules).collect()} == {(1, True), (2, False), (3, True), (4, False)}


def test_access(spark):
    ask = [(1, "r", "vector", 5, "read"), (1, "g", "vector", 5, "read"), (1, "g", "document", None, "read"), (2, "x", "vector", 5, "admin"), (3, "x", "vector", 5, "admin")]
    q = spark.createDataFrame(ask, "client int, role string, modality string, entity_id int, permission string")
    grants = spark.createDataFrame([("r", None, "read"), ("g", "document", "read")], "role string, modality string, permission string")
    acl = spark.createDataFrame([(5, 2, "admin"), (5, 2, "admin")], "entity_id int, client int, permission string")
    got = sorted((r.client, r.role, r.modality, r.reason, r.allowed) for r in access.decide(q, grants, acl).collect())
    assert got == [(1, "g", "document", "modality", True), (1, "g", "vector", "denied", False), (1, "r", "vector", "global", True), (2, "x", "vector", "entity", True), (3, "x", "vector", "denied", False)]


def test_alert_texts_round_as_printf(spark):
    """Halves that doubles hold exactly go to even; others by what the double is."""
    rows = [("a", k / 2000, 0.0125) for k in range(1, 4001)] + [("a", 1234567.0625, 0.8125)]
    x = spark.createDataFrame(rows, "kind string, score double, top double").where("score > top")
    got = {r.score: r.message for r in drift_state.alerts(x, F.col("top")).collect()}
    assert got == {s: "%s drift %.3f exceeds %.3f" % (k, s, t) for k, s, t in rows if s > t}
    assert got[0.8125].startswith("a drift 0.812 ")


def test_polygon_leaves_its_ring_out(spark):
    ring = [(-80.0, -150.0), (-20.0, -150.0), (-20.0, -30.0)]
    on = [*ring, (-50.0, -150.0), (-20.0, -90.0), (-50.0, -90.0)]  # corners, and a point on each edge
    inside = [(-50.0, -149.99), (-20.01, -90.0), (-50.0, -90.01), (-79.99, -149.99)]
    outside = [(-50.0, -150.01), (-19.99, -90.0), (-50.0, -89.99), (-80.0, -150.01), (-80.0, -100.0), (0.0, 0.0)]
    points = spark.createDataFrame(on + inside + outside, "lat double, lon double")
    for r in (ring, ring[::-1]):
        assert sorted(map(tuple, spatial.in_polygon(points, r).collect())) == sorted(inside)


def test_polygon_of_all_places(spark, tmp_path):
    """Keys up to 36,000 give every place there is; the query gives its SQL's rows."""
    import duckdb

    from facetry.plans import graph as plans
    from facetry.plans.registry import SQL

    for table, key in (("customer", "c_custkey"), ("supplier", "s_suppkey")):
        spark.range(1, 36_001).withColumnRenamed("id", key).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    for table in ("customer", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    got = [r.entity_id for r in plans.spatial_polygon(Dataset(spark, str(tmp_path))).collect()]
    assert sorted(got) == sorted(r[0] for r in con.execute(SQL["spatial_polygon"]).fetchall())
