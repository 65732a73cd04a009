"""Hash evidence: commitments, Merkle trees, arithmetic constraints and certificates. These are data checks, not zero-knowledge proofs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import joined
from ..shared import bounded

ZEROS = "0" * 64
#: Absolute error up to which a constraint holds.
EPSILON = 1e-10

# Proof kinds with what they need, and pairs of contracts that can't stand together.
NEEDS_CONTRACT = {"INTEGRITY", "CITATION", "CUSTOM", "SANCTIFY"}
SEQUENTIAL = {"PROVENANCE", "CITATION"}
KINDS = ["EXISTENCE", "CITATION", "ACCESS", "INTEGRITY", "PROVENANCE", "CUSTOM", "ZKP", "PROVEN", "SANCTIFY", "CONSISTENCY", "FRESHNESS"]

# The modalities of which a kind needs one, and each kind's circuit, estimated milliseconds and witness fields.
NEEDS_ONE_OF = {"INTEGRITY": ["semantic"], "PROVENANCE": ["provenance"], "FRESHNESS": ["temporal"], "CITATION": ["document", "semantic"], "PROVEN": ["semantic"], "SANCTIFY": ["semantic"]}
OBLIGATIONS = {
    "EXISTENCE": ("existence-proof-v1", 50, ["hexad_id", "timestamp", "modality_count"]),
    "INTEGRITY": ("integrity-proof-v1", 200, ["content_hash", "merkle_root", "schema_version"]),
    "CONSISTENCY": ("consistency-proof-v1", 250, ["modality_a", "modality_b", "drift_score", "threshold"]),
    "PROVENANCE": ("provenance-proof-v1", 300, ["chain_hash", "chain_length", "origin", "actor_trail"]),
    "FRESHNESS": ("freshness-proof-v1", 100, ["last_modified", "max_age_ms", "version_count"]),
    "ACCESS": ("access-control-v1", 150, ["principal_id", "resource_id", "permission_set"]),
    "CITATION": ("citation-proof-v1", 100, ["source_ids", "citation_chain", "reference_count"]),
    "CUSTOM": (None, 500, ["circuit_inputs"]),
    "ZKP": (None, 400, ["claim", "blinding_nonce"]),
    "PROVEN": ("proven-cert-v1", 200, ["certificate_hash", "proof_data"]),
    "SANCTIFY": ("sanctify-v1", 200, ["contract_hash", "security_level"]),
}


def merkle_levels(leaves: DataFrame) -> list[DataFrame]:
    """Levels (tree, idx, h, n) from the leaf hashes (tree, idx, data) up to the roots; n is a tree's size at that level.

    Places run from 0 without gaps. A level pairs by idx div 2 with one grouped aggregate; the last node of an odd level
    pairs with itself, and a root is carried up unchanged. The largest place, one number, tells how many levels there are.
    """
    leaves = leaves.select("tree", F.col("idx").cast("long").alias("idx"), F.sha2(F.col("data").cast("binary"), 256).alias("h"))
    sizes = leaves.groupBy("tree").agg((F.max("idx") + 1).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 1
    out = [leaves.join(sizes, "tree")]
    for _ in range((most - 1).bit_length()):
        up = out[-1].groupBy("tree", F.shiftright("idx", 1).alias("idx")).agg(F.min_by("h", "idx").alias("l"), F.max_by("h", "idx").alias("r"), F.max("n").alias("n"))
        out.append(up.select("tree", "idx", F.when(F.col("n") == 1, F.col("l")).otherwise(joined(F.col("l"), F.col("r"))).alias("h"), F.shiftright(F.col("n") + 1, 1).alias("n")))
    return out


def merkle_roots(leaves: DataFrame) -> DataFrame:
    """(tree, root) for trees of any size."""
    return merkle_levels(leaves)[-1].select("tree", F.col("h").alias("root"))


def merkle_paths(leaves: DataFrame) -> DataFrame:
    """(tree, idx, leaf, path): the sibling hashes from each leaf to the root. One equi-join a level."""
    levels = merkle_levels(leaves)
    out = levels[0].select("tree", "idx", "n", F.col("h").alias("leaf"), F.array().cast("array<struct<h: string, left: boolean>>").alias("path"))
    for k, level in enumerate(levels[:-1]):
        at = F.shiftright("idx", k)
        beside = F.least(at.bitwiseXOR(F.lit(1).cast("long")), F.col("n") - 1)  # an odd last node is its own sibling
        sib = level.where("n > 1").select("tree", F.col("idx").alias("beside"), F.col("h").alias("sib"))
        both = out.withColumn("left", (at % 2 == 1)).withColumn("beside", beside).join(sib, ["tree", "beside"], "left")
        step = F.when(F.col("sib").isNotNull(), F.array(F.struct(F.col("sib").alias("h"), F.col("left").alias("left")))).otherwise(F.array().cast("array<struct<h: string, left: boolean>>"))
        out = both.select("tree", "idx", F.shiftright(F.col("n") + 1, 1).alias("n"), "leaf", F.concat("path", step).alias("path"))
    return out.drop("n")


def path_root(leaf: Column, path: Column) -> Column:
    return F.aggregate(path, leaf, lambda h, p: F.when(p["left"], joined(p["h"], h)).otherwise(joined(h, p["h"])))


def constraints_hold(terms: DataFrame, witness: DataFrame) -> DataFrame:
    """(circuit, holds): every constraint's (a.w) x (b.w) equals c.w.

    terms: (circuit, constraint, side in a/b/c, wire, coefficient); witness: (circuit, wire, value). Sparse dot products
    are one join and one grouped sum; wire -1 is the constant one; an unknown wire is 0.
    """
    w = terms.join(witness, ["circuit", "wire"], "left").withColumn("value", F.when(F.col("wire") == -1, F.lit(1.0)).otherwise(F.coalesce("value", F.lit(0.0))))
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("coefficient") * F.col("value")).otherwise(0.0)).alias(s)
    sums = w.groupBy("circuit", "constraint").agg(side("a"), side("b"), side("c"))
    return sums.groupBy("circuit").agg(F.bool_and(F.abs(F.col("a") * F.col("b") - F.col("c")) <= EPSILON).alias("holds"))


def gate(constraint: int, kind: str, a: int, b: int, out: int) -> list[tuple[int, str, int, float]]:
    """(constraint, side, wire, coefficient) terms of one gate over 0/1 wires; wire -1 is one."""
    c = constraint
    if kind == "and":
        return [(c, "a", a, 1.0), (c, "b", b, 1.0), (c, "c", out, 1.0)]
    if kind == "or":  # a x b = a + b - out
        return [(c, "a", a, 1.0), (c, "b", b, 1.0), (c, "c", a, 1.0), (c, "c", b, 1.0), (c, "c", out, -1.0)]
    if kind == "xor":  # 2a x b = a + b - out
        return [(c, "a", a, 2.0), (c, "b", b, 1.0), (c, "c", a, 1.0), (c, "c", b, 1.0), (c, "c", out, -1.0)]
    if kind == "not":  # (1 - a) x 1 = out
        return [(c, "a", -1, 1.0), (c, "a", a, -1.0), (c, "b", -1, 1.0), (c, "c", out, 1.0)]
    raise ValueError(kind)


def composition(kinds: Column) -> Column:
    """independent for one obligation or none, sequential with both provenance and citation, else conjunction."""
    both = F.size(F.array_intersect(kinds, _strings(sorted(SEQUENTIAL)))) == len(SEQUENTIAL)
    return F.when(F.size(kinds) <= 1, "independent").when(both, "sequential").otherwise("conjunction")


def request_problem(kinds: Column, contract: Column, modalities: Column) -> Column:
    """The first problem of a proof request, null if it has none: no modality, no proof, an unknown kind, a kind without its
    contract, a kind none of whose modalities is asked ('all' asks every one)."""
    bare = F.coalesce(contract == "", F.lit(True))
    wrong = F.transform(kinds, lambda k: F.when(~k.isin(KINDS), F.concat(F.lit("unknown:"), k)).when(k.isin(*NEEDS_CONTRACT) & bare, F.concat(F.lit("contract:"), k)))
    needs = F.create_map(*(x for k, ms in NEEDS_ONE_OF.items() for x in (F.lit(k), _strings(ms))))
    unmet = F.filter(kinds, lambda k: ~F.array_contains(modalities, "all") & F.coalesce(~F.arrays_overlap(F.try_element_at(needs, k), modalities), F.lit(False)))
    return (
        F.when(F.size(modalities) == 0, "no modality")
        .when(F.size(kinds) == 0, "no proof")
        .otherwise(F.coalesce(F.get(F.filter(wrong, lambda x: x.isNotNull()), F.lit(0)), F.concat(F.lit("modality:"), F.get(unmet, F.lit(0)))))
    )


def obligations(requests: DataFrame) -> DataFrame:
    """(entity_id, kind, circuit, witness, ms) of proof requests (entity_id, kinds, contract): one row per known kind asked.

    A custom proof's circuit is its contract. The table of kinds has a fixed eleven rows, so it is broadcast.
    """
    known = requests.sparkSession.createDataFrame([(k, *v) for k, v in OBLIGATIONS.items()], "kind string, own string, ms int, witness array<string>")
    circuit = F.when(F.col("kind") == "CUSTOM", F.coalesce("contract", F.lit("custom-circuit"))).otherwise(F.col("own"))
    return requests.select("entity_id", "contract", F.explode("kinds").alias("kind")).join(F.broadcast(known), "kind").select("entity_id", "kind", circuit.alias("circuit"), "witness", "ms")


def first_failed(gates: dict[str, Column]) -> Column:
    """The name of the first gate that doesn't hold, null if all do: the result of their conjunction."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), k) for k, c in gates.items()))


def _strings(xs: list[str]) -> Column:
    return F.array(*map(F.lit, xs))


def certificates(obligations: DataFrame) -> DataFrame:
    """Adds certificate, the SHA-256 of obligation, witness and time."""
    return obligations.withColumn("certificate", F.sha2(F.concat("obligation", "witness", "ts"), 256))


def verify(kind: Column, claim: Column, secret: Column, digest: Column) -> Column:
    """A stored proof: a commitment holds until revealed, a reveal must hash to it, an integrity proof to the content;
    an attestation is trusted, and older kinds hold if they have data."""
    return (
        F.when(kind.isin("commitment", "attestation"), True)
        .when(kind == "reveal", digest == F.sha2(F.concat(claim, secret), 256))
        .when(kind == "integrity", digest == F.sha2(claim, 256))
        .otherwise(F.coalesce(F.length(digest) > 0, F.lit(False)))
    )


def key_store(keys: DataFrame) -> DataFrame:
    """(circuit, version, active, previous, fingerprint) out of stored keys (circuit, seq, key): a later key rotates the one before."""
    g = keys.groupBy("circuit").agg(F.count("*").alias("version"), F.max_by("key", "seq").alias("active"), F.get(F.sort_array(F.collect_list(F.struct("seq", "key")), asc=False), F.lit(1))["key"].alias("previous"))
    return g.withColumn("fingerprint", F.sha2("active", 256))


def bundle(rows: DataFrame, asked: str, levels: int | None = None, fan: int = 1000) -> DataFrame:
    """(query_hash, n, rows_hash, proven) of result rows (entity_id, h): one digest over the row hashes in order of entity_id.

    Hashes are joined by ranges of ``fan`` ids, those digests by ranges again, and so on, so no group is larger. Without
    ``levels`` the largest id tells how many it takes; ids are 0 or more.
    """
    if levels is None:
        most = rows.agg(F.max("entity_id")).first()[0] or 0
        levels = 1
        while most >= fan**levels:
            levels += 1
    part = rows.groupBy(F.floor(F.col("entity_id") / fan).alias("b")).agg(_joined("entity_id"), F.count("*").alias("n"), F.bool_and(F.length("h") == 64).alias("proven"))
    for _ in range(1, levels):
        part = part.groupBy(F.floor(F.col("b") / fan).alias("b")).agg(_joined("b"), F.sum("n").alias("n"), F.bool_and("proven").alias("proven"))
    return part.select(F.sha2(F.lit(asked), 256).alias("query_hash"), "n", F.col("h").alias("rows_hash"), "proven")


def _joined(order: str) -> Column:
    """An aggregate: the digest of a group's hashes in order."""
    hs = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "h"))), lambda s: s["h"])
    return F.sha2(F.array_join(hs, ""), 256).alias("h")


def composable(requests: DataFrame, contracts: DataFrame) -> DataFrame:
    """(entity_id, composable): whether every two contracts of a request (entity_id, contracts) are registered and each
    accepts the other's kind; a single contract always composes. contracts: (contract, kind, accepts)."""
    at = requests.select("entity_id", F.posexplode("contracts").alias("i", "contract")).join(bounded(contracts), "contract", "left")
    own = at.groupBy("entity_id").agg(F.collect_list(F.struct("i", "kind", "accepts")).alias("cs"))  # as long as the request's own list
    accept = lambda a, b: F.coalesce(F.array_contains(a["accepts"], b["kind"]), F.lit(False))
    clash = F.exists("cs", lambda a: F.exists("cs", lambda b: (a["i"] < b["i"]) & ~(accept(a, b) & accept(b, a))))
    return own.select("entity_id", (~clash).alias("composable"))
