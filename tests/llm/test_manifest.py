"""The manifest against trees built whole, and its traversal against the tree's own nodes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from claimforge.llm import manifest, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r: tuple, text: str | None) -> str:
    return H(*map(field, (r[0], r[3], r[2], r[4], text)))


def tree(nodes: list[str]) -> tuple[str, list[list[tuple[list[str], list[str]]]]]:
    """The top, and of each node its siblings left and right, level by level."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for path, i in zip(paths, own, strict=True):
            run, at = runs[i // 8], i % 8
            path.append((run[:at], run[at + 1 :]))
        nodes, own = [H(*r) for r in runs], [i // 8 for i in own]
    return nodes[0], paths


def brute(rows: list[tuple]) -> list[tuple]:
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order]
    root, upper = tree([t[0] for t in trees])
    out = []
    for g, (sub, paths), above in zip(order, trees, upper, strict=True):
        for (_, _, own, r), path in zip(sorted(groups[g], key=lambda x: x[:3]), paths, strict=True):
            path = path + above
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                node = leaf(r, "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for a, b in path:
                node = H(*a, node, *b)
            out.append((r[0], own, sub, root, H(*[x for a, b in path for x in a + b]), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 63, 64, 65, 100, 511, 513, 700])
@pytest.mark.parametrize("stratum", [1, 2, 3])
def test_traversal(n, stratum):
    leaves = [H(str(i)) for i in range(n)]
    top, paths = tree(leaves)
    coded = [x.encode() for x in leaves]
    levels = manifest.depth(n, 4)
    assert manifest.block_root(coded, levels) == top.encode()
    want = [[("".join(a).encode(), "".join(b).encode()) for a, b in p] for p in paths]
    assert list(manifest.block_paths(coded, levels, stratum)) == want


def corpus(n: int, langs: list) -> list[tuple]:
    rng = random.Random(n)
    rows = [(i if i % 11 else None, f"Text É {i // 2} of Many" * rng.randrange(3), rng.choice(langs), rng.choice(["s", None, ""]), rng.choice([i, None])) for i in range(n)]
    return rows + [(3, None, langs[0], "s", 0), (3, "", langs[0], None, None)] + rows[:3]


def got(out) -> list[tuple]:
    return sorted((tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def lowered():
    F = manifest.F
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", queries.UPPER, queries.LOWER))


@pytest.mark.parametrize("n, langs, levels", [(0, ["en"], 4), (300, ["en", None, "", "é", "n", "s"], 4), (700, ["en", "en", "en", "de"], 1), (900, ["en"], 2), (90, [f"l{i}" for i in range(70)], 1)])
def test_agrees_with_whole_trees(spark, n, langs, levels):
    """Blocks of eight and of 64 leaves make trees of many blocks."""
    rows = corpus(n, langs)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(manifest.manifest(table, lowered(), levels=levels)) == brute(rows)


def test_proofs_lead_to_the_root(spark):
    rows = corpus(40, ["en", "de"])
    out = manifest.proofs(spark.createDataFrame(rows, SCHEMA)).withColumn("to", manifest.folded(manifest.F.col("leaf")))
    assert {r["to"] == r["root"] for r in out.collect()} == {True}
    plain = manifest.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(r["verified"] for r in plain) and len(plain) == len(rows)


def test_one_row_and_no_row(spark):
    assert got(manifest.manifest(spark.createDataFrame([(5, "A", None, "s", 1)], SCHEMA), lowered())) == brute([(5, "A", None, "s", 1)])
    assert manifest.manifest(spark.createDataFrame([], SCHEMA), lowered()).count() == 0


def test_awkward_columns(spark):
    rows = corpus(30, ["en", None])
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: manifest.F.lit("x") for c in ("tree", "id", "leaf", "pos", "n", "block", "path", "root", "other", "_tie", "_at")})
    assert got(manifest.manifest(table, lowered())) == brute(rows)


def test_equal_rows_are_dealt_to_many_parts(spark):
    rows = spark.createDataFrame([("a", 1)] * 5000 + [("b", k) for k in range(200)], "g string, k int")
    rows = manifest.cut(rows, "test-rows")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    out = manifest.placed(rows, "g", ["k"], "test-placed").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(r["pos"] for r in out if r["g"] == "a") == list(range(5000)) and {r["n"] for r in out if r["g"] == "a"} == {5000}
    assert [r["pos"] for r in sorted((r for r in out if r["g"] == "b"), key=lambda r: r["k"])] == list(range(200))


def test_query_over_the_driver_tables(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert got(queries.op13_manifest(spark, sf_dir)) == brute(rows)
