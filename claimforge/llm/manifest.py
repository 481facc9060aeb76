"""A Merkle manifest of a table: leaves of rows, trees of groups, one root, and each row's proof by fractal traversal."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut, free
from .skew import salted_join

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run; levels of the tree over an aligned block (8**4 leaves); levels of a subtree that is stacked there.
RUN, LEVELS, STRATUM = 8, 4, 2
_BITS = 33  # of monotonically_increasing_id, for the place in a partition


def digest(fields: list[Column]) -> Column:
    """The leaf of a row: SHA-256 of its fields, each as length in bytes, colon and value, or ``-`` for null."""
    said = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*said), 256)


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, their place from 0 in the order of their group, and ``n``, the rows of the group.

    One sort over ranges of group and order, so that a group of any size is dealt to many tasks, equal rows too; then
    the parts of each range by group are counted, and places are the sums before a part plus the place within it. ``rows``
    is a written table.
    """
    by = [group, *order, "_tie"]
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    table = cut(ranged.withColumn("_at", F.monotonically_increasing_id()), name).withColumn("_part", F.shiftright("_at", _BITS))
    parts = table.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per part
    parts = parts.withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).withColumn("n", F.sum("_n").over(Window.partitionBy(group)))
    found = table.join(parts.drop("_n"), [group, "_part"]).withColumn("pos", F.expr("_before + _at - _first"))
    return found.drop("_at", "_part", "_first", "_before")


class Climb:
    """Nodes of the levels ``low`` to ``high`` of a tree over leaves that come left to right, as hex texts; only runs
    that aren't full yet and the levels from ``low`` to below ``high`` are held."""

    def __init__(self, low: int, high: int):
        self.low, self.high, self.top = low, high, None
        self.open: list[list[bytes]] = [[] for _ in range(high)]
        self.kept: list[list[bytes]] = [[] for _ in range(high - low)]

    def feed(self, node: bytes, level: int = 0) -> None:
        while level < self.high:
            if level >= self.low:
                self.kept[level - self.low].append(node)
            run = self.open[level]
            run.append(node)
            if len(run) < RUN:
                return
            node = sha256(b"".join(run)).hexdigest().encode()
            run.clear()
            level += 1
        self.top = node

    def close(self) -> None:
        """No more leaves: what is open becomes nodes, runs of one too."""
        for level, run in enumerate(self.open):
            if run:
                node = sha256(b"".join(run)).hexdigest().encode()
                run.clear()
                self.feed(node, level + 1)


def depth(n: int, levels: int) -> int:
    """Levels of the tree of ``n`` leaves that lie within a block of ``RUN ** levels``."""
    found = 0
    while found < levels and RUN**found < n:
        found += 1
    return found


def block_root(leaves: list[bytes], levels: int) -> bytes:
    climb = Climb(levels, levels)
    for leaf in leaves:
        climb.feed(leaf)
    climb.close()
    return climb.top


def block_paths(leaves: list[bytes], levels: int, stratum: int = STRATUM) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf in turn, its siblings level by level: those to the left and those to the right, each concatenated.

    The levels are cut into strata. Of each there is one existing subtree, which the present leaf lies under and which
    gives its siblings there, and, below the highest, one desired subtree: the next to the right, which takes one leaf
    with every path given and so is ready when the existing one is used up. So a path costs a few hashes, and besides
    the block's leaves only two subtrees of ``RUN ** stratum`` nodes a stratum are held.
    """
    strata = [(low, min(low + stratum, levels)) for low in range(0, levels, stratum)]

    def built(low: int, high: int, first: int) -> Climb:
        out = Climb(low, high)
        for leaf in leaves[first : first + RUN**high]:
            out.feed(leaf)
        out.close()
        return out

    existing = [built(low, high, 0) for low, high in strata]
    desired = [Climb(low, high) for low, high in strata]
    path: list[tuple[bytes, bytes]] = [(b"", b"")] * levels
    for i in range(len(leaves)):
        for s, (low, high) in enumerate(strata):
            size = RUN**high
            if i and i % size == 0:
                desired[s].close()
                existing[s], desired[s] = desired[s], Climb(low, high)
            if i + size < len(leaves):
                desired[s].feed(leaves[i + size])
            for level in range(low, high):
                if i % RUN**level:
                    break  # a node of this level has the siblings that the leaf before had, and so above
                place = i // RUN**level
                at = place - i // size * RUN ** (high - level)
                start = at - place % RUN
                run = existing[s].kept[level - low]
                path[level] = (b"".join(run[start:at]), b"".join(run[at + 1 : start + RUN]))
        yield list(path)


PATH = "array<struct<`left`: string, `right`: string>>"


def upper_paths(nodes: DataFrame) -> DataFrame:
    """``tree, idx, path, top`` for ``tree, idx, node``, the nodes of one level: siblings above, up to the tree's top.

    Levels are made one by one, eight nodes to a row, each a written table an eighth of the one below; then paths go
    down the same way, by joins of a node with its parent.
    """
    level, runs, tops = nodes, [], []
    while True:
        counted = cut(level.join(level.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "tree"), "merkle-level")
        tops.append(counted.filter("n = 1").select("tree", "idx", F.array().cast(PATH).alias("path"), F.col("node").alias("top")))
        more = counted.filter("n > 1")
        if more.isEmpty():
            break
        own = F.array_sort(F.collect_list(F.struct("idx", "node")))
        joined = more.groupBy("tree", F.expr(f"idx div {RUN}").alias("up")).agg(own.alias("own"))
        runs.append(cut(joined.withColumn("node", F.sha2(F.array_join("own.node", ""), 256)), "merkle-runs"))
        level = runs[-1].select("tree", F.col("up").alias("idx"), "node")
    paths = tops.pop()
    while runs:
        down = runs.pop().select("tree", F.col("up").alias("idx"), "own").join(paths, ["tree", "idx"])
        down = down.select("tree", "own", "path", "top", F.posexplode("own").alias("at", "me"))
        side = lambda start, size: F.array_join(F.slice("own.node", start, size), "")
        step = F.struct(side(F.lit(1), F.col("at")).alias("left"), side(F.col("at") + 2, F.lit(RUN)).alias("right"))
        paths = down.select("tree", F.col("me.idx").alias("idx"), F.concat(F.array(step), "path").alias("path"), "top")
        paths = cut(paths.unionByName(tops.pop()), "merkle-paths")
    return paths


def proofs(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group_col: str = "lang",
    id_col: str = "doc_id",
    carried: dict[str, Column] | None = None,
    levels: int = LEVELS,
) -> DataFrame:
    """One row per row: ``id_col, leaf, path, subroot, root`` and the columns ``carried`` (name: expression).

    ``leaf`` is the digest of ``fields``. The leaves of a value of ``group_col`` in the order of ``id_col`` (null first,
    then by digest; equal rows in any order, which changes nothing) are joined by eights, level by level, the last run
    of a level being what is left, down to one; a node is the SHA-256 of its run's hex digests. What remains is the
    group's ``subroot``, and the subroots in the order of the group's value (null first, then by UTF-8 bytes) give
    ``root`` in the same way. ``path`` has, from the leaf's level to the root's, the siblings to the left and to the
    right. The lowest ``levels`` levels are those of blocks, each of which one task goes through. Texts are read whole,
    once. Rows that repeat or share an id are leaves each; an empty table gives an empty
    result. Other columns are not read.
    """
    tree = F.coalesce(F.concat(F.lit("s"), F.col(group_col).cast("string")), F.lit("n"))
    extra = [c.alias(f"c_{name}") for name, c in (carried or {}).items()]
    leaves = cut(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), F.unhex(digest([F.col(c) for c in fields])).alias("leaf"), *extra), "merkle-leaves")
    size = RUN**levels
    rows = cut(placed(leaves, "tree", ["id", "leaf"], "merkle-sorted").withColumn("block", F.expr(f"pos div {size}")), "merkle-rows")
    free(leaves)

    def root(key: tuple, own: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        node = block_root([x.hex().encode() for x in own["leaf"].to_pylist()], depth(own["n"][0].as_py(), levels))
        return pa.table({"tree": [key[0].as_py()], "idx": [key[1].as_py()], "node": [node.decode()]})

    blocks = rows.select("tree", "block", "pos", "n", "leaf").groupBy("tree", "block").applyInArrow(root, "tree string, idx long, node string")
    upper = upper_paths(cut(blocks, "merkle-blocks")).withColumnRenamed("top", "subroot")
    trees = cut(upper.select("tree", "subroot").distinct().withColumn("all", F.lit("")), "merkle-trees")
    ordered = cut(placed(trees, "all", ["tree"], "merkle-order"), "merkle-ordered")
    above = upper_paths(ordered.select(F.col("all").alias("tree"), F.col("pos").alias("idx"), F.col("subroot").alias("node")))
    above = ordered.select("tree", "pos").join(above.select(F.col("idx").alias("pos"), F.col("path").alias("above"), F.col("top").alias("root")), "pos").drop("pos")
    upper = salted_join(upper, above, ["tree"])
    upper = upper.select(F.col("tree").alias("of_tree"), F.col("idx").alias("of_block"), F.concat("path", "above").alias("path"), "subroot", "root")

    names = [c for c in rows.columns if c.startswith("c_")]
    step = pa.struct([("left", pa.string()), ("right", pa.string())])

    def prove(own: pa.Table, upper: pa.Table) -> pa.Table:
        own = own.sort_by("pos")
        leaves = [x.hex() for x in own["leaf"].to_pylist()]
        higher = [(p["left"], p["right"]) for p in upper["path"][0].as_py()]
        paths = [[(a.decode(), b.decode()) for a, b in p] + higher for p in block_paths([x.encode() for x in leaves], depth(own["n"][0].as_py(), levels))]
        lefts = pa.array([a for p in paths for a, _ in p], pa.string())
        rights = pa.array([b for p in paths for _, b in p], pa.string())
        steps = pa.StructArray.from_arrays([lefts, rights], fields=list(step))
        long = len(paths[0])
        found = {"id": own["id"], "leaf": pa.array(leaves), "path": pa.ListArray.from_arrays(pa.array(range(0, len(paths) * long + 1, long) if long else [0] * (len(paths) + 1), pa.int32()), steps)}
        found |= {c: pa.array([upper[c][0].as_py()] * len(paths), pa.string()) for c in ("subroot", "root")}
        return pa.table(found | {c: own[c] for c in names})

    kind = lambda c: rows.schema[c].dataType.simpleString()
    schema = f"id {kind('id')}, leaf string, path {PATH}, subroot string, root string" + "".join(f", `{c}` {kind(c)}" for c in names)
    kept = rows.select("tree", "block", "pos", "n", "id", "leaf", *names)
    out = kept.groupBy("tree", "block").cogroup(upper.groupBy("of_tree", "of_block")).applyInArrow(prove, schema)
    return out.select(F.col("id").alias(id_col), "leaf", "path", "subroot", "root", *[F.col(c).alias(c[2:]) for c in names])


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    fields: tuple[str, ...] = FIELDS,
    group_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    levels: int = LEVELS,
) -> DataFrame:
    """``id_col, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row; see ``proofs``.

    ``proof_sha256`` digests the siblings in order. ``tampered`` is the text as another copy of the row has it, null
    where it has the same: then ``folded_root`` is what that row's leaf and the original siblings lead to, and
    ``verified`` tells whether that is the root.
    """
    other = F.lit(None).cast("string") if tampered is None else tampered
    leaf = F.when(other.isNotNull(), F.unhex(digest([other if c == text_col else F.col(c) for c in fields])))
    rows = proofs(docs, fields, group_col, id_col, {"other": leaf}, levels)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    root = folded(F.coalesce(F.lower(F.hex("other")), "leaf"))
    rows = rows.select(id_col, "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), root.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
