"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import cut

#: Rows to a cluster; sampled rows to a centroid; how much less similar than the nearest centroid another may be for a
#: row to join its shard as well (the two nearest always take it); clusters to a shard at most, before it is split.
CLUSTER, SAMPLED, MARGIN, MOST = 1200, 8, 0.1, 4
#: Centroids fitted at once: more are fitted within the clusters of a coarser fit.
AT_ONCE = 128
#: The graph: candidates a node is given, neighbours it keeps, and how much nearer a kept one must be to shadow another.
CANDIDATES, DEGREE, ALPHA = 48, 16, 1.2
#: Search goes on through nodes that miss the threshold by no more than this.
SLACK = 0.03


def _unit(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x


def centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means from rows taken at even steps; centroids much alike are merged, so a dense group has one."""
    if k > AT_ONCE:
        own = (x @ centroids(x, AT_ONCE // 2, rounds).T).argmax(axis=1)
        return np.concatenate([centroids(x[own == j], min(int(n), -(-k * int(n) // len(x))), rounds) for j, n in enumerate(np.bincount(own)) if 0 < n < len(x)] or [centroids(x, AT_ONCE, rounds)])
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    kept: list[np.ndarray] = []
    for v in c:
        if not kept or (np.array(kept) @ v).max() < 0.95:
            kept.append(v)
    return np.array(kept)


def neighbours(x: np.ndarray) -> np.ndarray:
    """Adjacency (-1: none) by robust pruning of each node's most similar candidates: the nearest is kept, and takes out
    those which it is nearer to, by ``ALPHA``, than the node is. The caller adds the way back to every edge."""
    n, width = len(x), min(CANDIDATES, len(x) - 1)
    out = np.full((n, DEGREE), -1, np.int64)
    if width < 1:
        return out
    for at in range(0, n, 1024):
        sims = x[at : at + 1024] @ x.T
        rows = np.arange(len(sims))
        sims[rows, at + rows] = -2
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable"), 1)
        far = 1 - np.take_along_axis(sims, near, 1)
        there, alive = x[near], np.ones(near.shape, bool)
        for r in range(DEGREE):
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            chosen = near[rows, pick]
            out[at + rows[some], r] = chosen[some]
            between = 1 - np.einsum("qld,qd->ql", there, x[chosen])
            alive &= ~((ALPHA * between <= far) & some[:, None])
            alive[rows, pick] = False
    return out


def both_ways(out: np.ndarray) -> list[np.ndarray]:
    """Neighbour lists of the graph with every edge's way back."""
    u, k = np.nonzero(out >= 0)
    v = out[u, k]
    edges = np.unique(np.r_[u * len(out) + v, v * len(out) + u])
    return np.split(edges % max(len(out), 1), np.searchsorted(edges // max(len(out), 1), np.arange(1, len(out))))


def search(x: np.ndarray, lists: list[np.ndarray], threshold: float, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Pairs at or above the threshold found on the graph, their cosines, and the share of greedy walks that arrived.

    Every node is a query. It walks greedily from the medoid; then the search expands from where it got to (from the
    node itself where the walk ended out of range) to all neighbours in range, and theirs, until none is new.
    """
    n, arrived = len(x), 0
    medoid = int((x @ x.mean(axis=0)).argmax())
    lists = [np.r_[i, a].astype(np.int64) for i, a in enumerate(lists)]
    degree = np.array([len(a) for a in lists])
    start, flat = np.cumsum(degree) - degree, np.concatenate(lists)

    def around(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``nodes`` and neighbour (itself first) of each edge out of them."""
        d = degree[nodes]
        return np.repeat(np.arange(len(nodes)), d), flat[np.repeat(start[nodes] - np.cumsum(d) + d, d) + np.arange(d.sum())]

    def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.einsum("pd,pd->p", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, max(len(a), 1), 65536)])

    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, n, block):
        q = np.arange(at, min(at + block, n))
        here, best = np.full(len(q), medoid), x[q] @ x[medoid]
        walking = np.arange(len(q))
        while len(walking):
            place, step = around(here[walking])
            sims = cosines(q[walking][place], step)
            first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            top = np.maximum.reduceat(sims, first)
            at_top = np.flatnonzero(sims == top[place])
            to = step[at_top[np.unique(place[at_top], return_index=True)[1]]]
            on = top > best[walking] + 1e-12
            walking = walking[on]
            here[walking], best[walking] = to[on], top[on]
        arrived += int((best >= threshold).sum())
        here = np.where(best >= threshold, here, q)
        seen = np.zeros(len(q) * n, bool)
        keys = np.unique(np.r_[np.arange(len(q)) * n + here, np.arange(len(q)) * n + q])
        while len(keys):
            seen[keys] = True
            row, node = keys // n, keys % n
            sims = cosines(q[row], node)
            hit = (sims >= threshold) & (q[row] < node)
            found.append((q[row[hit]], node[hit], sims[hit]))
            go = sims >= threshold - SLACK
            place, node = around(node[go])
            keys = np.unique(row[go][place] * n + node)
            keys = keys[~seen[keys]]
    a, b, s = (np.concatenate(c) for c in zip(*found, strict=True))
    return a, b, s, arrived / n


def _shards(classes: DataFrame, cluster: int) -> DataFrame:
    """The classes, each in every shard that its similarity to the centroids puts it in; ``pair`` tells the sub-shards of
    a shard over ``MOST`` clusters.

    A crowded label is sampled by a hash threshold that follows from its count, fitted in one task, and has a centroid
    for every ``cluster`` rows, so the centroids held are a row in ``cluster``. A shard that stays too large, as of a
    dense group, is dealt into parts by hash, and there is a sub-shard for every two parts: no pair is out of reach.
    """
    by = ["label", "dim"]
    crowded = classes.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 2 * cluster)
    place = F.pmod(F.xxhash64(F.lit("sample"), "rep"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = SAMPLED * F.ceil(F.col("rows") / cluster)
    sample = classes.join(crowded, by).filter(place < wanted / F.col("rows"))

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", kind="stable")
        x = _unit(part["vec"])
        found = centroids(x, min(len(x), -(-int(part["rows"].iloc[0]) // cluster)))
        return pd.DataFrame({"crowd": part["crowd"].iloc[0], "centre": list(found)})

    crowd = F.xxhash64(*by).alias("crowd")
    fits = sample.select(crowd, "rows", "rep", "vec").groupBy("crowd").applyInPandas(fit, "crowd long, centre array<double>")
    fitted = {k: np.array(part["centre"].tolist()) for k, part in fits.toPandas().groupby("crowd")}
    held = classes.sparkSession.sparkContext.broadcast(fitted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = b.to_pandas()
            shards: list = [[0]] * len(t)
            for key, at in t.groupby("crowd").indices.items():
                c = held.value.get(key)
                if c is None:
                    continue
                for some in np.split(at, range(256, len(at), 256)):
                    sims = _unit(t["vec"].iloc[some]) @ c.T
                    near = np.sort(sims, axis=1)[:, ::-1]
                    bound = np.minimum(near[:, 0] - MARGIN, near[:, min(1, len(c) - 1)])
                    for i, row in zip(some, sims >= bound[:, None], strict=True):
                        shards[i] = np.flatnonzero(row).tolist()
            at = pa.array(np.repeat(np.arange(len(t)), [len(k) for k in shards]))
            out = b.take(at)
            yield pa.RecordBatch.from_arrays([*(out.column(n) for n in names), pa.array([k for ks in shards for k in ks], pa.int32())], [*names, "shard"])

    names = ["label", "dim", "rep", "vec"]
    types = dict(classes.select(*names).dtypes)
    schema = ", ".join(f"{n} {types[n]}" for n in names) + ", shard int"
    dealt = cut(classes.select(*names, crowd).mapInArrow(assign, schema), "vectors-dealt")
    by.append("shard")
    sizes = dealt.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > MOST * cluster)
    parts = F.ceil(F.col("rows") / (MOST * cluster / 2.0)).cast("int").alias("parts")
    split = dealt.join(F.broadcast(sizes.select(*by, parts)), by, "left")
    part = F.pmod(F.xxhash64(F.lit("part"), "rep"), F.col("parts")).cast("int")
    other = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, part) * F.col("parts") + F.greatest(o, part))
    # a part alone is within each of its sub-shards with another part
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(other, lambda p: p != part * F.col("parts") + part))
    return split.select(*names, "shard", F.explode(pairs).alias("pair"))


def _classes(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, *sums: Column) -> tuple[DataFrame, DataFrame]:
    """``id, key`` of every row, the key null where it links with nothing, and ``key, rep, members, label, vec, dim`` of
    equal vectors, with other ``sums`` over their rows."""
    sound = F.coalesce(F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vec_col, lambda x: x != 0), F.lit(False))
    vec = F.transform(vec_col, lambda x: x.cast("double") + F.lit(0.0))
    rows = vectors.select(F.col(id_col).alias("id"), F.when(sound & F.col(label_col).isNotNull(), F.struct(F.col(label_col).alias("label"), vec.alias("vec"))).alias("key"))
    classes = rows.filter(F.col("key").isNotNull()).groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members"), *sums)
    return rows, classes.select("key", "rep", "members", "key.label", "key.vec", F.size("key.vec").alias("dim"), *[c for c in classes.columns[3:]])


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.98,
    cluster: int = CLUSTER,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row per row: ``id_col, n_links, component_id, kept``.

    Rows are compared with rows of the same label and length. Equal vectors are one class, compared once; a link of two
    classes counts for all their members, and members of a class link with each other. Rows whose label or vector is
    null, and vectors that are empty, zero or hold a null or non-finite number, link with nothing. Every pair reported
    has its cosine in double precision at or above the threshold; which pairs are found depends on the search (see
    ``audit``). Rows with an equal id are rows of their own with one id. An empty table gives an empty result.
    """
    rows, classes = _classes(vectors, id_col, vec_col, label_col)
    usable = rows.filter(F.col("key").isNotNull())
    classes = cut(classes, "vectors-classes")
    pairs = cut(links(classes, threshold, cluster), "vectors-links")

    size = classes.select("rep", "members")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(size.withColumnRenamed("rep", "b"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("members").alias("others"))
    found = components(pairs)
    whole = classes.join(others, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key",
        (F.coalesce("others", F.lit(0)) + F.col("members") - 1).cast("long").alias("n_links"),
        F.coalesce("component_id", "rep").alias("component_id"),
    )
    linked = usable.join(whole, "key").select("id", "n_links", "component_id")
    alone = rows.filter(F.col("key").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def links(classes: DataFrame, threshold: float, cluster: int = CLUSTER) -> DataFrame:
    """Distinct pairs ``a < b`` of class representatives at or above the threshold; classes: ``rep, label, dim, vec``."""
    shards = cut(_shards(classes, cluster), "vectors-shards")
    rep = classes.schema["rep"].dataType.simpleString()

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", kind="stable")
        ids, lists = part["rep"].to_numpy(), both_ways(neighbours(_unit(part["vec"])))
        return pd.DataFrame({"rep": ids, "near": [ids[a].tolist() for a in lists]})

    lists = shards.groupBy("label", "dim", "shard", "pair").applyInPandas(build, f"rep {rep}, near array<{rep}>")
    union = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rep", kind="stable")
        ids, x = part["rep"].to_numpy(), _unit(part["vec"])
        lists = [np.searchsorted(ids, here) for near in part["near"] for here in [np.intersect1d(near, ids)]]
        a, b, s, _ = search(x, lists, threshold)
        return pd.DataFrame({"a": ids[a], "b": ids[b], "cosine": s})

    walked = shards.join(union, "rep").groupBy("label", "dim", "shard", "pair").applyInPandas(walk, f"a {rep}, b {rep}, cosine double")
    return walked.groupBy("a", "b").agg(F.max("cosine").alias("cosine")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine").distinct()


def recall(vectors: pd.DataFrame, result: pd.DataFrame, threshold: float = 0.98, every: int = 50) -> float:
    """Audit: links that the result counts for the rows with an id divisible by ``every``, over those that comparing
    them with all rows finds. For tables that fit the driver."""
    sound = vectors[vectors["label"].notna() & vectors["embedding"].notna()]
    x, got, want = _unit(sound["embedding"]), 0, 0
    n = dict(zip(result["vec_id"], result["n_links"], strict=True))
    labels = sound["label"].to_numpy()
    for i in np.flatnonzero(sound["vec_id"].to_numpy() % every == 0):
        want += int(((x[labels == labels[i]] @ x[i]) >= threshold).sum()) - 1
        got += n[sound["vec_id"].iloc[i]]
    return got / want if want else 1.0


def audit(
    vectors: DataFrame,
    result: DataFrame,
    threshold: float = 0.98,
    every: int = 50,
    block: int = 10_000,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """One row: ``asked, wanted, found, recall``. The rows with an id divisible by ``every`` are compared with all rows
    of their label, block by block, and the links so ``wanted`` with those that ``result`` counts. No link is reported
    below the threshold, so the share of the counts is the recall. An asked row that links with nothing counts too."""
    asks = F.col("id") % every == 0
    _, classes = _classes(vectors, id_col, vec_col, label_col, F.count_if(asks).alias("asks"))
    classes = cut(classes.drop("key"), "audit-classes")
    blocks = lambda of, name: F.ceil(F.count_if(of) / F.lit(float(block))).cast("int").alias(name)
    counts = classes.groupBy("label", "dim").agg(blocks(F.lit(True), "all_blocks"), blocks(F.col("asks") > 0, "asked_blocks"))
    dealt = classes.join(F.broadcast(counts.filter("asked_blocks > 0")), ["label", "dim"])
    own = lambda n: F.pmod(F.xxhash64(F.lit("audit"), "rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    by = ["label", "dim", "part", "asked_part"]
    asked = dealt.filter("asks > 0").withColumn("asked_part", own("asked_blocks")).withColumn("part", each("all_blocks"))
    asked = cut(asked.select(*by, "asks", "vec"), "audit-asked")
    everything = dealt.withColumn("part", own("all_blocks")).withColumn("asked_part", each("asked_blocks")).select(*by, "members", "vec")

    def compare(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y, n = _unit(a["vec"]), _unit(b["vec"]), 0
        for at in range(0, len(x) if len(y) else 0, 512):
            n += int((((x[at : at + 512] @ y.T) >= threshold) @ b["members"].to_numpy() * a["asks"].to_numpy()[at : at + 512]).sum())
        return pd.DataFrame({"links": [n]})

    met = asked.groupBy(*by).cogroup(everything.groupBy(*by)).applyInPandas(compare, "links long")
    own_links = classes.agg(F.coalesce(F.sum("asks"), F.lit(0)).alias("own"))  # each asked row met itself
    wanted = met.agg(F.coalesce(F.sum("links"), F.lit(0)).alias("links")).crossJoin(own_links).select((F.col("links") - F.col("own")).alias("wanted"))
    found = result.filter(F.col(id_col) % every == 0).agg(F.count(F.lit(1)).alias("asked"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("found"))
    share = F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(1.0)
    return found.crossJoin(wanted).select("asked", "wanted", "found", share.alias("recall"))
