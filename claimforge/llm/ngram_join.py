"""N-gram Jaccard self-join by vertical partitioning: overlaps counted per fragment of the global order and summed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .partners import completion, linked, ordered, prefixes
from .scratch import cut, free
from .skew import salted_join

#: Bits of the map of shingles that occur more than once: 16 MB, whatever the input. A fuller map only prunes less.
MAP_BITS = 27
#: Fragments of the global order.
FRAGMENTS = 4
#: Shingles a task gathers before it sends them on.
CHUNK = 4_000_000


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not len(h):
        return h
    width = min(n, len(h))
    s = np.full(len(h) - width + 1, width, np.uint64)
    for k in range(width):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k]
    s ^= s >> np.uint64(31)
    s *= np.uint64(0xBF58476D1CE4E5B9)
    s ^= s >> np.uint64(29)
    return np.unique(s)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def repeated_map(texts: DataFrame, n: int) -> np.ndarray:
    """Bits, by the top ``MAP_BITS`` of a shingle's hash, set where some shingle occurs in two documents.

    Tasks send what they gathered as packed 32-bit parts by hash range; each range is sorted by itself and sends back
    its piece of the map. Two shingles that agree in range and part count as one, which can only set a bit too many.
    """
    spark = texts.sparkSession
    wide = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    range_bits = min(20, max(7, (2 * wide - 1).bit_length()))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def flush() -> pa.RecordBatch:
            s = np.sort(np.concatenate(held)) if held else np.empty(0, np.uint64)
            s = s[np.r_[True, True, s[2:] != s[:-2]][: len(s)]]  # two of a kind say all
            edges = np.searchsorted(s >> np.uint64(64 - range_bits), np.arange(2**range_bits + 1))
            part = (s >> np.uint64(32 - range_bits)).astype(np.uint32)
            blobs = [part[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
            kept = [k for k, b in enumerate(blobs) if b]
            return pa.RecordBatch.from_pydict({"range": pa.array(kept, pa.int32()), "parts": pa.array([blobs[k] for k in kept], pa.binary())})

        for b in batches:
            for value in b.column(1):
                held.append(shingles(value.as_py(), n))
                count += len(held[-1])
                if count >= CHUNK:
                    yield flush()
                    held, count = [], 0
        yield flush()

    def mark(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        s = np.sort(np.frombuffer(b"".join(rows["parts"]), np.uint32))
        bits = np.zeros(2 ** (MAP_BITS - range_bits), np.uint8)
        bits[s[1:][s[1:] == s[:-1]] >> np.uint32(32 - MAP_BITS + range_bits)] = 1
        return pd.DataFrame({"range": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    found = texts.mapInArrow(gather, "range int, parts binary").groupBy("range").applyInPandas(mark, "range int, bits binary").collect()
    size = 2 ** (MAP_BITS - range_bits) // 8
    out = np.zeros(2**MAP_BITS // 8, np.uint8)
    for r in found:
        out[r["range"] * size : (r["range"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def sets(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """``id, n, digest, tokens`` of each document; tokens only where enough shingles are repeated for a link."""
    held = texts.sparkSession.sparkContext.broadcast(repeated_map(texts, n))  # 2**MAP_BITS bits

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for b in batches:
            sizes, digests, tokens = [], [], []
            for value in b.column(1):
                s = shingles(value.as_py(), n)
                at = s >> np.uint64(64 - MAP_BITS)
                again = int(((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).sum())
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                tokens.append(s.view(np.int64) if len(s) and 100 * again >= percent * len(s) else None)
            columns = [b.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "digest", "tokens"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(read, f"id {kind}, n long, digest binary, tokens array<long>")


def overlap_links(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that link: each fragment's common shingles are counted by themselves, then summed."""
    left = fragments.select(F.col("rep").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("pa"))
    right = fragments.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("pb"))
    met = salted_join(salted_join(pairs, left, ["a"]), right, ["b", "fragment"])
    counted = met.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("common"))
    summed = counted.groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
    return summed.filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _may_link(x: Column, y: Column, percent: int) -> Column:
    """What of each set the other has, if this token is the first that both have, leaves room for a link: at most what
    stands from here on in the order. A pair that links passes at the first token it shares."""
    return (100 + percent) * F.least(x["rest"], y["rest"]) >= percent * (x["n"] + y["n"])


def cut_order(places: DataFrame, count: int) -> DataFrame:
    """``rep, n, fragment, part``: the sets cut vertically into ``count`` fragments of the global order.

    The order is by document frequency, then token; a frequency and the token's place on the line of hashes make one
    number of the two, whose quantiles are the cuts, so ties of the frequency are cut as well."""
    key = F.col("df") + (F.shiftright("token", 11) + F.lit(2.0**52)) / F.lit(2.0**53)
    rows = places.select("rep", "n", "token", key.alias("key"))
    cuts = rows.stat.approxQuantile("key", [k / count for k in range(1, count)], 0.01)
    fragment = sum(((F.col("key") > c).cast("int") for c in cuts), F.lit(0))
    return rows.groupBy("rep", "n", fragment.alias("fragment")).agg(F.collect_list("token").alias("part"))


def class_links(classes: DataFrame, percent: int) -> DataFrame:
    """Links that connect whatever is connected, from ``rep, n, tokens``, one row per distinct set.

    The global order is by document frequency, then hash; two linked sets share a shingle among the first
    ``n - ceil(percent n / 100) + 1`` of either, so these are the posting lists; hubs are the sets whose shingles are
    the most common, as those of the text that the others were made from. What hubs leave apart is completed exactly.
    """
    spread = classes.select("rep", "n", F.col("rep").alias("component"), F.explode("tokens").alias("token"))
    places = cut(ordered(spread, percent), "ngram-places")
    fragments = cut(cut_order(places, FRAGMENTS), "ngram-fragments")
    about = F.struct("n", "rest").alias("about")
    prefix = cut(prefixes(places, percent).select("token", "rep", "core", "n", "rest"), "ngram-prefix")
    free(places)
    verify = lambda pairs: overlap_links(pairs, fragments, percent)
    links, left = linked(prefix.select("token", "rep", "core", about), verify, lambda x, y: _may_link(x, y, percent))
    if left is not None:
        pairs = completion(prefix.join(left, "rep"), percent)
        links = links.unionByName(verify(cut(pairs, "ngram-pairs")))
    return links


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``id_col, n_shingles, component_id``.

    Documents link when the Jaccard similarity of their sets of ``n``-word shingles is at least ``percent`` hundredths;
    ``component_id`` is the smallest id reachable by links. Equal sets are one class from the start, told by a 128-bit
    digest, whatever their ids. Null texts and texts without a word have no shingles and link with nothing. Rows with an
    equal id are documents of their own; rows with a null id keep a null component unless they equal or link with
    others. An empty table gives an empty result. Other columns are not read.
    """
    rows = cut(sets(_texts(docs, id_col, text_col), n, percent), "ngram-sets")
    some = rows.filter("n > 0")
    grouped = some.groupBy("digest", "n").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    grouped = cut(grouped.withColumn("rep", F.monotonically_increasing_id()), "ngram-classes")
    likely = some.filter(F.col("tokens").isNotNull()).select("digest", "n", "tokens").dropDuplicates(["digest", "n"])
    likely = cut(likely.join(grouped, ["digest", "n"]).select("rep", "n", "tokens"), "ngram-likely")
    joined = components(class_links(likely, percent)).withColumnRenamed("id", "rep")
    whole = grouped.join(joined, "rep", "left").withColumn("component", F.coalesce("component_id", "rep")).drop("component_id")
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    fate = cut(whole.join(least, "component").select("digest", "n", F.col("copies").alias("_copies"), "component_id"), "ngram-fate")
    counts = fate.select("digest", F.col("n").alias("_n"), F.col("_copies").alias("n"))
    asked = some.select("id", F.col("n").alias("_n"), "digest")
    out = salted_join(asked, fate.select("digest", F.col("n").alias("_n"), "component_id"), ["digest", "_n"], counts)
    none = rows.filter("n = 0").select("id", F.col("n").alias("_n"), F.col("id").alias("component_id"))
    out = out.select("id", "_n", "component_id").unionByName(none)
    return out.select(F.col("id").alias(id_col), F.col("_n").alias("n_shingles"), "component_id")
