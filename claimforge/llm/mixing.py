"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import cut

#: Bits of the hash, of a coarse bucket and of a fine one: 4096 coarse buckets, each refined by 4096.
HASH_BITS, COARSE_BITS, FINE_BITS = 48, 12, 12
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *carried: Column) -> DataFrame:
    """Narrow rows: id, source, size in words, and the place of the id on the hash line; and columns to carry along."""
    u = F.shiftrightunsigned(F.xxhash64(F.col(id_col)), 64 - HASH_BITS)
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        u.alias("u"),
        F.shiftright(u, HASH_BITS - COARSE_BITS).alias("coarse"),
        F.shiftright(u, HASH_BITS - COARSE_BITS - FINE_BITS).bitwiseAND(2**FINE_BITS - 1).alias("fine"),
        *carried,
    )


def targets(totals: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row per source, so the unpartitioned windows
    hold as many rows as there are sources, never documents.

    Sorted by the share at which a source reaches its cap, the capped ones come first; each source is capped if what
    the earlier ones leave, shared by weight, would lift it to its cap. The rest share what the capped ones leave.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = totals.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    order = [F.col("most") / F.col("w"), F.col("source").isNull(), F.col("source")]
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = rows.withColumn("most", cap * F.col("source_size"))
    everything = Window.partitionBy()
    rows = rows.withColumn("left", budget * F.sum("source_size").over(everything) - (F.sum("most").over(upto) - F.col("most")))
    rows = rows.withColumn("level", F.col("left") / F.sum("w").over(after))
    rows = rows.withColumn("capped", F.col("level") * F.col("w") >= F.col("most"))
    shared = F.max(F.when(~F.col("capped"), F.struct(-F.col("most") / F.col("w"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.least("most", shared * F.col("w")))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _threshold(sums: DataFrame, bucket: str) -> DataFrame:
    """Per source the first bucket whose running sum reaches ``need``, and the words before it; sums: source, need, bucket, words."""
    upto = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sums.withColumn("upto", F.sum("words").over(upto))
    hit = run.filter(F.col("upto") >= F.col("need"))
    return hit.groupBy("source").agg(
        F.min(bucket).alias(f"{bucket}_at"),
        F.min_by(F.col("upto") - F.col("words"), bucket).alias(f"{bucket}_before"),
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: ``id_col, size, source_size, target, taken``; ``taken`` counts repeats of the text.

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``budget`` times all words; a target
    stops at ``cap`` times its source. A source whose target holds it k times over takes every document k times; the
    rest comes from the documents below a hash threshold. That threshold is found on sums by source and coarse hash
    bucket, then on sums over the fine buckets of the one coarse bucket where the budget ends; only the rows of that
    fine bucket are looked at one by one, and the last document gives just the words still due. No document table is
    sorted, and equal inputs give equal mixes. Null texts have size 0 and take 0; a null source is a source of its own;
    repeated rows count each; an empty table gives an empty result. Other columns are not read.
    """
    rows = cut(sized(docs, id_col, text_col, source_col), "mix-sizes")
    return taken(rows, marks(rows, weights, budget, cap)).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def marks(rows: DataFrame, weights: tuple[float, ...], budget: float, cap: float) -> DataFrame:
    """One row per source: its plan, and the buckets of its ``rows`` where the budget ends."""
    coarse = cut(rows.groupBy("source", "coarse").agg(F.sum("size").alias("words")), "mix-sums")
    plan = targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, cap)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("times", times).withColumn("need", F.round(F.col("target") - F.col("times") * F.col("source_size")).cast("long"))
    plan = cut(plan.coalesce(1), "mix-plan")

    due = plan.filter("need > 0").select(F.col("source").alias("p_source"), "need")
    meets = lambda t: t["source"].eqNullSafe(due["p_source"])
    first = cut(_threshold(coarse.join(due, meets(coarse)).drop("p_source"), "coarse"), "mix-coarse")
    inner = first.join(due, meets(first)).drop("p_source").withColumn("need", F.col("need") - F.col("coarse_before"))
    edge = inner.select(F.col("source").alias("e_source"), "coarse_at", "need")
    border = rows.join(edge, rows["source"].eqNullSafe(edge["e_source"]) & (rows["coarse"] == edge["coarse_at"]))
    fine = border.groupBy("source", "need", "fine").agg(F.sum("size").alias("words"))
    second = cut(_threshold(fine, "fine"), "mix-fine")

    found = plan.join(first.withColumnRenamed("source", "f_source"), F.col("source").eqNullSafe(F.col("f_source")), "left").drop("f_source")
    found = found.join(second.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_source")
    return cut(found.withColumnRenamed("source", "m_source").coalesce(1), "mix-marks")


def taken(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with all their columns and ``source_size, target, taken``."""
    all_rows = rows.join(marks, rows["source"].eqNullSafe(marks["m_source"]))
    on_edge = (F.col("coarse") == F.col("coarse_at")) & (F.col("fine") == F.col("fine_at"))
    below = (F.col("coarse") < F.col("coarse_at")) | ((F.col("coarse") == F.col("coarse_at")) & (F.col("fine") < F.col("fine_at")))
    whole = all_rows.filter(~F.coalesce(on_edge, F.lit(False))).withColumn("extra", F.when(F.coalesce(below, F.lit(False)), F.col("size")).otherwise(0))
    before = F.sum("size").over(Window.partitionBy("source").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    left = F.col("need") - F.col("coarse_before") - F.col("fine_before") - before
    last = all_rows.filter(on_edge).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)))
    return whole.unionByName(last.select(*whole.columns)).withColumn("taken", (F.col("times") * F.col("size") + F.col("extra")).cast("long"))


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    budget: float = 1.5,
    cap: float = 2.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: every row as often as its whole text is taken (a part of half or more counts as one). The rows
    carry their columns through the mix, so a null or repeated id is no matter."""
    planned = marks(cut(sized(docs, id_col, text_col, source_col), "mix-sizes"), weights, budget, cap)
    rows = taken(sized(docs, id_col, text_col, source_col, F.struct(*docs.columns).alias("row")), planned)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rows = rows.withColumn("copies", times).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
