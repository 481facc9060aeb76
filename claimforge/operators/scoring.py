"""Scores and triage of patents from the coverage of their claim elements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import elements, met, squeezed
from .judges import CHANNELS, COVERED, GAP, judge, judge_fused

# Thresholds of the bands, the widest half range, and the triage order.
HIGH, MEDIUM, HALF = 0.70, 0.45, 25.0
BANDS = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")


def claim_elements(records: DataFrame) -> DataFrame:
    """One row per element of each record's first claim: ``canonical, pos, element``."""
    return records.select("canonical", F.posexplode(elements(F.get("claims", F.lit(0)))).alias("pos", "element"))


def compare(records: DataFrame, spec: DataFrame) -> DataFrame:
    """Strict verdicts per element; a record without elements has one unclear placeholder row."""
    rows = judge(claim_elements(records), spec).select("canonical", "pos", "element", "strict.*")
    bare = records.join(met(rows.select("canonical").distinct()), "canonical", "left_anti")
    none = F.lit(None).cast("string")
    return rows.unionByName(bare.select("canonical", F.lit(0).alias("pos"), F.lit("(no claim elements)").alias("element"), F.lit("UNCLEAR").alias("verdict"), none.alias("span"), F.lit(0.0).alias("confidence"), F.lit(True).alias("needs_review")))


def band(gaps: Column, mean: Column) -> Column:
    return F.when((gaps == 0) & (mean >= HIGH), "HIGH").when((gaps <= 1) & (mean >= MEDIUM), "MEDIUM").otherwise("LOW")


def score(records: DataFrame, spec: DataFrame) -> DataFrame:
    """``score_fused`` with both channels of ``judges.judge``."""
    return score_fused(records, judge_fused(claim_elements(records), spec))


def _summed(fused: DataFrame, **more: Column) -> DataFrame:
    return fused.groupBy("canonical").agg(
        F.count(F.lit(1)).alias("n_elements"),
        F.avg("p_coverage").alias("mean"),
        F.min("p_coverage").alias("least"),
        F.avg("confidence").alias("agreement"),
        F.count_if(F.col("p_coverage") < GAP).alias("gap_count"),
        F.count_if("needs_review").alias("review_count"),
        *[c.alias(name) for name, c in more.items()],
    )


def score_fused(records: DataFrame, fused: DataFrame) -> DataFrame:
    """One row per record: coverage in percent with its range, gaps, reviews and risk band; UNKNOWN without elements."""
    return _scored(records.select("canonical").join(met(_summed(fused)), "canonical", "left"))


def _scored(rows: DataFrame, *more: str) -> DataFrame:
    n = F.coalesce("n_elements", F.lit(0))
    half = F.least(F.lit(HALF), HALF * (1 - F.col("agreement")) + F.least("gap_count", "n_elements") / F.col("n_elements") * 5)
    mean = 100 * F.col("mean")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(
        "canonical",
        n.cast("bigint").alias("n_elements"),
        zero(mean).alias("coverage"),
        zero(F.greatest(F.lit(0.0), mean - half)).alias("low"),
        zero(F.least(F.lit(100.0), mean + half)).alias("high"),
        zero(F.col("least")).alias("least"),
        zero(F.col("agreement")).alias("agreement"),
        F.coalesce("gap_count", F.lit(0)).alias("gap_count"),
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.when(n == 0, "UNKNOWN").otherwise(band(F.col("gap_count"), F.col("mean"))).alias("risk_band"),
        *more,
    )


def percent(share: Column) -> Column:
    """A share as whole percent, halves to the even neighbour."""
    return F.concat(F.bround(100 * share, 0).cast("int").cast("string"), F.lit("%"))


def rationale(band: str = "risk_band", n: str = "n_elements", gaps: str = "gap_count") -> Column:
    """Why a record is in its band, from how many elements it has and how many of them the specification lacks."""
    count = lambda c: F.col(c).cast("string")
    return (
        F.when(F.col(n) == 0, "No claim elements are known, so there is no score: get the claims by hand.")
        .when(F.col(band) == "HIGH", F.concat(F.lit("All "), count(n), F.lit(" elements of the independent claim are covered well and none is plainly missing: by the all-elements rule a literal reading is possible. Have it examined.")))
        .when(F.col(band) == "MEDIUM", F.concat(count(gaps), F.lit(" of "), count(n), F.lit(" elements are thin: equivalents and differences of design are to be examined.")))
        .otherwise(F.concat(count(gaps), F.lit(" of "), count(n), F.lit(" elements are plainly missing: by the all-elements rule a literal reading is unlikely.")))
    )


def element_rationale() -> Column:
    """How a fused element came by its coverage: the mean, each channel's share, their agreement, and whether it would be
    covered but for a span to show for it."""
    each = F.concat_ws(", ", *[F.concat(F.lit(f"{name} "), percent(F.col(f"p_{name}"))) for name in sorted(CHANNELS)])
    lowered = F.when((F.col("p_coverage") >= COVERED) & F.col("span").isNull(), "; partial only, as no span shows it").otherwise("")
    return F.concat(F.lit("coverage "), percent(F.col("p_coverage")), F.lit(" ("), each, F.lit("), agreement "), percent(F.col("confidence")), lowered)


def triage_rank(column: str = "risk_band") -> Column:
    out = F.lit(9)
    for k, b in enumerate(BANDS):
        out = F.when(F.col(column) == b, k).otherwise(out)
    return out


def triage(scores: DataFrame) -> DataFrame:
    """Scores in triage order: band, coverage from the highest, canonical number."""
    return scores.orderBy(triage_rank(), F.desc("coverage"), "canonical")


def proposals(scores: DataFrame, fused: DataFrame) -> DataFrame:
    """What to do per record: a header by band, a defence per gap, an interpretation per element to review.

    ``basis`` quotes the specification or is empty.
    """
    weakest = fused.groupBy("canonical").agg(_weakest().alias("weak"))
    head = scores.join(met(weakest), "canonical", "left").select("canonical", *_header())
    rest = fused.filter(_asked()).select("canonical", *_proposal())
    return head.unionByName(rest)


def _weakest(said: str = "element") -> Column:
    return F.min_by(F.struct(said, "span"), F.struct("p_coverage", "pos"))


def _asked() -> Column:
    return (F.col("p_coverage") < GAP) | F.col("needs_review")


def _header(known: str | None = None) -> list[Column]:
    risk = F.col("risk_band")
    return [
        F.lit(-1).alias("pos"),
        F.when(risk == "HIGH", "design_around").when(risk == "MEDIUM", "clarify").when(risk == "LOW", "monitor").otherwise("obtain_claims").alias("category"),
        F.when(risk == "HIGH", F.coalesce("weak.span", F.lit(""))).otherwise("").alias("basis"),
        (squeezed(F.coalesce("weak.element", F.lit("")), 64) if known is None else F.coalesce(known, F.lit(""))).alias("about"),
    ]


def _proposal(known: str | None = None) -> list[Column]:
    gap = F.col("p_coverage") < GAP
    return [
        F.col("pos"),
        F.when(gap, "defence").otherwise("interpretation").alias("category"),
        F.when(gap, "").otherwise(F.coalesce("span", F.lit(""))).alias("basis"),
        (about() if known is None else F.col(known)).alias("about"),
    ]


def about() -> Column:
    """An element as proposals name it."""
    return squeezed(F.col("element"), 64)


def scored_proposals(records: DataFrame, fused: DataFrame) -> DataFrame:
    """``proposals`` with the scores of ``score_fused``, for which the elements are grouped by record once and not once
    for each use; a group is the elements of one claim. ``fused`` has ``about`` too, as ``about()`` makes it.

    Of records with one number the first gets what its elements ask for, so that it is there once; elements of no record
    keep theirs.
    """
    asked = F.collect_list(F.when(_asked(), F.struct(*_proposal("about"))))
    summed = _summed(fused, weak=_weakest("about"), asked=asked)
    rows = records.select("canonical", F.lit(True).alias("known")).join(met(summed), "canonical", "full")
    again = F.row_number().over(Window.partitionBy("canonical", F.col("asked").isNull()).orderBy("canonical")) > 1
    rows = _scored(rows.withColumn("again", again), "known", "again", "weak", "asked")
    none = F.array().cast("array<struct<pos:int,category:string,basis:string,about:string>>")
    head = F.when(F.col("known"), F.array(F.struct(*_header("weak.about")))).otherwise(none)
    rest = F.when(F.col("asked").isNull() | F.col("again"), none).otherwise(F.col("asked"))
    return rows.select("canonical", F.inline(F.concat(head, rest)))


def weakest_element(fused: DataFrame) -> DataFrame:
    """The element with the least coverage of each record, the first of equals."""
    least = Window.partitionBy("canonical").orderBy("p_coverage", "pos")
    return fused.withColumn("_k", F.row_number().over(least)).filter("_k = 1").drop("_k")
