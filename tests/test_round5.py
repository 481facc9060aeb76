"""Joins of rows by their keys, proposals from one grouping, chart lines by text, weights of a table in one pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.llm import packing
from claimforge.operators import judges, scoring
from claimforge.plans import catalogue
from claimforge.render import pages

SF = "/root/testdata/sf0.001"
SPEC = "A red widget holds the plate. The carrier moves along the rail."


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def rows_of(df) -> list:
    return sorted(map(str, df.collect()))


def test_rows_of_a_small_file_are_never_sent_whole_to_the_driver(spark):
    for name in ("band_banner", "score_rationale", "fuse_channels", "proposals", "weakest_element"):
        assert "BroadcastHashJoin" not in planned(catalogue.queries()[name](spark, SF)), name


def _judged(spark):
    rows = [("a", ["1. A thing: a red widget; a carrier that moves; a plain box"]), ("a", ["1. Twice: a red plate"]), ("b", None), (None, ["a red widget holds"]), ("c", ["1. X: a red widget; the carrier moves along"])]
    records = spark.createDataFrame(rows, "canonical string, claims array<string>")
    elements = scoring.claim_elements(records).unionByName(spark.createDataFrame([("of none", 0, "a plain box")], "canonical string, pos int, element string"))
    return records, judges.judge_fused(elements, judges.specification(spark, SPEC), about=scoring.about(), line=pages.chart_line())


def test_proposals_of_one_grouping_are_those_of_scores_and_elements(spark):
    records, fused = _judged(spark)
    apart = scoring.proposals(scoring.score_fused(records, fused), fused)
    together = scoring.scored_proposals(records, fused)
    assert rows_of(together) == rows_of(apart)
    assert planned(together).count("Generate posexplode") < planned(apart).count("Generate posexplode")


def test_lines_made_by_text_are_those_of_the_rows(spark):
    _, fused = _judged(spark)
    assert rows_of(pages.chart(fused)) == rows_of(pages.chart(fused.drop("line")))


def test_stems_are_held_against_all_of_a_specification_at_once(spark):
    spec = judges.specification(spark, "carrier housing ab abc widgets")
    own = spark.createDataFrame([("carriers subhousing abcd hous abx widgetry c.r arri",), (None,)], "t string").select(F.split("t", " ").alias("t"))
    found = own.crossJoin(spec).select(judges.lenient_matches(F.col("t"), F.col("spec_stems"), F.col("spec_near")).alias("m"))
    assert {tuple(r.m) if r.m is not None else None for r in found.collect()} == {("carriers", "subhousing", "widgetry", "arri"), None}
    none = own.crossJoin(judges.specification(spark, "ab")).select(judges.lenient_matches(F.col("t"), F.col("spec_stems"), F.col("spec_near")).alias("m"))
    assert [r.m for r in none.collect() if r.m is not None] == [[]]


def test_words_stay_remembered_beyond_three_million_characters():
    own = packing.Encoder(None)
    own.known, own.held = {" seen": b"...."}, 4_000_000
    assert own.encode(" seen") == b"...." and own.encode(" unseen") == own._encoded([" unseen"])[0]
    assert " seen" in own.known
