"""Judging by distinct texts, and tables of short rows dealt to tasks."""

from __future__ import annotations

from claimforge.operators import judges, scoring
from claimforge.plans import catalogue
from claimforge.streaming import legal_fold

SF = "/root/testdata/sf0.001"
SPEC = "A red widget holds the plate. The carrier moves along the rail."


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rows_with_one_text_are_judged_once(spark):
    spec = judges.specification(spark, SPEC)
    rows = [(f"c{i}", i % 3, e) for i in range(200) for e in ("a red widget", "the carrier moves", "", None)]
    elements = spark.createDataFrame(rows, "canonical string, pos int, element string")
    found = judges.judge(elements, spec)
    assert "Aggregate [element" in plan_of(found)
    got = found.select("canonical", "element", "strict.verdict", "recall.verdict", "element_tokens").collect()
    assert len(got) == 800
    assert {(r[1], r[2], r[3]) for r in got} == {("a red widget", "MATCH", "MATCH"), ("the carrier moves", "MATCH", "MATCH"), ("", "UNCLEAR", "UNCLEAR"), (None, "UNCLEAR", "UNCLEAR")}


def test_filters_on_verdicts_do_not_spell_the_judging_out_again(spark):
    records = spark.createDataFrame([("c1", ["1. A thing: a red widget; a carrier that moves; a plain box"])], "canonical string, claims array<string>")
    spec = judges.specification(spark, SPEC)
    fused = judges.fuse(judges.judge(scoring.claim_elements(records), spec))
    plan = plan_of(scoring.proposals(scoring.score(records, spec), fused))
    assert plan.count("exists(") <= 3  # one for each of the three uses of what was judged


def test_tables_of_short_rows_are_dealt_before_the_work(spark):
    for name in ("claim_elements", "normalize_roundtrip", "judge_lenient"):
        assert "RepartitionByExpression" in plan_of(catalogue.queries()[name](spark, SF))


def test_a_number_is_normalised_once_however_often_it_is_named(spark):
    plan = plan_of(catalogue.queries()["normalize_roundtrip"](spark, SF))
    assert plan.count("公開特許公報") <= 2 * plan_of(catalogue.queries()["normalize_numbers"](spark, SF)).count("公開特許公報")


def test_the_legal_fold_makes_no_frame_for_a_right(spark):
    assert not any(name == "pd" for name in vars(legal_fold))
