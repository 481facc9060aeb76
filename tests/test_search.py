"""Evidence of ranks, report tables and text kernels on small rows."""

import pytest
from claimforge.functions import text as T
from claimforge.operators import search
from claimforge.render import markdown
from pyspark.sql import functions as F

TEXTS = "array<struct<text:string,language:string>>"
SCHEMA = f"publication_number string, family_id string, title_localized {TEXTS}, abstract_localized {TEXTS}, cpc array<struct<code:string>>"
BRIEF = search.Brief(name="w", keywords=(("rotor", "blade"), ("sensor",)), cpc=("F03D", "G01"))


@pytest.fixture(scope="module")
def rows(spark):
    one = lambda *said: [(s, "en") for s in said]
    data = [
        ("A", "1", one("A Blade for a mill"), one("It has a Sensor, and a sensor more."), [("F03D 1/06",), ("F03D 1/00",)]),
        ("B", None, one("Nothing"), one("else"), []),
        ("C", "", None, one("rotor sensor"), None),
    ]
    return {r["publication_number"]: r for r in search.explained(spark.createDataFrame(data, SCHEMA), BRIEF).collect()}


def test_evidence_of_ranks(rows):
    a = rows["A"]
    assert (a["score"], a["groups_hit"], a["needs_review"]) == (6, 2, False)
    assert a["matched_terms"] == ["blade", "sensor"] and a["notes"] == []
    assert a["evidence"] == ["title: “A Blade for a mill”", "abstract: “It has a Sensor, and a sensor more.”", "cpc: F03D 1/00"]
    assert rows["B"]["evidence"] == [] and rows["B"]["notes"][0].startswith("0 of 2 keyword groups")
    assert rows["C"]["evidence"] == ["abstract: “rotor sensor”"], "one snippet backs both groups"


def test_search_log_numbers_the_candidates(spark):
    rows = [("A", 3, 1, 2, True, ["title: “x|y”"], ["verify"]), ("B", 5, 2, 2, False, [], [])]
    table = spark.createDataFrame(rows, "publication_number string, score long, groups_hit long, groups_total long, needs_review boolean, evidence array<string>, notes array<string>")
    text = markdown.search_logs(table, "w", "why").first()["text"]
    assert "Candidates: 2, to review: 1" in text and "| 1 | B | 5 | 2/2 |" in text and "| 2 | A | 3 | 1/2 | title: “x｜y” | verify |" in text
    assert "No candidates." in markdown.search_logs(table.limit(0), "w", "why").first()["text"]


def test_fact_and_semantic_tables(spark):
    facts = spark.createDataFrame([("A", "US", None, "", ["1", "2"], None, "x")], "canonical string, office string, title string, legal_status string, claims array<string>, family_id string, source string")
    assert markdown.fact_rows(facts).first()["line"] == "| A | US | — | — | 2 | — | x |"
    verdicts = spark.createDataFrame([("A", 1, "e|" + "x" * 100, "MATCH", "s" * 101, 0.5), ("A", 0, "f", "MISSING", "", 0.25)], "canonical string, pos int, element string, verdict string, span string, confidence double")
    lines = markdown.semantic_tables(verdicts).first()["text"].split("\n")
    assert lines[2:] == ["| f | MISSING | — | 0.25 |", "| e｜" + "x" * 78 + " | MATCH | " + "s" * 100 + "… | 0.50 |"]


def test_text_kernels(spark):
    replies = ['```json\n{"a": 1}\n```', 'Sure: {"a": {"b": 2}} done', "no", "", None, "{broken"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(replies)], "i int, x string").orderBy("i").select(T.reply_json(F.col("x"))).collect()]
    assert got == ['{"a":1}', '{"a":{"b":2}}', "{}", "{}", "{}", "{}"]
    titles = ["\n\n# A title \nmore", "", None, "x" * 90, "##"]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(titles)], "i int, x string").orderBy("i").select(T.specification_title(F.col("x"))).collect()]
    assert got == ["A title", "(no title)", "(no title)", "x" * 80, "(no title)"]
    assert [r[0] for r in spark.createDataFrame([(-1.0,), (50.0,), (120.0,)], "x double").select(T.clamped_percent(F.col("x"))).collect()] == [0.0, 50.0, 100.0]
