"""HTML pages: nothing from data is markup, terms are marked, unscored patents come last."""

from pyspark.sql import functions as F

from claimforge.operators import ranks
from claimforge.render import pages


def test_highlighting_escapes_first_and_takes_the_longest_term(spark):
    rows = spark.createDataFrame(
        [(1, "<b>Red</b> housing & house", ["house", "housing", "red", "amp", "lt", "b"]), (2, None, ["a"]), (3, "plain 'x27'", None)], "k int, text string, terms array<string>"
    )
    got = {r["k"]: r["html"] for r in rows.select("k", pages.highlighted(F.col("text"), F.col("terms")).alias("html")).collect()}
    assert got == {1: "&lt;b&gt;<mark>Red</mark>&lt;/b&gt; <mark>housing</mark> &amp; <mark>house</mark>", 2: "", 3: "plain &#x27;x27&#x27;"}


def test_site(spark):
    kind = "canonical string, office string, title string, assignee string, pub_date string, legal_status string, source_url string"
    records = spark.createDataFrame([("A/1", "US", "<i>", None, None, None, "javascript:x"), ("B", "US", "t", None, None, None, "https://b/?a&b"), ("C", "US", "t", None, None, None, None)], kind)
    kind = "canonical string, coverage double, low double, high double, agreement double, review_count bigint, risk_band string"
    scores = spark.createDataFrame([("A/1", 30.0, -3.0, 40.0, 0.9, 0, "LOW"), ("B", 90.0, 80.0, 120.0, 0.95, 2, "HIGH")], kind)
    kind = "canonical string, pos int, element string, span string, rationale string, p_coverage double, band string, needs_review boolean, matched_terms array<string>"
    fused = spark.createDataFrame([("B", 1, "second", None, None, 0.1, "gap", True, []), ("B", 0, "first part", "the part", "why", 0.9, "covered", False, ["part"])], kind)
    changes = spark.createDataFrame([("B", "2024", "legal_status", "changed", "<", None)], "canonical string, fetched_at string, field string, kind string, before string, after string")
    index = pages.index_rows(records, scores).collect()
    assert [r["canonical"] for r in index] == ["B", "A/1", "C"]
    assert "&lt;i&gt;" in index[1]["html"] and 'href="A_1.html"' in index[1]["html"] and "(0–40%" in index[1]["html"]
    assert pages.banner(scores).first()["html"] == "<p>patents: 2, HIGH: 1, LOW: 1, to review: 2</p>"
    summaries = records.select("canonical", F.lit("one & all").alias("one_line"))
    got = {r["canonical"]: r for r in pages.detail_pages(records, summaries, scores, fused, changes).collect()}
    assert len(got) == 3 and got["A/1"]["page"] == "A_1.html" and "javascript" not in got["A/1"]["html"] and "No claim elements" in got["A/1"]["html"]
    b = got["B"]["html"]
    assert b.index("first <mark>part</mark>") < b.index("second") and "https://b/?a&amp;b" in b and "<td>&lt;</td>" in b and "one &amp; all" in b
    assert all(r["html"].startswith("<!DOCTYPE html>") and "not a legal conclusion" in r["html"] for r in got.values())


def scored(spark, n):
    kind = "canonical string, coverage double, low double, high double, agreement double, review_count bigint, risk_band string"
    return spark.createDataFrame([(f"N{i:04d}", float(i % 7), 0.0, 9.0, 0.9, 0, ("HIGH", "MEDIUM", "LOW", "UNKNOWN")[i % 4]) for i in range(n)], kind)


def test_numbers_are_those_of_one_sort(spark):
    scores = scored(spark, 1000).repartition(7)
    got = {r["canonical"]: r["rank"] for r in ranks.numbered(scores, F.desc("coverage"), "canonical").collect()}
    wanted = sorted(scores.collect(), key=lambda r: (-r["coverage"], r["canonical"]))
    assert got == {r["canonical"]: k for k, r in enumerate(wanted, 1)}
    assert ranks.numbered(scores.limit(0), "canonical").collect() == []
    same = spark.createDataFrame([(None,)] * 5 + [("x",)] * 5, "a string").repartition(4)
    assert sorted(r["k"] for r in ranks.numbered(same, "a", name="k").collect()) == list(range(1, 11))


def test_site_files(spark, tmp_path):
    scores = scored(spark, 25)
    records = scores.select("canonical", *[F.lit("x").alias(c) for c in ("office", "title", "assignee", "pub_date", "legal_status", "source_url")])
    fused = spark.createDataFrame([], "canonical string, pos int, element string, span string, rationale string, p_coverage double, band string, needs_review boolean, matched_terms array<string>")
    pages.write_site(records, records.select("canonical", F.lit("one").alias("one_line")), scores, fused, str(tmp_path), size=10)
    names = {p.name for p in (tmp_path / "html").iterdir() if not p.name.startswith(".")}
    assert names == {"index.html", "index-2.html", "index-3.html"} | {f"N{i:04d}.html" for i in range(25)}
    second = (tmp_path / "html" / "index-2.html").read_text()
    assert 'href="index.html">previous' in second and 'href="index-3.html">next' in second and "page 2 of 3" in second
    assert "<td>11</td>" in second and "<td>20</td>" in second and "<td>21</td>" not in second and second.count("<tr><td>") == 10
    assert "patents: 25" in second and "not a legal conclusion" in second and "<script>" in second
    told = {r["page"]: r["bytes"] for r in spark.read.parquet(f"{tmp_path}/files").collect()}
    assert told["index-2.html"] == len(second.encode()) and set(told) == names


def test_index_without_records(spark):
    none = scored(spark, 0)
    records = none.select("canonical", *[F.lit("x").alias(c) for c in ("title", "assignee", "pub_date", "legal_status")])
    got = pages.index_pages(records, none).collect()
    assert [(r["page"], r["n"], r["first"], r["previous"], r["next"]) for r in got] == [("index.html", 0, None, None, None)] and "No records." in got[0]["html"]
