"""Commands from files to written tables."""

import json

import pytest
from claimforge import commands


@pytest.fixture
def case(tmp_path):
    (tmp_path / "numbers.csv").write_text("number,note\nUS 8000001 B2,\nUS 8000009 B2,\n")
    records = tmp_path / "records"
    records.mkdir()
    said = {"canonical": "US-8000001-B2", "office": "US", "number": "8000001", "title": "A widget", "claims": ["1. A widget comprising: a red housing with a carrier; a blue motor."], "notes": []}
    (records / "a.json").write_text(json.dumps(said))
    (tmp_path / "spec.txt").write_text("The red housing has a carrier.")
    return tmp_path


def test_normalize(spark, case):
    assert commands.main(["normalize", f"{case}/numbers.csv", f"{case}/out"], spark) == 0
    rows = spark.read.option("header", True).csv(f"{case}/out").collect()
    assert {r["canonical"] for r in rows} == {"US-8000001-B2", "US-8000009-B2"}


def test_run_writes_reports_and_what_is_missing(spark, case):
    (case / "legal.json").write_text(json.dumps({"US-8000001-B2": {"status": "LAPSED", "events": []}}))
    assert commands.main(["run", f"{case}/numbers.csv", f"{case}/records", f"{case}/spec.txt", f"{case}/out", "--legal", f"{case}/legal.json"], spark) == 0
    assert [r["canonical"] for r in spark.read.option("header", True).csv(f"{case}/out/missing").collect()] == ["US-8000009-B2"]
    text = "\n".join(r["value"] for r in spark.read.text(f"{case}/out/reports").collect())
    assert "strict: " in text and " of " in text
    assert "Proposals:" in text and "**defence** The specification says nothing of this element" in text and "a blue motor" in text
    assert "US-8000001-B2" in text and "not a legal conclusion" in text
    assert "LAPSED" in "\n".join(r["value"] for r in spark.read.text(f"{case}/out/facts").collect())
    assert spark.read.parquet(f"{case}/out/scores").count() == 1


def test_search(spark, case):
    pub = {"publication_number": "US-1-A1", "country_code": "US", "publication_date": 20200101, "title_localized": [{"text": "Widget", "language": "en"}], "abstract_localized": [], "claims_localized": [], "cpc": []}
    (case / "pubs.json").write_text(json.dumps(pub))
    (case / "brief.json").write_text(json.dumps({"name": "w", "keywords": [["widget"]]}))
    assert commands.main(["search", f"{case}/brief.json", f"{case}/pubs.json", f"{case}/out"], spark) == 0
    assert [r["number"] for r in spark.read.option("header", True).csv(f"{case}/out/candidates").collect()] == ["US-1-A1"]


def test_compare(spark, case):
    (case / "labels.csv").write_text("case,element_substring,expected\nUS-8000001-B2,housing,MATCH\nUS-8000001-B2,motor,MISSING\n")
    assert commands.main(["compare", f"{case}/labels.csv", f"{case}/records", f"{case}/spec.txt", f"{case}/out"], spark) == 0
    assert spark.read.parquet(f"{case}/out/accuracy").first()["total"] == 2


def test_watch_and_snapshots(spark, case):
    for name, row in (("hits", {"theme": "t", "run_date": "2024-01-01", "pub": "A"}), ("shots", {"canonical": "X", "fetched_at": "2024-01-01", "content_hash": "a"})):
        (case / name).mkdir()
        (case / name / "1.json").write_text(json.dumps(row))
    assert commands.main(["watch", f"{case}/hits", f"{case}/seen", f"{case}/mark1"], spark) == 0
    assert commands.main(["snapshots", f"{case}/shots", f"{case}/store", f"{case}/mark2"], spark) == 0
    assert spark.read.parquet(f"{case}/seen/seen").count() == 1
    assert spark.read.parquet(f"{case}/store").count() == 1


def test_selfcheck_over_given_inputs(spark, case):
    """A record that doesn't say where it is from breaks a gate; with its source all gates pass."""
    argv = ["selfcheck", f"{case}/numbers.csv", f"{case}/records", f"{case}/spec.txt"]
    assert commands.main([*argv, f"{case}/out1"], spark) == 1
    report = json.loads("\n".join(r["value"] for r in spark.read.text(f"{case}/out1/gates").collect()))
    assert not report["passed"] and len(report["gates"]) == 7
    assert [(g["gate"], g["violations"]) for g in report["gates"] if not g["passed"]] == [("G-PROVENANCE", 1)]
    said = json.loads((case / "records/a.json").read_text()) | {"source": "fixture"}
    (case / "records/a.json").write_text(json.dumps(said))
    assert commands.main([*argv, f"{case}/out2"], spark) == 0
    assert spark.read.parquet(f"{case}/out2/verdicts").count() == 2


def test_site(spark, case):
    assert commands.main(["site", f"{case}/records", f"{case}/spec.txt", f"{case}/out"], spark) == 0
    assert "patents: 1" in spark.read.text(f"{case}/out/banner").first()["value"]
    assert "US-8000001-B2.html" in spark.read.text(f"{case}/out/index").first()["value"]
    assert "<mark>" in spark.read.parquet(f"{case}/out/pages").first()["html"]


def test_watch_runs_its_searches(spark, case):
    """Publications come in twice; each brief reports what it hadn't seen, and a batch that ran does nothing again."""
    pub = lambda n, title: {"publication_number": n, "country_code": "US", "publication_date": 20200101, "title_localized": [{"text": title, "language": "en"}], "abstract_localized": [], "cpc": [{"code": "H02J"}]}
    (case / "briefs").mkdir()
    (case / "briefs/a.json").write_text(json.dumps({"name": "coils", "keywords": [["coil"], ["it's", "100%"]]}))
    (case / "briefs/b.json").write_text(json.dumps({"name": "power", "cpc": ["h02"]}))
    (case / "in").mkdir()
    argv = ["watch", f"{case}/in", f"{case}/state", f"{case}/mark", "--briefs", f"{case}/briefs", "--date"]
    (case / "in/1.json").write_text("\n".join(json.dumps(pub(*x)) for x in (("P1", "A Coil at 100%"), ("P2", "a rod"))))
    assert commands.main([*argv, "2024-01-01"], spark) == 0
    (case / "in/2.json").write_text("\n".join(json.dumps(pub(*x)) for x in (("P1", "A Coil at 100%"), ("P3", "it's a coil"))))
    assert commands.main([*argv, "2024-01-08"], spark) == 0
    seen = {(r["theme"], r["pub"], r["first_seen"]) for r in spark.read.parquet(f"{case}/state/seen").collect()}
    assert seen == {("coils", "P1", "2024-01-01"), ("power", "P1", "2024-01-01"), ("power", "P2", "2024-01-01"), ("coils", "P3", "2024-01-08"), ("power", "P3", "2024-01-08")}
    runs = {(r["theme"], r["run_date"], r["hits"], r["new"]) for r in spark.read.parquet(f"{case}/state/runs").collect()}
    assert runs == {("coils", "2024-01-01", 1, 1), ("power", "2024-01-01", 2, 2), ("coils", "2024-01-08", 2, 1), ("power", "2024-01-08", 2, 1)}
    text = "\n".join(r["value"] for r in spark.read.text(f"{case}/state/reports/batch=1").collect())
    assert "- P3" in text and "- P1" not in text and text.count("not a legal conclusion") == 2


def test_written_tables_have_head_and_disclaimer(spark, case):
    assert commands.main(["run", f"{case}/numbers.csv", f"{case}/records", f"{case}/spec.txt", f"{case}/out"], spark) == 0
    for name, head in (("screening", "| Patent | Band"), ("facts", "| Number | Office")):
        lines = [r["value"] for r in spark.read.text(f"{case}/out/{name}").collect()]
        assert lines[0].startswith(head) and lines[-1].endswith("not a legal conclusion.") and "US-8000001-B2" in lines[2]


def test_search_log_has_the_sql_that_ran(spark, case):
    pub = {"publication_number": "US-1-A1", "title_localized": [{"text": "It's a Widget", "language": "en"}], "abstract_localized": [], "cpc": []}
    (case / "pubs.json").write_text(json.dumps(pub))
    (case / "brief.json").write_text(json.dumps({"name": "w", "keywords": [["it's a widget"]]}))
    assert commands.main(["search", f"{case}/brief.json", f"{case}/pubs.json", f"{case}/out"], spark) == 0
    text = "\n".join(r["value"] for r in spark.read.text(f"{case}/out/log").collect())
    logged = text.split("```sql\n")[1].split("\n```")[0]
    again = commands.search.SearchSql.from_log(logged).run(commands.readers.publications(spark, f"{case}/pubs.json"))
    assert [r["publication_number"] for r in again.collect()] == ["US-1-A1"] and "US-1-A1" in text


def test_golden_cases(spark, case):
    """Each case is judged by its own specification, as it is alone; labels that match no element are missing."""
    cases = [("one", "The red housing has a carrier.", "1. A thing comprising: a red housing with a carrier; a blue motor", [("HOUSING", "MATCH"), ("motor", "MISSING"), ("nothing like it", "MISSING")]), ("two", "A blue motor turns.", "1. A thing comprising: a red housing with a carrier; a blue motor", [("housing", "MISSING"), ("blue motor", "MATCH")])]
    (case / "cases").mkdir()
    for name, spec, claim, labels in cases:
        said = {"name": name, "target_spec": spec, "patent": {"canonical": f"US-{name}", "claims": [claim]}, "expected_verdicts": [{"element_substring": s, "expected": e} for s, e in labels]}
        (case / f"cases/{name}.json").write_text(json.dumps(said, indent=1))
    assert commands.main(["golden", f"{case}/cases", f"{case}/out", "--least", "1"], spark) == 0
    pairs = spark.read.parquet(f"{case}/out/pairs").collect()
    assert len(pairs) == 5 and all(r["agreed"] for r in pairs)
    lines = [r["value"] for r in spark.read.text(f"{case}/out/matrix").collect()]
    assert lines[0] == "| Expected | MATCH | MISSING | UNCLEAR |" and lines[2:5] == ["| MATCH | 2 | 0 | 0 |", "| MISSING | 0 | 3 | 0 |", "| UNCLEAR | 0 | 0 | 0 |"]
    (case / "cases/one.json").write_text((case / "cases/one.json").read_text().replace("MISSING", "UNCLEAR"))
    assert commands.main(["golden", f"{case}/cases", f"{case}/out", "--least", "0.9"], spark) == 1


def test_worksheet_filled_in_judges_a_run(spark, case, capsys):
    base = [f"{case}/numbers.csv", f"{case}/records", f"{case}/spec.txt"]
    assert commands.main(["worksheet", f"{case}/records", f"{case}/sheet"], spark) == 0
    rows = [json.loads(line) for p in sorted((case / "sheet").glob("part-*.json")) for line in p.read_text().splitlines()]
    assert [r["element"] for r in sorted(rows, key=lambda r: r["pos"])] == ["a red housing with a carrier", "a blue motor"]
    assert commands.main(["run", *base, f"{case}/none", "--judge", "worksheet"], spark) == 2
    assert "--verdicts" in capsys.readouterr().err and not (case / "none").exists()
    assert commands.main(["run", *base, f"{case}/none", "--verdicts", "x"], spark) == 2
    (case / "filled").mkdir()
    said = [
        {"canonical": "US-8000001-B2", "element": " a red housing with a carrier ", "verdict": "unclear", "evidence_span": "", "confidence": "0.1"},
        {"canonical": "US-8000001-B2", "element": "a red housing with a carrier", "verdict": "match", "evidence_span": "red housing has a carrier", "confidence": "0.8"},
        {"canonical": None, "element": "a blue motor", "verdict": "MATCH", "evidence_span": "made up", "confidence": "0.9"},
        {"canonical": "US-8000001-B2", "element": "", "verdict": "MATCH"},
    ]
    (case / "filled" / "a.json").write_text("\n".join(json.dumps(r) for r in said))
    assert commands.main(["run", *base, f"{case}/out", "--judge", "worksheet", "--verdicts", f"{case}/filled"], spark) == 0
    got = spark.read.parquet(f"{case}/out/scores").first()
    # First element: strict 1, worksheet 0.8; second: strict misses it (0), and the quotation stands nowhere, so it is unclear at 0.9.
    assert got["n_elements"] == 2 and abs(got["coverage"] - 100 * (0.9 + 0.45) / 2) < 1e-9
    text = "\n".join(r["value"] for r in spark.read.text(f"{case}/out/reports").collect())
    assert "worksheet: filled in" in text and "| MATCH | red housing has a carrier | 0.80 |" in text and "Verdicts:" in text and "made up" not in text


def test_worksheet_not_filled_in_is_unclear(spark, case):
    (case / "sheet.json").write_text(json.dumps({"elements": [{"canonical": "US-8000001-B2", "element": "a blue motor", "verdict": " "}]}))
    (case / "labels.csv").write_text("case,element_substring,expected\nUS-8000001-B2,housing,UNCLEAR\nUS-8000001-B2,motor,UNCLEAR\n")
    assert commands.main(["compare", f"{case}/labels.csv", f"{case}/records", f"{case}/spec.txt", f"{case}/cmp", "--judge", "worksheet", "--verdicts", f"{case}/sheet.json"], spark) == 0
    assert spark.read.parquet(f"{case}/cmp/accuracy").first()["accuracy"] == 1.0
