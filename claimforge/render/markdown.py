"""Markdown reports. Each function gives one text per key, so a report of many patents is as many rows, never one string."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cell, met
from ..operators.scoring import element_rationale, rationale, triage_rank

# Fixed value: stands at the end of every report.
DISCLAIMER = "Screening support only; not a legal conclusion."
NONE = "—"


def _row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c.cast("string"), F.lit(NONE)) for c in cells]), F.lit(" |"))


def _table(*names: str) -> str:
    return f"| {' | '.join(names)} |\n|{'---|' * len(names)}"


def _lines(rows: DataFrame, key: str, order: list[Column], line: Column, name: str) -> DataFrame:
    """The lines of each key, in order, as one text."""
    rows = rows.select(key, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], line.alias("line")).alias("l"))
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("l"))["line"], "\n").alias(name))


def screening_rows(scores: DataFrame) -> DataFrame:
    """``position key, line``: the screening table's lines; sort by ``band, coverage descending, canonical``."""
    pct = lambda c: F.concat(F.bround(c, 0).cast("int").cast("string"), F.lit("%"))
    spread = F.concat(pct(F.col("low")), F.lit("–"), pct(F.col("high")))
    of = lambda c: F.concat(F.col(c).cast("string"), F.lit("/"), F.col("n_elements").cast("string"))
    line = _row(F.col("canonical"), F.col("risk_band"), pct(F.col("coverage")), spread, pct(100 * F.col("least")), of("gap_count"), of("review_count"))
    return scores.select(triage_rank().alias("band"), "coverage", "canonical", line.alias("line")).orderBy("band", F.desc("coverage"), "canonical")


SCREENING_HEAD = _table("Patent", "Band", "Coverage", "Range", "Weakest", "Gaps", "To review")


FACTS_HEAD = _table("Number", "Office", "Title", "Status", "Claims", "Family", "Source")


def fact_rows(records: DataFrame) -> DataFrame:
    """``canonical, line``: the facts of each record; what isn't known is a dash."""
    shown = lambda c: F.nullif(F.col(c), F.lit(""))
    claims = F.coalesce(F.size("claims"), F.lit(0))
    return records.select("canonical", _row(F.col("canonical"), shown("office"), shown("title"), shown("legal_status"), claims, shown("family_id"), shown("source")).alias("line"))


def semantic_tables(verdicts: DataFrame) -> DataFrame:
    """``canonical, text``: each element's verdict, the span that it rests on and the confidence, in claim order."""
    cut = lambda c, n: F.replace(F.substring(c, 1, n), F.lit("|"), F.lit("｜"))
    span = F.when(F.length("span") > 100, F.concat(cut("span", 100), F.lit("…"))).otherwise(cut("span", 100))
    line = _row(cut("element", 80), F.col("verdict"), F.nullif(span, F.lit("")), F.format_number("confidence", 2))
    out = _lines(verdicts, "canonical", [F.col("pos")], line, "rows")
    return out.select("canonical", F.concat(F.lit(_table("Element", "Verdict", "Evidence", "Confidence") + "\n"), F.col("rows")).alias("text"))


def search_logs(explained: DataFrame, name: str, purpose: str, shown: int = 200, sql: str = "") -> DataFrame:
    """One row ``text``: how many candidates a search has, the SQL that was run, and the best ``shown`` with number,
    evidence and notes."""
    best = explained.orderBy(F.desc("score"), "publication_number").limit(shown)
    ranked = best.withColumn("k", F.row_number().over(Window.orderBy(F.desc("score"), "publication_number")))  # ``shown`` rows
    joined = lambda c: cell(F.array_join(c, "; "), 200)
    groups = F.concat(F.col("groups_hit").cast("string"), F.lit("/"), F.col("groups_total").cast("string"))
    line = _row(F.col("k"), F.col("publication_number"), F.col("score"), groups, joined("evidence"), joined("notes"))
    table = _lines(ranked.withColumn("name", F.lit(name)), "name", [F.col("k")], line, "rows").select("rows")
    counts = explained.agg(F.count(F.lit(1)).alias("n"), F.count_if("needs_review").alias("review"))
    head = F.concat(F.lit(f"## {name}\n\n{purpose}\n\nCandidates: "), F.col("n").cast("string"), F.lit(", to review: "), F.col("review").cast("string"))
    body = F.coalesce(F.concat(F.lit(_table("No.", "Publication", "Score", "Groups", "Evidence", "Notes") + "\n"), F.col("rows")), F.lit("No candidates."))
    ran = F.lit(f"```sql\n{sql}\n```" if sql else None)
    return counts.join(table, how="left").select(F.concat_ws("\n\n", head, ran, body, F.lit(DISCLAIMER)).alias("text"))


def claim_charts(fused: DataFrame) -> DataFrame:
    """``canonical, chart``: elements in claim order with coverage, evidence, what it rests on and the review mark."""
    line = _row(cell(F.col("element"), 80), F.col("band"), F.bround("p_coverage", 2), cell(F.col("span"), 100), cell(F.col("rationale"), 120), F.when(F.col("needs_review"), "review").otherwise(""))
    out = _lines(fused, "canonical", [F.col("pos")], line, "chart")
    return out.withColumn("chart", F.concat(F.lit(_table("Element", "Band", "Coverage", "Evidence", "Basis", "Review") + "\n"), F.col("chart")))


def escalations(fused: DataFrame) -> DataFrame:
    """``canonical, escalation``: what has to be reviewed, of the patents that have any."""
    return _lines(fused.filter("needs_review"), "canonical", [F.col("pos")], F.concat(F.lit("- "), cell(F.col("element"), 80)), "escalation")


#: What each kind of proposal asks for; the element that it is about follows.
ASKED = {
    "design_around": "Every element is covered: have the wording examined, the weakest element first",
    "clarify": "Some elements are thin: look into those below; the weakest",
    "monitor": "An element is plainly missing: low priority; the weakest",
    "obtain_claims": "No claims are known: get them before anything else",
    "defence": "The specification says nothing of this element: an argument, or where to design around",
    "interpretation": "In part only: have the meaning of this element's terms checked",
}


def proposal_lists(proposals: DataFrame) -> DataFrame:
    """``canonical, proposals``: what to do about each patent, the general one first, then by element; the quotation that
    it rests on below, where it rests on one."""
    asked = F.element_at(F.create_map(*[F.lit(x) for kv in ASKED.items() for x in kv]), F.col("category"))
    about = F.when(F.col("about") != "", F.concat(F.lit(": "), cell(F.col("about"), 80))).otherwise("")
    basis = F.when(F.coalesce(F.col("basis"), F.lit("")) != "", F.concat(F.lit("\n  - “"), cell(F.col("basis")), F.lit("”"))).otherwise("")
    line = F.concat(F.lit("- **"), F.replace(F.col("category"), F.lit("_"), F.lit(" ")), F.lit("** "), asked, about, basis)
    return _lines(proposals, "canonical", [F.col("pos"), F.col("category")], line, "proposals")


def score_lines(scores: DataFrame) -> DataFrame:
    """``canonical, score``: band, coverage with its range and agreement, and why it is that band."""
    pct = lambda c: F.concat(F.bround(c, 0).cast("int").cast("string"), F.lit("%"))
    told = F.concat(F.lit("**"), F.col("risk_band"), F.lit("** "), pct(F.col("coverage")), F.lit(" ("), pct(F.col("low")), F.lit("–"), pct(F.col("high")), F.lit("), agreement "), pct(100 * F.col("agreement")))
    return scores.select("canonical", F.concat(F.when(F.col("n_elements") == 0, F.lit("**UNKNOWN**")).otherwise(told), F.lit("\n\n"), rationale()).alias("score"))


def element_lists(fused: DataFrame) -> DataFrame:
    """``canonical, shares``: how each element came by its coverage, in claim order."""
    return _lines(fused, "canonical", [F.col("pos")], F.concat(F.lit("- "), cell(F.col("element"), 80), F.lit(": "), element_rationale()), "shares")


def patent_reports(summaries: DataFrame, fused: DataFrame, proposals: DataFrame | None = None, scores: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """``canonical, text``: one report per patent: its score and why, if ``scores`` are given, the chart and how each
    element came by its coverage, the table of ``verdicts``, and proposals; says so where nothing is to be reviewed or no
    claims are known."""
    rows = summaries.join(met(claim_charts(fused)), "canonical", "left").join(met(escalations(fused)), "canonical", "left").join(met(element_lists(fused)), "canonical", "left")
    parts = {
        "score": None if scores is None else score_lines(scores),
        "verdicts": None if verdicts is None else semantic_tables(verdicts).withColumnRenamed("text", "verdicts"),
        "proposals": None if proposals is None else proposal_lists(proposals),
    }
    for name, part in parts.items():
        rows = rows.withColumn(name, F.lit(None).cast("string")) if part is None else rows.join(met(part), "canonical", "left")
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("## "), F.col("canonical")),
        F.col("one_line"),
        F.col("score"),
        F.coalesce("chart", F.lit("No claim elements.")),
        F.col("shares"),
        F.concat(F.lit("Verdicts:\n\n"), F.col("verdicts")),
        F.concat(F.lit("Proposals:\n"), F.col("proposals")),
        F.concat(F.lit("Review:\n"), F.coalesce("escalation", F.lit("nothing marked for review"))),
        F.lit(DISCLAIMER),
    )
    return rows.select("canonical", text.alias("text"))


def diff_reports(changes: DataFrame) -> DataFrame:
    """``canonical, text``: the changes of each record, by time and field."""
    line = _row(F.col("fetched_at"), F.col("field"), F.col("kind"), cell(F.col("before")), cell(F.col("after")))
    out = _lines(changes, "canonical", [F.col("fetched_at"), F.col("field")], line, "rows")
    head = F.lit("\n\n" + _table("When", "Field", "Kind", "Before", "After") + "\n")
    return out.select("canonical", F.concat(F.lit("## "), F.col("canonical"), head, F.col("rows"), F.lit("\n\n" + DISCLAIMER)).alias("text"))


def matrix_rows(cells: DataFrame) -> DataFrame:
    """``label, line``: the confusion matrix, a line per expected label, found labels in order."""
    counts = F.array_sort(F.collect_list(F.struct("actual", F.col("n").cast("string").alias("n"))))["n"]
    return cells.groupBy(F.col("expected").alias("label")).agg(_row(F.col("expected"), F.array_join(counts, " | ")).alias("line"))


def watch_reports(themes: DataFrame, new_hits: DataFrame) -> DataFrame:
    """``theme, text``: the new hits of each watched search, or that there is no change."""
    found = _lines(new_hits, "theme", [F.col("pub")], F.concat(F.lit("- "), F.col("pub")), "rows")
    rows = themes.select("theme").distinct().join(found, "theme", "left")
    said = F.coalesce("rows", F.lit("No change since the last run."))
    return rows.select("theme", F.concat(F.lit("## "), F.col("theme"), F.lit("\n\n"), said, F.lit("\n\n" + DISCLAIMER)).alias("text"))


def write(reports: DataFrame, path: str) -> None:
    """Texts as files, each task writing its own."""
    reports.select("text").write.mode("overwrite").text(path, lineSep="\n\n")


def write_table(rows: DataFrame, head: str, path: str) -> None:
    """Lines of a table as files in their order. Every file that has lines is a table by itself, with its head before
    and the disclaimer after it, however many files there are."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        said = lambda text: pa.RecordBatch.from_arrays([pa.array([text], schema.field(0).type)], schema=schema)
        for batch in batches:
            if batch.num_rows:
                if schema is None:
                    schema = batch.schema
                    yield said(head)
                yield batch
        if schema is not None:
            yield said(f"\n{DISCLAIMER}")

    rows.select("line").mapInArrow(framed, "line string").write.mode("overwrite").text(path)
