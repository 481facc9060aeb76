"""HTML pages: an index in triage order and a page per patent, as rows of text. All that comes from data is escaped."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clamped_percent, escaped, met, safe_link, safe_name
from ..operators.ranks import numbered
from ..operators.scoring import BANDS, element_rationale, rationale, triage_rank
from .markdown import DISCLAIMER

STYLE = "table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:4px}.HIGH,.gap{color:#a00}.MEDIUM,.partial{color:#a60}.LOW,.covered{color:#060}"

#: Sorts a page's table by the column whose head is clicked, numbers as numbers, a second click the other way round.
SORT = """document.querySelectorAll("th").forEach(function (head) {
  head.onclick = function () {
    var body = head.closest("table").tBodies[0], column = head.cellIndex, way = head.dataset.way === "1" ? -1 : 1;
    head.dataset.way = way;
    var said = function (row) { return row.cells[column].textContent.trim(); };
    var lines = Array.from(body.rows).filter(function (row) { return row.cells[0].tagName === "TD"; });
    lines.sort(function (a, b) { return way * said(a).localeCompare(said(b), undefined, {numeric: true}); });
    lines.forEach(function (row) { body.appendChild(row); });
  };
});"""
HEAD = ("No.", "Patent", "Title", "Assignee", "Date", "Status", "Risk")


def _said(c: Column | str) -> Column:
    """Escaped; a dash where nothing is known."""
    c = F.col(c) if isinstance(c, str) else c
    return escaped(F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit("—")))


def _inside(tag: str, *parts: Column, of: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{of}>"), *parts, F.lit(f"</{tag}>"))


def _whole(percent: Column) -> Column:
    return F.bround(clamped_percent(percent), 0).cast("int").cast("string")


def bar(percent: Column) -> Column:
    """A gauge from 0 to 100, with the number beside it."""
    return F.concat(F.lit('<meter min="0" max="100" value="'), _whole(percent), F.lit('"></meter> '), _whole(percent), F.lit("%"))


def badge(label: Column, known: tuple[str, ...] = BANDS) -> Column:
    """A label whose class is one of ``known``, or the last of them."""
    return F.concat(F.lit('<b class="'), F.when(label.isin(*known), label).otherwise(known[-1]), F.lit('">'), _said(label), F.lit("</b>"))


def highlighted(text: Column, terms: Column) -> Column:
    """Escaped text with each whole term of two characters or more marked, whatever its case, the longest first. Names
    of entities are never terms."""
    known = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.length(t) > 1)
    longest = F.array_sort(F.array_distinct(known), lambda a, b: F.length(b) - F.length(a))
    choice = F.array_join(F.transform(longest, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?iuU)(?<!&)(?<!&#)\b("), choice, F.lit(r")\b"))
    plain = escaped(F.coalesce(text, F.lit("")))
    return F.when(F.size(known) > 0, F.regexp_replace(plain, pattern, F.lit("<mark>$1</mark>"))).otherwise(plain)


def page(title: Column, *body: Column) -> Column:
    head = _inside("head", F.lit('<meta charset="utf-8">'), _inside("title", _said(title)), F.lit(f"<style>{STYLE}</style>"))
    return F.concat(F.lit("<!DOCTYPE html><html>"), head, _inside("body", *body, F.lit(f"<footer>{DISCLAIMER}</footer>")), F.lit("</html>"))


def banner(scores: DataFrame) -> DataFrame:
    """One row ``html``: how many patents there are, how many of each band that occurs, and how many reviews."""
    counts = scores.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("review_count"), F.lit(0)).alias("reviews"), *[F.count_if(F.col("risk_band") == b).alias(b) for b in BANDS])
    bands = [F.when(F.col(b) > 0, F.concat(F.lit(f"{b}: "), F.col(b).cast("string"))) for b in BANDS]
    reviews = F.when(F.col("reviews") > 0, F.concat(F.lit("to review: "), F.col("reviews").cast("string")))
    return counts.select(F.concat(F.lit("<p>"), F.concat_ws(", ", F.concat(F.lit("patents: "), F.col("n").cast("string")), *bands, reviews), F.lit("</p>")).alias("html"))


def risk(column: str = "risk_band") -> Column:
    """Coverage with its band, range, agreement and reviews; a dash for a patent without a score."""
    review = F.when(F.col("review_count") > 0, F.concat(F.lit(", to review: "), F.col("review_count").cast("string"))).otherwise("")
    told = F.concat(badge(F.col(column)), F.lit(" "), bar(F.col("coverage")), F.lit(" ("), _whole(F.col("low")), F.lit("–"), _whole(F.col("high")), F.lit("%, agreement "), _whole(100 * F.col("agreement")), F.lit("%"), review, F.lit(")"))
    return F.when(F.col(column).isNull(), "—").otherwise(told)


def _cells() -> list[Column]:
    link = F.concat(F.lit('<a href="'), escaped(safe_name(F.col("canonical"))), F.lit('.html">'), _said("canonical"), F.lit("</a>"))
    return [_inside("td", c) for c in (link, _said("title"), _said("assignee"), _said("pub_date"), _said("legal_status"), risk())]


def _listed(records: DataFrame, scores: DataFrame) -> DataFrame:
    return records.select("canonical", "title", "assignee", "pub_date", "legal_status").join(met(scores), "canonical", "left")


def index_rows(records: DataFrame, scores: DataFrame) -> DataFrame:
    """``canonical, html``: a table row per record, sorted by band, coverage and number; those without a score last."""
    rows = _listed(records, scores)
    return rows.orderBy(triage_rank(), F.desc("coverage"), "canonical").select("canonical", _inside("tr", *_cells()).alias("html"))


def index_name(number: Column) -> Column:
    """File of an index page; the first is ``index.html``."""
    return F.when(number == 1, "index.html").otherwise(F.concat(F.lit("index-"), number.cast("string"), F.lit(".html")))


def index_pages(records: DataFrame, scores: DataFrame, size: int = 500) -> DataFrame:
    """``number, page, n, first, last, previous, next, html``: the index as whole pages of ``size`` records in triage
    order, each with the banner, its records' numbers in that order, and links to the pages beside it.

    Rows are numbered by ``numbered``, so no task sees more than a page of them. Without records there is one page that
    says so.
    """
    rows = numbered(_listed(records, scores), triage_rank(), F.desc("coverage"), "canonical")
    line = _inside("tr", _inside("td", F.col("rank").cast("string")), *_cells())
    rows = rows.select("rank", "canonical", line.alias("line"), F.ceil(F.col("rank") / size).alias("number"))
    pages = rows.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("rank", "canonical", "line"))).alias("l"))  # ``size`` rows
    ends = rows.agg(F.coalesce(F.max("number"), F.lit(1)).alias("last_number"))  # one row
    heads = ends.crossJoin(F.broadcast(banner(scores).withColumnRenamed("html", "banner"))).withColumn("number", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("last_number"))))
    pages = heads.join(pages, "number", "left")
    number = F.col("number")
    before = F.when(number > 1, index_name(number - 1))
    after = F.when(number < F.col("last_number"), index_name(number + 1))
    link = lambda to, said: F.coalesce(F.concat(F.lit('<a href="'), to, F.lit(f'">{said}</a> ')), F.lit(""))
    steps = _inside("nav", link(before, "previous"), F.concat(F.lit("page "), number.cast("string"), F.lit(" of "), F.col("last_number").cast("string"), F.lit(" ")), link(after, "next"))
    top = "<tr>" + "".join(f"<th>{h}</th>" for h in HEAD) + "</tr>"
    table = F.coalesce(_inside("table", F.lit(top), F.array_join(F.col("l.line"), "")), F.lit("<p>No records.</p>"))
    ids = F.col("l.canonical")
    return pages.select(
        number.alias("number"),
        index_name(number).alias("page"),
        F.when(F.col("l").isNull(), 0).otherwise(F.size("l")).cast("bigint").alias("n"),
        F.get(ids, F.lit(0)).alias("first"),
        F.get(ids, F.size(ids) - 1).alias("last"),
        before.alias("previous"),
        after.alias("next"),
        page(F.lit("Patents"), F.col("banner"), steps, table, steps, F.lit(f"<script>{SORT}</script>")).alias("html"),
    )


def _line(cells: list[Column]) -> Column:
    return _inside("tr", *[_inside("td", c) for c in cells])


def _table(rows: DataFrame, order: list[str], head: tuple[str, ...], cells: list[Column] | str, name: str) -> DataFrame:
    """A table per patent of cells, or of the lines that a column has; its rows are few, as those of one claim or one
    history are."""
    lines = rows.select("canonical", F.struct(*order, (F.col(cells) if isinstance(cells, str) else _line(cells)).alias("line")).alias("l"))
    top = "<tr>" + "".join(f"<th>{h}</th>" for h in head) + "</tr>"
    return lines.groupBy("canonical").agg(_inside("table", F.lit(top), F.array_join(F.array_sort(F.collect_list("l"))["line"], "")).alias(name))


def _chart_cells(whole: bool) -> list[Column]:
    mark = lambda c: highlighted(F.col(c), F.col("matched_terms"))
    band = badge(F.col("band"), ("covered", "partial", "gap"))
    why = [F.col("rationale")] + [element_rationale()] * whole
    return [mark("element"), band, bar(100 * F.col("p_coverage")), mark("span"), F.concat_ws("<br>", *[_said(c) for c in why]), F.when(F.col("needs_review"), "review").otherwise("")]


def chart_line() -> Column:
    """The line of a fused element in its chart; what it says hangs on the element's text and what was found for it."""
    return _line(_chart_cells(True))


def chart(fused: DataFrame) -> DataFrame:
    """``canonical, chart``: elements and their evidence, the terms that both have marked, with coverage and basis. Lines
    (``line``) that ``fused`` brings are taken as they are."""
    cells = "line" if "line" in fused.columns else _chart_cells("p_strict" in fused.columns)
    return _table(fused, ["pos"], ("Element", "Band", "Coverage", "Evidence", "Basis", "Review"), cells, "chart")


def detail_pages(records: DataFrame, summaries: DataFrame, scores: DataFrame, fused: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """``canonical, page, html``: score, facts, summary, claim chart and, if given, what changed, of every record."""
    rows = records.select("canonical", "office", "title", "assignee", "pub_date", "legal_status", "source_url")
    rows = rows.join(met(summaries.select("canonical", "one_line")), "canonical", "left").join(met(scores), "canonical", "left").join(met(chart(fused)), "canonical", "left")
    history = F.lit("No change is known.")
    if changes is not None:
        cells = [_said(c) for c in ("fetched_at", "field", "kind", "before", "after")]
        rows = rows.join(_table(changes, ["fetched_at", "field"], ("When", "Field", "Kind", "Before", "After"), cells, "history"), "canonical", "left")
        history = F.coalesce("history", history)
    safe = escaped(safe_link(F.col("source_url")))
    link = F.coalesce(F.concat(F.lit('<a href="'), safe, F.lit('">'), safe, F.lit("</a>")), F.lit("—"))
    fact = lambda name, c: F.concat(F.lit(f"<dt>{name}</dt>"), _inside("dd", c))
    facts = [fact(c.replace("_", " ").capitalize(), _said(c)) for c in ("office", "title", "assignee", "pub_date", "legal_status")]
    body = [
        _inside("h1", _said("canonical")),
        _inside("p", risk()),
        F.when(F.col("risk_band").isNull(), "").otherwise(_inside("p", rationale())) if "n_elements" in scores.columns else F.lit(""),
        _inside("dl", *facts, fact("Source", link)),
        _inside("p", _said("one_line")),
        F.coalesce("chart", F.lit("<p>No claim elements.</p>")),
        _inside("section", F.lit("<h2>Changes</h2>"), history),
    ]
    return rows.select("canonical", F.concat(safe_name(F.col("canonical")), F.lit(".html")).alias("page"), page(F.col("canonical"), *body).alias("html"))


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Each row (``page, html``) as a file of that name in ``folder``, a path or address that pyarrow opens; the result
    tells ``page, bytes``, and files are written when it is used.

    A task writes its files one by one under another name and moves them into place, so a file is whole or absent, and a
    task that runs again writes what it wrote. Of rows with one name the last one moved stays.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pyarrow.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{posixpath.abspath(folder)}")
        store.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for name, html in zip(batch.column("page").to_pylist(), batch.column("html").to_pylist(), strict=True):
                said, part = (html or "").encode(), f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(said)
                store.move(part, f"{root}/{name}")
                sizes.append(len(said))
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(sizes, pa.int64())], names=["page", "bytes"])

    return rows.select("page", "html").filter("page IS NOT NULL").mapInArrow(write, "page string, bytes bigint")


def write_site(records: DataFrame, summaries: DataFrame, scores: DataFrame, fused: DataFrame, folder: str, changes: DataFrame | None = None, size: int = 500) -> None:
    """``html`` (a file for each index page and each patent), ``files`` (their names and sizes), and as tables ``banner``,
    ``index`` (table rows in triage order, part after part) and ``pages`` (``page, html``), all written by tasks."""
    spark = records.sparkSession
    banner(scores).write.mode("overwrite").text(f"{folder}/banner")
    index_rows(records, scores).select("html").write.mode("overwrite").text(f"{folder}/index")
    detail_pages(records, summaries, scores, fused, changes).select("page", "html").write.mode("overwrite").parquet(f"{folder}/pages")
    every = spark.read.schema("page string, html string").parquet(f"{folder}/pages").unionByName(index_pages(records, scores, size).select("page", "html"))
    write_files(every, f"{folder}/html").write.mode("overwrite").parquet(f"{folder}/files")
