"""Commands: ``python -m claimforge.commands NAME ...``. Each is a few operators between a reader and a written table."""

from __future__ import annotations

import argparse
import datetime
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numbers
from .operators import embedders, evaluation, judges, legal, records, scoring, search, state
from .render import markdown, pages
from .sources import readers
from .streaming import monitor


JUDGES = ("keyless", "worksheet")


class Unconfigured(Exception):
    """A choice that lacks what it needs; the message says what to do."""


def _judged(spark: SparkSession, found: DataFrame, a: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """The specification, and the elements judged by it: the recall channel is that of the chosen judge."""
    chosen, filled = getattr(a, "judge", "keyless"), getattr(a, "verdicts", None)
    if chosen == "worksheet" and not filled:
        raise Unconfigured("--judge worksheet needs --verdicts: write a worksheet with the command `worksheet`, fill it in, and name it")
    if filled and chosen != "worksheet":
        raise Unconfigured("--verdicts is for --judge worksheet only")
    one = judges.specification(spark, Path(a.spec).read_text(encoding="utf-8"))
    judged = judges.judge(scoring.claim_elements(found), one)
    return one, judges.by_worksheet(judged, readers.worksheet(spark, filled), one) if filled else judged


def normalize(spark: SparkSession, a: argparse.Namespace) -> int:
    """A list of numbers as a table, those to review included."""
    rows = numbers.normalise(readers.number_list(spark, a.numbers))
    rows.select("raw", "canonical", "office", "confidence", "needs_review").write.mode("overwrite").option("header", True).csv(a.out)
    return 0


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    """Numbers to screening table, facts, reports per patent, and the numbers that no source has."""
    asked = numbers.normalise(readers.number_list(spark, a.numbers)).select("canonical").filter("canonical IS NOT NULL").distinct()
    found, missing = records.fetch(asked, readers.SOURCES[a.source](spark, a.records))
    if a.legal:
        found = legal.apply(found, readers.legal_status(spark, a.legal))
    _, judged = _judged(spark, found, a)
    fused = judges.fuse(judged)
    scores = scoring.score_fused(found, fused)
    markdown.write_table(markdown.screening_rows(scores), markdown.SCREENING_HEAD, f"{a.out}/screening")
    markdown.write_table(markdown.fact_rows(found), markdown.FACTS_HEAD, f"{a.out}/facts")
    verdicts = judged.select("canonical", "pos", "element", f"{'recall' if a.judge == 'worksheet' else 'strict'}.*")
    markdown.write(markdown.patent_reports(records.summaries(found), fused, scoring.proposals(scores, fused), scores, verdicts), f"{a.out}/reports")
    scores.write.mode("overwrite").parquet(f"{a.out}/scores")
    missing.write.mode("overwrite").option("header", True).csv(f"{a.out}/missing")
    return 0


def site(spark: SparkSession, a: argparse.Namespace) -> int:
    """Pages of all records: banner, index in triage order and a page each; with ``--history`` what changed in each."""
    found = readers.SOURCES[a.source](spark, a.records)
    _, judged = _judged(spark, found, a)
    fused = judges.fuse(judged)
    changes = spark.read.parquet(a.history) if a.history else None
    pages.write_site(found, records.summaries(found), scoring.score_fused(found, fused), fused, a.out, changes, int(a.size))
    return 0


def worksheet(spark: SparkSession, a: argparse.Namespace) -> int:
    """A worksheet of all claim elements, to be filled in and given to ``run --judge worksheet --verdicts``."""
    readers.write_worksheet(scoring.claim_elements(readers.SOURCES[a.source](spark, a.records)), a.out)
    return 0


def find(spark: SparkSession, a: argparse.Namespace) -> int:
    """Candidates of a brief, one per family, with ``--semantic`` in the order of both channels, and the log of the search with the SQL that was run."""
    brief = search.Brief.load(Path(a.brief).read_text(encoding="utf-8"))
    made = search.search_sql(brief)
    hits = made.run(readers.publications(spark, a.records))
    explained = search.explained(hits, brief)
    best, note = search.one_per_family(search.rank(hits, brief)), F.concat(F.lit("score "), F.col("score").cast("string"))
    if a.semantic:
        best = embedders.both_channels(hits, brief, embedders.EMBEDDERS.get(a.semantic))
        note = F.concat_ws("; ", note, F.concat(F.lit("combined "), F.format_string("%.3f", "combined")), F.array_join("notes", "; "))
    best.select(F.col("publication_number").alias("number"), note.alias("note")).write.mode("overwrite").option("header", True).csv(f"{a.out}/candidates")
    markdown.write(markdown.search_logs(explained, brief.name or "search", brief.purpose, sql=made.logged()), f"{a.out}/log")
    return 0


def watch(spark: SparkSession, a: argparse.Namespace) -> int:
    """New hits of watched searches among the files that have come in: ready hits, or with ``--briefs`` publications,
    which every brief of that folder is searched for in. Reports go beside the state."""
    briefs = [search.Brief.load(p.read_text(encoding="utf-8")) for p in sorted(Path(a.briefs).glob("*.json"))] if a.briefs else None
    monitor.watch(spark, a.incoming, a.state, a.checkpoint, briefs, a.date or datetime.date.today().isoformat()).awaitTermination()
    return 0


def snapshots(spark: SparkSession, a: argparse.Namespace) -> int:
    """Changed snapshots among the hashed records that have come in."""
    monitor.snapshots(spark, a.incoming, a.state, a.checkpoint).awaitTermination()
    return 0


def follow(spark: SparkSession, a: argparse.Namespace) -> int:
    """Fetched records that have come in: snapshots, changes field by field, and a report for each changed record."""
    monitor.records(spark, a.incoming, a.state, a.checkpoint).awaitTermination()
    return 0


def selfcheck(spark: SparkSession, a: argparse.Namespace) -> int:
    """A run over given inputs with its gates watched as its tables are written; a JSON report, and 1 if any fails."""
    asked = numbers.normalise(readers.number_list(spark, a.numbers))
    found = readers.SOURCES[a.source](spark, a.records)
    spec, judged = _judged(spark, found, a)
    text = spec.first()["spec"]  # the file that was just read
    hashed = state.hashed(found).select("canonical", "content_hash", F.lit("1").alias("fetched_at"))
    tables = {
        "numbers": asked,
        "records": found,
        "verdicts": judged.select("canonical", "pos", "strict.*"),
        "reports": markdown.patent_reports(records.summaries(found), judges.fuse(judged)),
        "saved_twice": state.to_save(hashed, hashed),
    }
    gated = evaluation.written_and_gated(tables, text, markdown.DISCLAIMER, a.out)
    report = spark.createDataFrame([(evaluation.gate_report(gated),)], "value string")
    report.coalesce(1).write.mode("overwrite").text(f"{a.out}/gates")
    for name, passed, checked, violations in gated:
        if not passed:
            print(f"{name}: {violations} of {checked}", file=sys.stderr)
    return 0 if all(passed for _, passed, _, _ in gated) else 1


def compare(spark: SparkSession, a: argparse.Namespace) -> int:
    """Verdicts against labels (``case, element_substring, expected``): precision and recall per label, and accuracy."""
    labels = spark.read.option("header", True).csv(a.labels)
    _, judged = _judged(spark, readers.SOURCES[a.source](spark, a.records), a)
    channel = "recall" if a.judge == "worksheet" else "strict"
    verdicts = judged.select(F.col("canonical").alias("case"), "pos", "element", F.col(f"{channel}.verdict").alias("verdict"))
    pairs = evaluation.matched_labels(labels, verdicts)
    evaluation.precision_recall(evaluation.confusion(pairs)).write.mode("overwrite").parquet(f"{a.out}/labels")
    evaluation.accuracy(pairs).write.mode("overwrite").parquet(f"{a.out}/accuracy")
    return 0


def golden(spark: SparkSession, a: argparse.Namespace) -> int:
    """Labelled cases, each with a specification of its own: matrix, precision and recall per label, and accuracy; 1 if
    that is under ``--least``."""
    cases = readers.golden_cases(spark, a.cases)
    elements = scoring.claim_elements(cases.select(F.col("case").alias("canonical"), "claims")).withColumnRenamed("canonical", "case")
    judged = judges.judge(elements, judges.specifications(cases.select("case", "spec")), "case")
    labels = cases.select("case", F.explode("labels").alias("l")).select("case", "l.element_substring", "l.expected")
    pairs = evaluation.matched_labels(labels, judged.select("case", "pos", "element", F.col("strict.verdict").alias("verdict")))
    pairs.write.mode("overwrite").parquet(f"{a.out}/pairs")
    pairs = spark.read.schema(pairs.schema).parquet(f"{a.out}/pairs")
    cells = evaluation.confusion(pairs)
    head = f"| Expected | {' | '.join(sorted(evaluation.LABELS))} |\n|{'---|' * 4}"
    markdown.write_table(markdown.matrix_rows(cells).coalesce(1).sortWithinPartitions("label"), head, f"{a.out}/matrix")
    evaluation.precision_recall(cells).write.mode("overwrite").parquet(f"{a.out}/labels")
    told = evaluation.accuracy(pairs).first()
    print(f"{told['agreed']} of {told['total']} labels", file=sys.stderr)
    return 0 if told["total"] and told["accuracy"] >= float(a.least) else 1


COMMANDS = {
    "normalize": (normalize, ["numbers", "out"]),
    "run": (run, ["numbers", "records", "spec", "out"]),
    "site": (site, ["records", "spec", "out"]),
    "worksheet": (worksheet, ["records", "out"]),
    "search": (find, ["brief", "records", "out"]),
    "watch": (watch, ["incoming", "state", "checkpoint"]),
    "snapshots": (snapshots, ["incoming", "state", "checkpoint"]),
    "monitor": (follow, ["incoming", "state", "checkpoint"]),
    "selfcheck": (selfcheck, ["numbers", "records", "spec", "out"]),
    "golden": (golden, ["cases", "out"]),
    "compare": (compare, ["labels", "records", "spec", "out"]),
}


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="claimforge")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (does, places) in COMMANDS.items():
        sub = commands.add_parser(name, help=does.__doc__)
        for place in places:
            sub.add_argument(place)
        if name in ("run", "site", "compare", "selfcheck", "worksheet"):
            sub.add_argument("--source", choices=sorted(readers.SOURCES), default="fixture")
        if name in ("run", "site", "compare", "selfcheck"):
            sub.add_argument("--judge", choices=JUDGES, default="keyless")
            sub.add_argument("--verdicts")
        if name == "search":
            sub.add_argument("--semantic", choices=["tfidf", *sorted(embedders.EMBEDDERS)])
        if name == "run":
            sub.add_argument("--legal")
        if name == "golden":
            sub.add_argument("--least", default="0.6")
        if name == "watch":
            sub.add_argument("--briefs")
            sub.add_argument("--date")
        if name == "site":
            sub.add_argument("--history")
            sub.add_argument("--size", default="500")
    a = parser.parse_args(argv)
    try:
        return COMMANDS[a.command][0](spark or SparkSession.builder.appName("claimforge").getOrCreate(), a)
    except Unconfigured as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
