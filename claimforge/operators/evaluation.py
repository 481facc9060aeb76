"""Judging the judges: labels against verdicts, confusion, precision and recall; and gates over a run."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

LABELS = ("MATCH", "MISSING", "UNCLEAR")


def matched_labels(labels: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each label (``case, element_substring, expected``) with the first verdict (``case, pos, element, verdict``) whose
    element contains it in any case, or MISSING if none does."""
    rows = labels.join(verdicts.select(F.col("case").alias("_c"), "pos", "element", "verdict"), (F.col("case") == F.col("_c")) & F.contains(F.lower("element"), F.lower("element_substring")), "left")
    first = Window.partitionBy("case", "element_substring").orderBy(F.col("pos").asc_nulls_last())
    rows = rows.withColumn("_k", F.row_number().over(first)).filter("_k = 1")
    return rows.select("case", "element_substring", "expected", F.coalesce("verdict", F.lit("MISSING")).alias("actual")).withColumn("agreed", F.col("expected") == F.col("actual"))


def confusion(pairs: DataFrame) -> DataFrame:
    """All nine cells of expected by actual."""
    spark = pairs.sparkSession
    cells = spark.createDataFrame([(a, b) for a in LABELS for b in LABELS], "expected string, actual string")
    counts = pairs.groupBy("expected", "actual").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(cells).join(counts, ["expected", "actual"], "left").select("expected", "actual", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def precision_recall(cells: DataFrame) -> DataFrame:
    """Per label; 0 where nothing is there to divide by."""
    same = F.when(F.col("expected") == F.col("actual"), F.col("n")).otherwise(0)
    told = cells.groupBy(F.col("actual").alias("label")).agg(F.sum(same).alias("hit"), F.sum("n").alias("told"))
    real = cells.groupBy(F.col("expected").alias("label")).agg(F.sum("n").alias("real"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)).cast("double")
    return told.join(real, "label").select("label", share("hit", "told").alias("precision"), share("hit", "real").alias("recall"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.coalesce(F.avg(F.col("agreed").cast("int")), F.lit(0.0)).alias("accuracy"), F.count_if("agreed").alias("agreed"), F.count(F.lit(1)).alias("total"))


def gate(name: str, rows: DataFrame, bad: Column) -> DataFrame:
    """One row: whether no inspected row is bad. A gate reports and never raises."""
    wrong = F.count_if(F.coalesce(bad, F.lit(True)))
    return rows.agg(wrong.alias("violations"), F.count(F.lit(1)).alias("checked")).select(F.lit(name).alias("gate"), (F.col("violations") == 0).alias("passed"), "checked", "violations")


def rules(spec_text: str, disclaimer: str) -> dict[str, dict[str, Column]]:
    """By table of a run its gates, and what a row that breaks one looks like: ``numbers`` as normalised, ``records`` with
    source, ``verdicts`` with span, ``reports`` with text, and ``saved_twice``, what a second save of the same records
    would write."""
    weak = (F.col("confidence") < 0.85) | (F.col("office") == "UNKNOWN")
    return {
        "numbers": {"G-NORMALIZE-REVIEW": weak & ~F.col("needs_review")},
        "records": {"G-PROVENANCE": F.coalesce(F.col("source"), F.lit("")) == ""},
        "verdicts": {
            "G-NO-GUESS": (F.col("verdict") == "MATCH") & F.col("span").isNull(),
            "G-EVIDENCE-SUBSTRING": F.col("span").isNotNull() & ~F.contains(F.lit(spec_text), F.col("span")),
            "G-UNCLEAR-REVIEW": (F.col("verdict") == "UNCLEAR") & ~F.col("needs_review"),
        },
        "reports": {"G-DISCLAIMER": ~F.contains(F.col("text"), F.lit(disclaimer))},
        "saved_twice": {"G-SNAPSHOT-STABLE": F.col("is_new") | F.col("changed")},
    }


def gates(numbers: DataFrame, records: DataFrame, verdicts: DataFrame, spec_text: str, reports: DataFrame, disclaimer: str, saved_twice: DataFrame) -> DataFrame:
    """The gate table of a run: ``gate, passed, checked, violations``; see ``rules`` for the tables."""
    tables = {"numbers": numbers, "records": records, "verdicts": verdicts, "reports": reports, "saved_twice": saved_twice}
    every = [gate(name, tables[t], bad) for t, own in rules(spec_text, disclaimer).items() for name, bad in own.items()]
    return reduce(DataFrame.unionByName, every)


def written_and_gated(tables: dict[str, DataFrame], spec_text: str, disclaimer: str, out: str) -> list[tuple[str, bool, int, int]]:
    """Write the tables of a run as Parquet folders of ``out``, and ``(gate, passed, checked, violations)`` of each gate.

    The gates are metrics observed while the tables are written, so none of them costs a pass of its own. A rule that
    can't be told of a row counts as broken.
    """
    found = []
    for table, own in rules(spec_text, disclaimer).items():
        seen = Observation(table)
        metrics = [F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in own.items()]
        tables[table].observe(seen, F.count(F.lit(1)).alias("checked"), *metrics).write.mode("overwrite").parquet(f"{out}/{table}")
        told = seen.get
        found += [(name, told[name] == 0, told["checked"], told[name]) for name in own]
    return found


def gate_report(found: list[tuple[str, bool, int, int]]) -> str:
    """The outcome of a run's gates as JSON."""
    named = [dict(zip(("gate", "passed", "checked", "violations"), row, strict=True)) for row in found]
    return json.dumps({"passed": all(row[1] for row in found), "gates": named}, indent=1)


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One hash over all rows, whatever their order: sums of row hashes, so that no list of rows is gathered."""
    h = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(8)]
    return rows.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *[F.coalesce(p, F.lit("0")) for p in parts]), 256).alias("fingerprint"))


def token_costs(docs: DataFrame, text: Column, per_thousand: float = 0.003) -> DataFrame:
    """Documents, estimated tokens, their whole average, and the price."""
    from ..functions.text import token_estimate

    return docs.select(token_estimate(text).alias("t")).agg(F.count(F.lit(1)).alias("docs"), F.sum("t").alias("tokens")).select(
        "docs", "tokens", F.floor(F.col("tokens") / F.nullif("docs", F.lit(0))).cast("bigint").alias("average"), (F.col("tokens") / 1000 * per_thousand).alias("cost")
    )
