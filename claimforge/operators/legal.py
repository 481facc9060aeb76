"""Legal status from positional event lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# What revives a right, and what ends it, in the order tried; statuses that are final.
REVIVAL = r"REINSTAT|RESTOR|RE-ESTABLISH"
ENDS = ((r"\bEXPIR", "EXPIRED"), (r"\bLAPSE", "LAPSED"), (r"NON[- ]?PAYMENT", "LAPSED"), (r"\bREVOK", "REVOKED"), (r"\bWITHDRAW", "LAPSED"), (r"DEEMED TO BE WITHDRAWN", "LAPSED"))
FINAL = ("LAPSED", "EXPIRED", "REVOKED")


def effect(code: Column, description: Column) -> Column:
    """UNKNOWN for a revival, the status that an end sets, null for any other event."""
    text = F.upper(F.concat_ws(" ", F.coalesce(code, F.lit("")), F.coalesce(description, F.lit(""))))
    out = F.lit(None).cast("string")
    for pattern, status in reversed(ENDS):
        out = F.when(text.rlike(pattern), status).otherwise(out)
    return F.when(text.rlike(REVIVAL), "UNKNOWN").otherwise(out)


def evidence_line(date: Column, code: Column, description: Column) -> Column:
    """An event as it is quoted, without white space at the ends."""
    day = F.coalesce(F.nullif(date, F.lit("")), F.lit("?"))
    return strip(F.concat(day, F.lit(" "), F.coalesce(code, F.lit("")), F.lit(": "), F.coalesce(description, F.lit(""))))


def classify(events: DataFrame) -> DataFrame:
    """``canonical, status, evidence, needs_review`` from ``canonical, pos, date, code, description``: the last decisive
    event counts, by position; activity is never inferred. Only an end has evidence: a revival clears it."""
    rows = events.withColumn("effect", effect(F.col("code"), F.col("description")))
    line = evidence_line(F.col("date"), F.col("code"), F.col("description"))
    last = rows.groupBy("canonical").agg(F.max_by(F.struct("effect", line.alias("evidence")), F.when(F.col("effect").isNotNull(), F.col("pos"))).alias("last"), F.count("effect").alias("n"))
    status = F.when(F.col("n") > 0, F.col("last.effect")).otherwise("UNKNOWN")
    evidence = F.when(is_final(status), F.col("last.evidence"))
    return last.select("canonical", status.alias("status"), evidence.alias("evidence"), (status == "UNKNOWN").alias("needs_review"))


def apply(records: DataFrame, status: DataFrame) -> DataFrame:
    """Records with their legal status; one without a found status gets a note."""
    joined = records.join(status.select("canonical", F.col("status").alias("_s"), F.col("evidence").alias("_e")), "canonical", "left")
    note = F.when(F.col("_s").isNull(), "legal status: no record at the provider").when(F.col("_s") == "UNKNOWN", "legal status UNKNOWN: not determined from events").otherwise(F.concat(F.lit("legal status evidence: "), F.col("_e")))
    notes = F.concat(F.coalesce("notes", F.array().cast("array<string>")), F.array_compact(F.array(note))) if "notes" in records.columns else F.array_compact(F.array(note))
    keep = [c for c in records.columns if c not in ("notes", "legal_status")]
    old = F.col("legal_status") if "legal_status" in records.columns else F.lit(None).cast("string")
    return joined.select(*keep, F.coalesce("_s", old, F.lit("UNKNOWN")).alias("legal_status"), notes.alias("notes"))


def is_final(status: Column) -> Column:
    return status.isin(*FINAL)
