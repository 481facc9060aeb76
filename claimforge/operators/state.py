"""Snapshots: content hashes, what changed, histories and field differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash

# The fields whose content counts, and the order in which single fields are compared.
TRACKED = ("abstract", "assignee", "canonical", "claims", "family_id", "legal_status", "number", "office", "pub_date", "title")
SCALARS = ("legal_status", "family_id", "abstract", "assignee", "number", "office", "pub_date", "title")


def hashed(records: DataFrame, fields: tuple[str, ...] = TRACKED) -> DataFrame:
    """Records with their content hash."""
    return records.withColumn("content_hash", content_hash(**{f: F.col(f) for f in fields}))


def changes(snapshots: DataFrame) -> DataFrame:
    """The snapshots that are kept of ``canonical, fetched_at, content_hash, ...``: those unlike the one before, so
    A, B, A keeps three. ``is_new`` marks the first."""
    order = Window.partitionBy("canonical").orderBy("fetched_at")
    before = F.lag("content_hash").over(order)
    rows = snapshots.withColumn("is_new", before.isNull()).withColumn("_same", before.eqNullSafe(F.col("content_hash")))
    return rows.filter("NOT _same").drop("_same")


def latest(snapshots: DataFrame) -> DataFrame:
    """The last snapshot of each record: one row per record is aggregated, none sorted."""
    rest = [c for c in snapshots.columns if c != "canonical"]
    out = snapshots.groupBy("canonical").agg(F.max_by(F.struct(*rest), "fetched_at").alias("s"))
    return out.select("canonical", "s.*")


def to_save(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New hashed records with ``is_new`` and ``changed`` against the latest stored snapshot; equal ones are both false."""
    last = latest(stored).select("canonical", F.col("content_hash").alias("_last"))
    rows = new.join(last, "canonical", "left")
    return rows.withColumn("is_new", F.col("_last").isNull()).withColumn("changed", F.col("_last").isNotNull() & (F.col("_last") != F.col("content_hash"))).drop("_last")


def adjacent(snapshots: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Each snapshot but the first with the one before: ``canonical, fetched_at, old, new``."""
    order = Window.partitionBy("canonical").orderBy("fetched_at")
    row = F.struct(*fields)
    rows = snapshots.select("canonical", "fetched_at", F.lag(row).over(order).alias("old"), row.alias("new"))
    return rows.filter("old IS NOT NULL")


def _scalar(field: str) -> Column:
    old, new = F.col(f"old.{field}").cast("string"), F.col(f"new.{field}").cast("string")
    return F.when(~old.eqNullSafe(new), F.struct(F.lit(field).alias("field"), old.alias("before"), new.alias("after"), F.lit("changed").alias("kind")))


def scalar_changes(pairs: DataFrame, fields: tuple[str, ...] = SCALARS) -> DataFrame:
    """``canonical, fetched_at, field, before, after, kind`` of the single fields that differ, nulls compared as values."""
    found = F.array_compact(F.array(*[_scalar(f) for f in fields]))
    return pairs.select("canonical", "fetched_at", F.inline(found))


def claim_changes(pairs: DataFrame) -> DataFrame:
    """Claims compared place by place: changed, added or removed."""
    old, new = F.col("old.claims"), F.col("new.claims")
    longest = F.greatest(F.coalesce(F.size(old), F.lit(0)), F.coalesce(F.size(new), F.lit(0)))
    rows = pairs.select("canonical", "fetched_at", old.alias("o"), new.alias("n"), F.explode(F.when(longest > 0, F.sequence(F.lit(0), longest - 1))).alias("i"))
    before, after = F.get("o", "i"), F.get("n", "i")
    kind = F.when(before.isNull(), "added").when(after.isNull(), "removed").otherwise("changed")
    rows = rows.select("canonical", "fetched_at", F.concat(F.lit("claims["), F.col("i").cast("string"), F.lit("]")).alias("field"), before.alias("before"), after.alias("after"), kind.alias("kind"))
    return rows.filter(~F.col("before").eqNullSafe(F.col("after")))


def by_field(found: DataFrame) -> DataFrame:
    """Number of changes per record and base field."""
    return found.groupBy("canonical", F.split("field", r"\[")[0].alias("base")).agg(F.count(F.lit(1)).alias("n"))
