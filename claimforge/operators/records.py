"""Records: mapping, look-ups by number, fallback chains, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import claims, iso_date, localized


def from_publications(rows: DataFrame) -> DataFrame:
    """Publication rows as records: English texts first, dates with dashes, claims one by one, what is missing noted."""
    parts = F.split("publication_number", "-")
    title, abstract = localized(F.col("title_localized")), localized(F.col("abstract_localized"))
    split_claims = claims(localized(F.col("claims_localized")))
    note = lambda when, text: F.when(when, F.lit(text))
    return rows.filter("publication_number IS NOT NULL AND publication_number <> ''").select(
        F.col("publication_number").alias("canonical"),
        F.when(F.size(parts) > 1, parts[0]).otherwise(F.col("country_code")).alias("office"),
        F.when(F.size(parts) > 1, parts[1]).otherwise(F.col("publication_number")).alias("number"),
        title.alias("title"),
        abstract.alias("abstract"),
        split_claims.alias("claims"),
        F.get(F.col("assignee_harmonized.name"), F.lit(0)).alias("assignee"),
        iso_date(F.col("publication_date")).alias("pub_date"),
        F.col("family_id").cast("string").alias("family_id"),
        F.array_compact(F.array(note(title == "", "title missing"), note(abstract == "", "abstract missing"), note(F.size(split_claims) == 0, "claims missing"))).alias("notes"),
    )


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with an equal key the one that came last."""
    last = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k")


def fetch(numbers: DataFrame, source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers with their records, and the numbers that the source doesn't have."""
    found = numbers.join(source, "canonical")
    return found, numbers.join(source.select("canonical"), "canonical", "left_anti")


def two_key(numbers: DataFrame, source: DataFrame) -> DataFrame:
    """Records by canonical number, else by office and number. ``numbers``: canonical, office, number."""
    own = source.withColumn("_alt", F.concat_ws(":", "office", "number"))
    direct = numbers.select("canonical").join(source, "canonical")
    missed = numbers.join(source.select("canonical"), "canonical", "left_anti").withColumn("_alt", F.concat_ws(":", "office", "number"))
    other = missed.select(F.col("canonical").alias("asked"), "_alt").join(own, "_alt").drop("_alt")
    return direct.withColumn("asked", F.col("canonical")).unionByName(other)


def fallback(numbers: DataFrame, sources: list[tuple[str, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """The first source that has a number, and the trail of each look-up: ``canonical, seq, source, outcome``.

    A source is asked only for what those before it missed.
    """
    left, hits, trails = numbers.select("canonical").distinct(), [], []
    for seq, (name, table) in enumerate(sources):
        asked = left.join(table.select("canonical").distinct().withColumn("_hit", F.lit(True)), "canonical", "left")
        trails.append(asked.select("canonical", F.lit(seq).alias("seq"), F.lit(name).alias("source"), F.when(F.col("_hit"), "hit").otherwise("miss").alias("outcome")))
        hits.append(left.join(table, "canonical").withColumn("source", F.lit(name)))
        left = asked.filter("_hit IS NULL").select("canonical")
    found, trail = hits[0], trails[0]
    for h, t in zip(hits[1:], trails[1:], strict=True):
        found, trail = found.unionByName(h), trail.unionByName(t)
    return found, trail


def summaries(records: DataFrame) -> DataFrame:
    """One line, claim count, first claim and notes of each record."""
    parts = ("office", "number", "assignee", "pub_date", "legal_status")
    have = [F.nullif(F.col(p), F.lit("")) for p in parts if p in records.columns]
    return records.select(
        "canonical",
        F.concat_ws(" | ", *have).alias("one_line"),
        F.coalesce(F.size("claims"), F.lit(0)).cast("bigint").alias("claim_count"),
        F.coalesce(F.get("claims", F.lit(0)), F.lit("")).alias("independent_claim"),
        F.when(F.coalesce(F.size("claims"), F.lit(0)) <= 0, "no claims in the record").otherwise("").alias("note"),
    )
