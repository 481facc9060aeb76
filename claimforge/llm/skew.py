"""Look-ups by a key that may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut

#: A key with more than one in so many of all rows is dealt to several tasks; there are fewer such keys than this.
PARTS = 512


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], counts: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """``rows`` inner-joined with ``table``, which holds one row per key.

    ``counts`` (keys and ``n``, the rows of each key) is worked out where it isn't known. A key with over one in
    ``parts`` of the rows gets as many salts as it has such shares, and its row of the table a copy for each: fewer than
    ``2 * parts`` copies in all, and fewer than ``parts`` hot keys to broadcast, whatever the number of rows.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts.select(*keys, "n")
    size = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most")).first()
    share = (size["total"] or 0) / parts
    if (size["most"] or 0) <= max(share, parts):
        return rows.join(table, keys)
    hot = counts.filter(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("_salts"))
    hot = F.broadcast(cut(hot, "skew-hot"))
    salts = F.coalesce("_salts", F.lit(1))
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), salts).cast("int")
    dealt = rows.join(hot, keys, "left").withColumn("_salt", salt).drop("_salts")
    copied = table.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")
