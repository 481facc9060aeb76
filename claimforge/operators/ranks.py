"""Row numbers of a whole table in its order, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.folders import new_folder


def numbered(rows: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """``rows`` with their number from 1 on in ``order``, as a long.

    A range sort deals the rows to parts, which are written once with each row's part and place in it; the rows of each
    part are counted, and the counts of the parts before are added. What meets in one task is a row for each part.
    Rows that ``order`` leaves equal get numbers of their own in any order; an empty table stays empty.
    """
    spark = rows.sparkSession
    placed = rows.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    path = new_folder(spark, "ranks")
    placed.write.parquet(path)
    placed = spark.read.schema(placed.schema).parquet(path)
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")
