"""Exact dedup by a tree merge of sorted digest runs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut
from .skew import salted_join

KEY = ("digest", "n_bytes", "check")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: id, SHA-256, and two witnesses (bytes, a second hash) that verify equal digests."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.sha2(text, 256).alias("digest"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )


def merge_runs(rows: DataFrame, fan_in: int = 8) -> DataFrame:
    """Digest groups with ``keep_id`` (largest id) and ``group_size``, by rounds of multiway merges.

    Every task's digests are a run, sorted and merged before they are sent. A round sends ``fan_in`` runs to their
    parent, dealt by run and digest so that no run, however long, is one task's work. There the rows are sorted and
    neighbours with one digest and the same witnesses merged: the surviving id is kept as a struct, which Spark merges
    in sorted order only, so the sort is part of the plan. Only that id and a count go on to the next round. A text with
    any number of copies therefore costs one row per run, not one per copy.
    """
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    rounds = max(1, math.ceil(math.log(max(partitions, 2), fan_in)))
    runs = rows.select(F.pmod(F.spark_partition_id(), F.lit(fan_in**rounds)).alias("run"), *KEY, "id")
    level = runs.groupBy("run", *KEY).agg(F.max(F.struct("id")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    for _ in range(rounds):
        sent = level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        sent = sent.repartition("run", "digest")
        level = sent.groupBy("run", *KEY).agg(F.max("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    return level.select(*KEY, F.col("keep.id").alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their bytes are; null counts as empty. Of a group the largest id stays. Rows whose id is null
    never stay while the group has another id, and are not kept otherwise either (``keep_id`` null, ``kept`` false).
    Repeated rows (same id, same text) all count in ``group_size`` and all carry ``kept`` true, as nothing tells them
    apart. An empty table gives an empty result. Other columns of ``docs`` are not read, whatever their names.
    """
    rows = digests(docs, id_col, text_col)
    groups = cut(merge_runs(rows, fan_in), "exact-groups")
    joined = salted_join(rows, groups, list(KEY), groups.withColumnRenamed("group_size", "n"))
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of repeated rows, one."""
    marks = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_keep")).distinct()
    return docs.join(marks, docs[id_col] == marks["_keep"], "left_semi").dropDuplicates([id_col])
