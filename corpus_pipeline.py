"""A corpus from raw documents to packed sequences: language ID, line dedup, n-gram join, mixing, packing.

Every stage takes an empty table and gives an empty one, reads ``doc_id``, ``text``, ``lang``, ``source`` and ``n_chars``
only, and passes on the columns that it got, whatever their names. Null, empty and letterless texts go in the first stage;
texts of any length are read whole. Rows with a null id and rows that share an id are documents of their own, with two
exceptions: to line dedup rows equal in id and text are one document and share its fate, and the n-gram join keeps all
rows of an id if it keeps one of them. Of documents that tie in a group of near copies the smallest id stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimforge.llm import language, line_dedup, mixing, ngram_join, packing
from claimforge.llm.scratch import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no letter) go; a missing ``lang`` becomes the predicted one."""
    return language.determined(docs, language.profiles(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier document's go from the texts, and documents of nothing else."""
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (5-word shingles, similarity 0.8) the document with the smallest id stays."""
    found = ngram_join.ngram_join(docs, n=5, percent=80)
    stay = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay"))
    return docs.join(stay, F.col("doc_id").eqNullSafe(F.col("_stay")), "left_semi")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_join", join_ngrams),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express the learned, fuzzy and packing stages; the tests hold each against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
