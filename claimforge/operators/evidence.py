"""The best evidence for many texts over a corpus: rare tokens first, and only sentences that can still win are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..streaming.monitor import new_folder

#: Rarest tokens of a text that make its first candidates.
FIRST = 2


def ranked_tokens(own: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``key, token, rank, size``: the tokens of a text that the corpus has, the rarest first, and how many they are."""
    by = Window.partitionBy(key)
    rows = own.join(counts, "token")
    return rows.withColumn("rank", F.row_number().over(by.orderBy("n", "token"))).withColumn("size", F.count(F.lit(1)).over(by)).drop("n")


def counted(postings: DataFrame, own: DataFrame, prefix: DataFrame, key: str) -> DataFrame:
    """``key, doc_id, pos, n`` of the best sentence for each text among those with a token of its ``prefix``: most common
    tokens, then the smallest place. The count is of all the text's tokens."""
    met = postings.join(prefix.select(key, "token"), "token").select(key, "doc_id", "pos").distinct()
    common = met.join(postings, ["doc_id", "pos"]).join(own, [key, "token"]).groupBy(key, "doc_id", "pos").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct("n", -F.col("doc_id"), -F.col("pos"))
    return common.groupBy(key).agg(F.max_by(F.struct("doc_id", "pos", "n"), place).alias("b")).select(key, "b.*")


def prefixes(ranked: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The tokens of which a sentence must have one to be as good as what is found: with ``n`` of ``size`` tokens in
    common it lacks ``size - n``, so one of the ``size - n + 1`` rarest is there."""
    return ranked.join(found.select(key, F.col("n").alias("least")), key).filter("rank <= size - least + 1").select(key, "token")


def best_sentences(sentences: DataFrame, asked: DataFrame, key: str, text: str, first: int = FIRST) -> DataFrame:
    """``key, doc_id, pos, n`` for each text of ``asked`` that has a token in common with a sentence (``doc_id, pos,
    sentence``): the one with most of them, of equals the first by document and place.

    The corpus is read once, for the postings of tokens that are asked for, which are written to the shared folder.
    Sentences with one of a text's rarest tokens are counted first; what the best of them has in common bounds which
    further ones can win, and those all have one of the rarer tokens. So the postings of frequent tokens are met by
    sentences in hand only, never by every text that has them. No candidate is dropped; texts that repeat a key are one.
    """
    spark = sentences.sparkSession
    own = asked.select(key, F.explode(tokens(F.col(text))).alias("token")).distinct()
    rows = sentences.select("doc_id", "pos", F.explode(tokens(F.col("sentence"))).alias("token"))
    path = new_folder(spark, "postings")
    rows.join(own.select("token").distinct(), "token", "left_semi").write.parquet(path)
    postings = spark.read.schema(rows.schema).parquet(path)
    ranked = ranked_tokens(own, postings.groupBy("token").agg(F.count(F.lit(1)).alias("n")), key)
    found = counted(postings, own, ranked.filter(F.col("rank") <= first), key)
    return counted(postings, own, prefixes(ranked, found, key), key)
