"""The seam for embedding models: texts to vectors in batches, and the similarity channel of a search over them."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming.monitor import new_folder
from .search import Brief, dense_cosine, fused, one_per_family, rank, similarity


class Embedder(Protocol):
    """A model, or a client of one. ``embed`` replies to a batch with the place of each text in it and its vector, in any
    order: the place counts, not the order."""

    def embed(self, texts: list[str]) -> Iterable[tuple[int, Sequence[float]]]: ...


class HashEmbedder:
    """Counts of words, dealt to ``dimensions`` by a hash: needs no model, tells texts apart by their words only."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> Iterable[tuple[int, Sequence[float]]]:
        for i, text in enumerate(texts):
            out = [0.0] * self.dimensions
            for word in re.findall(r"[a-z0-9]{2,}", text.lower()):
                out[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % self.dimensions] += 1.0
            yield i, out


#: Embedders by name, each made in the worker that uses it.
EMBEDDERS: dict[str, Callable[[], Embedder]] = {"hash": HashEmbedder}


def in_order(replies: Iterable[tuple[int, Sequence[float]]], n: int, length: int | None = None) -> list[list[float]]:
    """The vectors of ``n`` texts in the order of the texts. Every text needs just one, all of one length and finite."""
    out: list[list[float] | None] = [None] * n
    for place, vector in replies:
        if not 0 <= place < n or out[place] is not None:
            raise ValueError(f"a vector for text {place} of {n}, which is none of them or has one already")
        out[place] = [float(x) for x in vector]
        length = len(out[place]) if length is None else length
        if len(out[place]) != length or not all(map(math.isfinite, out[place])):
            raise ValueError(f"vector of text {place}: {len(out[place])} of {length} numbers, or some not finite")
    if missing := [i for i, v in enumerate(out) if v is None]:
        raise ValueError(f"no vector for texts {missing[:5]} of {n}")
    return out


def embedded(rows: DataFrame, text: str, make: Callable[[], Embedder], batch: int = 64, attempts: int = 2, name: str = "vector") -> DataFrame:
    """``rows`` with the vector (``array<double>``) of the column ``text``; null counts as empty.

    ``make`` is called once a task, in its worker, so a model is loaded there and never travels. Texts go in batches of
    ``batch``; a batch that fails is tried ``attempts`` times in all, then its error ends the task, which Spark runs
    again. Nothing is left out and no vector is made up.
    """

    @F.pandas_udf("array<double>")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, length = None, None
        for part in parts:
            model = model or make()
            texts, out = part.fillna("").tolist(), []
            for at in range(0, len(texts), batch):
                some = texts[at : at + batch]
                for k in range(max(1, attempts)):
                    try:
                        found = in_order(model.embed(some), len(some), length)
                        break
                    except Exception:
                        if k + 1 >= max(1, attempts):
                            raise
                length = len(found[0])
                out += found
            yield pd.Series(out, index=part.index, dtype=object)

    return rows.withColumn(name, ask(F.col(text)))


def dense_similarity(docs: DataFrame, query: str, make: Callable[[], Embedder], id_col: str = "doc_id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """``id, semantic``: cosine of every document's vector with the query's, 0 at least, and 0 for a zero vector.

    Vectors are asked for once: the cosines are written and read again, as a fusion needs their largest value first.
    """
    spark = docs.sparkSession
    asked = embedded(spark.createDataFrame([(query,)], "q string"), "q", make, name="_q").select("_q")  # one row
    vectors = embedded(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")), "_text", make, batch, name="_v").select("id", "_v")
    told = vectors.crossJoin(F.broadcast(asked)).select("id", F.size("_v").alias("_a"), F.size("_q").alias("_b"), dense_cosine(F.col("_v"), F.col("_q")).alias("semantic"))
    agrees = F.when(F.col("_a") != F.col("_b"), F.raise_error(F.lit("vectors of unlike lengths")).cast("double")).otherwise(F.col("semantic"))
    path = new_folder(spark, "cosines")
    out = told.select("id", agrees.alias("semantic"))
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def both_channels(rows: DataFrame, brief: Brief, make: Callable[[], Embedder] | None = None) -> DataFrame:
    """``rank`` of a search's publications, one per family, with ``semantic`` and ``combined`` (each channel over its
    largest value, and their mean, to three digits) and ``notes`` where the two are far apart, which also asks for review.

    The text of a publication is its titles and abstracts; without ``make`` the channel is TF-IDF over the candidates.
    """
    best = one_per_family(rank(rows, brief))
    said = lambda c: F.array_join(F.transform(F.coalesce(c, F.array()), lambda x: x["text"]), " ")
    texts = rows.dropDuplicates(["publication_number"]).select("publication_number", F.concat_ws(" ", F.nullif(said(F.col("title_localized")), F.lit("")), F.nullif(said(F.col("abstract_localized")), F.lit(""))).alias("text"))
    texts = texts.join(best.select("publication_number"), "publication_number", "left_semi")
    near = similarity(texts, brief.query_text, "publication_number") if make is None else dense_similarity(texts, brief.query_text, make, "publication_number")
    both = fused(best.select(F.col("publication_number").alias("id"), "score"), near).withColumnRenamed("needs_review", "_apart")
    top = both.agg(F.coalesce(F.nullif(F.max("semantic"), F.lit(0.0)), F.lit(1.0)).alias("_most"), F.coalesce(F.nullif(F.max("score"), F.lit(0)), F.lit(1)).alias("_best"))
    both = both.crossJoin(F.broadcast(top))
    shown = lambda c, most: F.format_string("%.2f", F.bround(F.col(c) / F.col(most), 2))
    note = F.when(F.col("_apart"), F.concat(F.lit("channels apart: keywords "), shown("score", "_best"), F.lit(", meaning "), shown("semantic", "_most"), F.lit("; other words or another field, check the text")))
    both = both.select(F.col("id").alias("publication_number"), F.bround(F.col("semantic") / F.col("_most"), 3).alias("semantic"), F.bround("combined", 3).alias("combined"), F.array_compact(F.array(note)).alias("notes"), "_apart")
    out = best.join(both, "publication_number").withColumn("needs_review", F.col("needs_review") | F.col("_apart")).drop("_apart")
    return out.orderBy(F.desc("combined"), "publication_number")
