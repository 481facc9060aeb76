"""Cosines of every vector with every query, by blocks."""

from __future__ import annotations

import math

from claimforge.operators import search
from claimforge.plans import catalogue
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_cosines_of_blocks_are_those_of_pairs(spark):
    vectors = [[1.0, 2.0], [2.0, -1.0], None, [0.0, 0.0], [], [1.0, None], [1.0, 2.0, 3.0], [float("nan"), 1.0], [float("inf"), 1.0], [-1.0, -2.0], [1e-3, 5.0]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(None, [1.0, 1.0]), (3, [4.0, 4.0])], "vec_id long, embedding array<float>")
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plain = rows.crossJoin(asked).select("vec_id", "query_id", search.dense_cosine(F.col("embedding"), F.col("q")).alias("cosine"))
    told = lambda df: sorted((str(r[0]), str(r[1]), "nan" if math.isnan(r[2]) else f"{r[2]:.9f}") for r in df.collect())
    want = told(plain)
    for block, most in ((512, 2048), (3, 4), (1, 1)):
        assert told(search.cosines(rows, asked, block, most)) == want
    assert search.cosines(rows, asked.limit(0)).count() == 0
    assert search.cosines(rows.limit(0), asked).count() == 0


def test_no_cosine_is_worked_out_pair_by_pair(spark):
    assert "aggregate(" not in plan_of(catalogue.queries()["embedding_cosine"](spark, SF)).lower().replace("aggregate [", "")
