"""Terms of documents are taken apart once, however often they are weighed."""

from __future__ import annotations

from claimforge.operators import search
from claimforge.plans import catalogue

SF = "/root/testdata/sf0.001"


def planned(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_weights_read_written_terms_and_send_none_to_the_driver(spark):
    for name in ("tfidf_weights", "semantic_scores"):
        plan = planned(catalogue.queries()[name](spark, SF))
        assert plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 0, name  # no use takes the texts apart again
        assert "struct<id:bigint,term:string,tf:bigint>" in plan, name
    assert "BroadcastHashJoin" not in planned(catalogue.queries()["tfidf_weights"](spark, SF))


def test_weights_of_rows_that_share_an_id_or_have_none(spark):
    docs = spark.createDataFrame([(1, "red red plate"), (1, "red box"), (None, "red rail"), (2, None), (3, "a 特許 bolt")], "doc_id long, text string")
    weights, _ = search.tfidf(docs, "red bolt")
    found = {(r["id"], r["term"]): r["weight"] for r in weights.collect()}
    assert set(found) == {(1, "red"), (1, "plate"), (1, "box"), (3, "特許"), (3, "bolt")}
    for i in (1, 3):
        assert abs(sum(w * w for (k, _), w in found.items() if k == i) - 1) < 1e-12
    scores = {(r["id"], round(r["semantic"], 6) > 0) for r in search.similarity(docs, "red bolt").collect()}
    assert scores == {(1, True), (None, False), (2, False), (3, True)}
