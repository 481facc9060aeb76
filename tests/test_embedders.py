"""Embedders: replies put in order, bad replies refused, models made in the worker, and the fusion with keywords."""

import json
import math

import pytest
from claimforge import commands
from claimforge.operators import embedders
from claimforge.operators.embedders import HashEmbedder, both_channels, dense_similarity, embedded, in_order
from claimforge.operators.search import Brief

DOCS = [(i, t) for i, t in enumerate(["red widget", "Red red WIDGET rail", "", None, "blue motor", "x" * 200_000 + " red", "red widget", "äöü 漢字"])]


class Shuffled(HashEmbedder):
    """Replies from the last text to the first; the first call of each batch fails."""

    def __init__(self):
        super().__init__(64)
        self.failed = set()

    def embed(self, texts):
        if tuple(texts) not in self.failed:
            self.failed.add(tuple(texts))
            raise ConnectionError("busy")
        return list(super().embed(texts))[::-1]


class Broken:
    def embed(self, texts):
        return [(0, [1.0])] * len(texts)


def test_replies_are_put_in_order_or_refused():
    assert in_order([(1, [2]), (0, [1])], 2) == [[1.0], [2.0]]
    assert in_order([], 0) == []
    for replies, n in (([(0, [1.0])], 2), ([(0, [1.0]), (0, [2.0])], 2), ([(2, [1.0])], 1), ([(-1, [1.0])], 1), ([(0, [1.0]), (1, [1.0, 2.0])], 2), ([(0, [math.nan])], 1)):
        with pytest.raises(ValueError):
            in_order(replies, n)


def test_vectors_are_those_of_each_text(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    wanted = {i: dict(HashEmbedder(64).embed([t or ""]))[0] for i, t in DOCS}
    assert {r["doc_id"]: r["vector"] for r in embedded(rows, "text", Shuffled, batch=2).collect()} == wanted
    assert embedded(rows.limit(0), "text", Shuffled).collect() == []
    with pytest.raises(Exception, match="has one already"):
        embedded(rows.filter("doc_id < 2").coalesce(1), "text", Broken).collect()


def test_similarity_is_the_cosine(spark):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    vector = lambda t: dict(HashEmbedder().embed([t or ""]))[0]
    query = "a red widget"
    q = vector(query)
    for r in dense_similarity(rows, query, HashEmbedder, batch=3).collect():
        v = vector(DOCS[r["id"]][1])
        norm = math.sqrt(sum(x * x for x in v)) * math.sqrt(sum(x * x for x in q))
        assert r["semantic"] == pytest.approx(sum(a * b for a, b in zip(v, q, strict=True)) / (norm or 1.0))
    assert dense_similarity(rows, "", HashEmbedder).agg({"semantic": "max"}).first()[0] == 0.0


def publication(number, title, abstract, family):
    text = lambda t: [{"text": t, "language": "en"}] if t else []
    return {"publication_number": number, "country_code": "US", "publication_date": 20200101, "family_id": family, "title_localized": text(title), "abstract_localized": text(abstract), "claims_localized": [], "cpc": []}


def test_channels_far_apart_are_noted(spark, tmp_path):
    rows = [publication("A", "Widget", "nothing else at all in common", "1"), publication("B", "", "a widget of red steel for the rail carriage", "2"), publication("C", "Widget", "older", "1")]
    (tmp_path / "pubs.json").write_text("\n".join(map(json.dumps, rows)))
    brief = {"name": "w", "keywords": [["widget"]], "description": "red steel rail carriage"}
    (tmp_path / "brief.json").write_text(json.dumps(brief))
    assert set(embedders.EMBEDDERS) == {"hash"}
    for semantic in ("hash", "tfidf"):
        assert commands.main(["search", f"{tmp_path}/brief.json", f"{tmp_path}/pubs.json", f"{tmp_path}/{semantic}", "--semantic", semantic], spark) == 0
        got = {r["number"]: r["note"] for r in spark.read.option("header", True).csv(f"{tmp_path}/{semantic}/candidates").collect()}
        assert set(got) == {"B", "C"} and "combined 0.667" in got["B"] and "channels apart: keywords 0.33, meaning 1.00" in got["B"]
        assert "keywords 1.00, meaning 0.00" in got["C"]
    from claimforge.sources import readers

    out = both_channels(readers.publications(spark, f"{tmp_path}/pubs.json"), Brief(keywords=(("widget",),), description=brief["description"]), HashEmbedder).collect()
    assert [(r["publication_number"], r["siblings"], r["needs_review"]) for r in out] == [("B", [], True), ("C", ["A"], True)]
