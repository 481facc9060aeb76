"""The monitor over fetched records: what an unbroken run leaves, and runs that break off between two writes."""

from __future__ import annotations

import json

import pytest
from claimforge.operators import judges
from claimforge.render import markdown
from claimforge.streaming import monitor

BATCHES = [
    [("A", "1", {"title": "t", "claims": ["c1", "c2"]}), ("B", "1", {"title": "b"})],
    [("A", "2", {"title": "t", "claims": ["c1", "c2"]}), ("A", "3", {"title": "u", "claims": ["c1"]}), ("B", "0", {"title": "late"}), ("C", "2", {"title": "c"})],
    [("A", "4", {"title": "t", "claims": ["c1", "c2"]}), ("B", "5", {"title": "b", "legal_status": "LAPSED"}), ("C", "6", {"title": "c"})],
]
CHANGES = {
    ("A", "3", "title", "t", "u", "changed", 1), ("A", "3", "claims[1]", "c2", None, "removed", 1), ("A", "4", "title", "u", "t", "changed", 2),
    ("A", "4", "claims[1]", None, "c2", "added", 2), ("B", "5", "legal_status", None, "LAPSED", "changed", 2),
}
RUNS = {(0, 2, 2, 0, 0), (1, 3, 1, 1, 1), (2, 3, 0, 2, 1)}


class Broken(Exception):
    pass


def come_in(folder, rows) -> None:
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(json.dumps({"canonical": c, "fetched_at": t} | r) for c, t, r in rows))


def left(spark, store) -> tuple:
    rows = lambda name, *c: {tuple(r) for r in spark.read.parquet(f"{store}/{name}").select(*c).collect()}
    return (
        rows("changes", "canonical", "fetched_at", "field", "before", "after", "kind", "batch"),
        rows("runs", "batch", "fetched", "new", "changed", "unchanged"),
        rows("snapshots", "canonical", "fetched_at", "batch"),
        sorted(map(str, rows("reports", "canonical", "batch"))),
    )


@pytest.mark.parametrize("breaks", [None, "snapshots", "changes", "reports"])
def test_monitor(spark, tmp_path, breaks):
    for k, batch in enumerate(BATCHES):
        come_in(tmp_path / "in", batch)
        if breaks and k:

            def fail(name: str) -> None:
                if name == breaks:
                    raise Broken

            with pytest.raises(Exception, match="Broken"):
                monitor.records(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/mark", fail).awaitTermination()
        monitor.records(spark, f"{tmp_path}/in", f"{tmp_path}/store", f"{tmp_path}/mark").awaitTermination()
    changes, runs, snapshots, reports = left(spark, tmp_path / "store")
    assert changes == CHANGES and runs == RUNS
    assert snapshots == {("A", "1", 0), ("B", "1", 0), ("A", "3", 1), ("C", "2", 1), ("A", "4", 2), ("B", "5", 2)}
    assert reports == ["('A', 1)", "('A', 2)", "('B', 2)"]


def test_percent_is_half_even(spark):
    scores = spark.createDataFrame([("A", "LOW", 62.5, 0.5, 63.5, 0.125, 4, 1, 2)], "canonical string, risk_band string, coverage double, low double, high double, least double, n_elements int, gap_count int, review_count int")
    assert "| 62% | 0%–64% | 12% | 1/4 | 2/4 |" in markdown.screening_rows(scores).first()["line"]


def test_two_specifications_are_an_error(spark):
    two = judges.specification(spark, "one").unionByName(judges.specification(spark, "two"))
    elements = spark.createDataFrame([("one thing",)], "element string")
    assert judges.judge(elements, judges.specification(spark, "one")).count() == 1
    with pytest.raises(Exception, match="more than one specification"):
        judges.judge(elements, two).collect()
