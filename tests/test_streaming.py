"""The watch and the snapshot monitor over arriving files."""

import json

from claimforge.streaming import monitor


def drop(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(map(json.dumps, rows)))


def test_watch_reports_new_hits_once(spark, tmp_path):
    state, mark, files = str(tmp_path / "state"), str(tmp_path / "mark"), tmp_path / "in"
    hit = lambda day, pub: {"theme": "t", "run_date": day, "pub": pub}
    drop(files, "1.json", [hit("2024-01-01", "A"), hit("2024-01-01", "B")])
    monitor.watch(spark, str(files), state, mark).awaitTermination()
    drop(files, "2.json", [hit("2024-01-08", "B"), hit("2024-01-08", "C")])
    monitor.watch(spark, str(files), state, mark).awaitTermination()
    monitor.watch(spark, str(files), state, mark).awaitTermination()
    seen = spark.read.parquet(f"{state}/seen").collect()
    assert {(r["pub"], r["first_seen"]) for r in seen} == {("A", "2024-01-01"), ("B", "2024-01-01"), ("C", "2024-01-08")}
    runs = {r["run_date"]: (r["hits"], r["new"]) for r in spark.read.parquet(f"{state}/runs").collect()}
    assert runs == {"2024-01-01": (2, 2), "2024-01-08": (2, 1)}


def test_snapshots_keep_changes_only(spark, tmp_path):
    store, mark, files = str(tmp_path / "store"), str(tmp_path / "mark"), tmp_path / "in"
    for k, value in enumerate(("a", "a", "b")):
        drop(files, f"{k}.json", [{"canonical": "X", "fetched_at": f"2024-01-0{k + 1}", "content_hash": value}])
        monitor.snapshots(spark, str(files), store, mark).awaitTermination()
    kept = sorted((r["fetched_at"], r["content_hash"]) for r in spark.read.parquet(store).collect())
    assert kept == [("2024-01-01", "a"), ("2024-01-03", "b")]


def test_snapshots_of_one_batch_are_compared_in_turn(spark, tmp_path):
    store, mark, files = str(tmp_path / "store"), str(tmp_path / "mark"), tmp_path / "in"
    shot = lambda day, value: {"canonical": "X", "fetched_at": f"2024-01-0{day}", "content_hash": value}
    drop(files, "0.json", [shot(1, "a")])
    monitor.snapshots(spark, str(files), store, mark).awaitTermination()
    drop(files, "1.json", [shot(2, "a"), shot(3, "b"), shot(4, "a"), shot(5, "a")])
    monitor.snapshots(spark, str(files), store, mark).awaitTermination()
    kept = sorted((r["fetched_at"], r["content_hash"]) for r in spark.read.parquet(store).collect())
    assert kept == [("2024-01-01", "a"), ("2024-01-03", "b"), ("2024-01-04", "a")]
