"""Streams over arriving files: new hits of watched searches, changed snapshots, and records that are monitored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.folders import new_folder
from ..operators.percolate import percolate
from ..operators.search import Brief, absorb, split_seen
from ..operators.state import TRACKED, adjacent, changes, claim_changes, hashed, latest, scalar_changes
from ..render import markdown
from ..sources.readers import PUBLICATION, RECORD

HITS = "theme string, run_date string, pub string"
SNAPSHOT = "canonical string, fetched_at string, content_hash string"
#: Folders of the store: a batch reads those of its own records only.
SHARDS = 256


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A state table, empty at first."""
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def new_hits(hits: DataFrame) -> DataFrame:
    """A stream of hits, each theme and publication once, at its first; the state keeps every pair, as a watch must."""
    return hits.dropDuplicates(["theme", "pub"])


def watch(spark: SparkSession, incoming: str, state: str, checkpoint: str, briefs: list[Brief] | None = None, run_date: str = "") -> StreamingQuery:
    """Run once over files that have come in: per batch, hits not seen before are absorbed and reported.

    Files hold hits (theme, run_date, pub); with ``briefs`` they hold publications, one to a line, and every brief is
    searched for in all of them in one pass, its name being the theme. The log of runs is written last and tells a
    finished batch, which does nothing when it runs again. One that broke off in between reads the seen table without
    its own rows, so what it writes again is what it wrote, and readers take the first date of each pair. Reports are a
    folder for each batch.
    """
    schema = "theme string, pub string, first_seen string, batch bigint"
    runs = "theme string, run_date string, hits bigint, new bigint, batch bigint"
    _table(spark, f"{state}/seen", schema)
    _table(spark, f"{state}/runs", runs)

    def found(batch: DataFrame) -> DataFrame:
        if briefs is None:
            return batch
        themes = spark.createDataFrame([(i, b.name) for i, b in enumerate(briefs)], "brief int, theme string")
        hits = percolate(batch.filter("publication_number IS NOT NULL").dropDuplicates(["publication_number"]), briefs)
        return hits.join(F.broadcast(themes), "brief").select("theme", F.lit(run_date).alias("run_date"), F.col("publication_number").alias("pub"))

    def each(batch: DataFrame, batch_id: int) -> None:
        seen = spark.read.schema(schema).parquet(f"{state}/seen").filter(F.col("batch") != batch_id)
        logged = spark.read.schema(runs).parquet(f"{state}/runs").filter(F.col("batch") == batch_id)
        if not logged.isEmpty():
            return
        hits = found(batch).persist()
        fresh, _ = split_seen(hits, seen)
        new = absorb(seen.limit(0), fresh).withColumn("batch", F.lit(batch_id).cast("bigint"))
        marked = hits.join(seen.select("theme", "pub", F.lit(True).alias("_old")), ["theme", "pub"], "left")
        counts = marked.groupBy("theme", "run_date").agg(F.countDistinct("pub").alias("hits"), F.countDistinct(F.when(F.col("_old").isNull(), F.col("pub"))).alias("new"))
        counts = counts.withColumn("batch", F.lit(batch_id).cast("bigint"))
        markdown.write(markdown.watch_reports(hits, fresh.dropDuplicates(["theme", "pub"])), f"{state}/reports/batch={batch_id}")
        new.write.mode("append").parquet(f"{state}/seen")
        counts.write.mode("append").parquet(f"{state}/runs")
        hits.unpersist()

    stream = spark.readStream.schema(HITS if briefs is None else PUBLICATION).json(incoming)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(spark: SparkSession, incoming: str, store: str, checkpoint: str) -> StreamingQuery:
    """Run once over hashed records that have come in: of each record the snapshots unlike the one before, in the store
    or in the batch, are appended to the store, so A, B, A within one batch keeps three.

    The store is laid out by a hash of the record, and a batch reads only the folders of its records. A batch that runs
    again after its rows were stored finds them there, equal to its own, and adds nothing: snapshots no later than the
    stored one are not new.
    """
    columns = ["canonical", "fetched_at", "content_hash"]
    sharded = f"{SNAPSHOT}, shard int"
    spark.createDataFrame([], sharded).write.mode("append").partitionBy("shard").parquet(store)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("shard", F.pmod(F.xxhash64("canonical"), F.lit(SHARDS)).cast("int"))
        batch.persist()
        stored = spark.read.schema(sharded).parquet(store).join(F.broadcast(batch.select("shard").distinct()), "shard")
        last = latest(stored.join(batch.select("canonical").distinct(), "canonical", "left_semi").select(*columns, "shard"))
        came = batch.join(last.select("canonical", F.col("fetched_at").alias("_last")), "canonical", "left").filter("_last IS NULL OR fetched_at > _last")
        both = came.select(*columns, "shard", F.lit(True).alias("_new")).unionByName(last.select(*columns, "shard", F.lit(False).alias("_new")))
        changes(both).filter("_new").select(*columns, "shard").repartition("shard").write.mode("append").partitionBy("shard").parquet(store)
        batch.unpersist()

    stream = spark.readStream.schema(SNAPSHOT).json(incoming)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def records(spark: SparkSession, incoming: str, store: str, checkpoint: str, after_write: Callable[[str], None] = lambda _: None) -> StreamingQuery:
    """Run once over fetched records that have come in (JSON lines with ``fetched_at``): per batch, what changed against
    the snapshots stored before, field by field, and a report for each changed record.

    ``snapshots``, ``changes``, ``reports`` and ``runs`` of the store have a folder for each batch, which is written over
    when the batch runs again, and a batch reads folders of earlier batches only. So a run that broke off after any of
    its writes and is started again leaves what an unbroken one does. Snapshots lie in shards by record, and a batch
    reads the shards of its own records. ``after_write`` is told the name of each table as it is written.
    """
    schema, kept = f"{RECORD}, fetched_at string", f"{RECORD}, fetched_at string, content_hash string"
    layout = f"{kept}, batch bigint, shard int"

    def each(batch: DataFrame, batch_id: int) -> None:
        def written(rows: DataFrame, name: str, *by: str) -> None:
            rows.write.mode("overwrite").partitionBy(*by).parquet(f"{store}/{name}/batch={batch_id}")
            after_write(name)

        now = hashed(batch.filter("canonical IS NOT NULL")).withColumn("shard", F.pmod(F.xxhash64("canonical"), F.lit(SHARDS)).cast("int")).persist()
        shards = [r["shard"] for r in now.select("shard").distinct().collect()]  # SHARDS at most
        spark.createDataFrame([], layout).write.mode("append").partitionBy("batch", "shard").parquet(f"{store}/snapshots")
        old = spark.read.schema(layout).parquet(f"{store}/snapshots").filter((F.col("batch") < batch_id) & F.col("shard").isin(shards))
        last = latest(old.drop("batch").join(now.select("canonical").distinct(), "canonical", "left_semi")).persist()
        came = now.join(last.select("canonical", F.col("fetched_at").alias("_last")), "canonical", "left").filter("_last IS NULL OR fetched_at > _last").drop("_last")
        mark = lambda rows, new: rows.select(*[c.split()[0] for c in kept.split(", ")], "shard", F.lit(new).alias("_new"))
        fresh = changes(mark(came, True).unionByName(mark(last, False))).filter("_new").drop("_new", "is_new")
        written(fresh, "snapshots", "shard")
        stored = spark.read.schema(f"{kept}, shard int").parquet(f"{store}/snapshots/batch={batch_id}")
        pairs = adjacent(mark(stored, True).unionByName(mark(last, False)), TRACKED)
        written(scalar_changes(pairs).unionByName(claim_changes(pairs)), "changes")
        found = spark.read.schema("canonical string, fetched_at string, field string, before string, after string, kind string").parquet(f"{store}/changes/batch={batch_id}")
        written(markdown.diff_reports(found), "reports")
        known = last.select("canonical", F.lit(True).alias("_old")).join(now.select("canonical").distinct(), "canonical", "right")
        changed = stored.select("canonical").distinct().withColumn("_kept", F.lit(True))
        tell = lambda c: F.count_if(c).alias
        counts = known.join(changed, "canonical", "left").agg(
            F.count(F.lit(1)).alias("fetched"),
            tell(F.col("_old").isNull())("new"),
            tell(F.col("_old").isNotNull() & F.col("_kept").isNotNull())("changed"),
            tell(F.col("_old").isNotNull() & F.col("_kept").isNull())("unchanged"),
        )
        written(counts, "runs")
        now.unpersist()
        last.unpersist()

    stream = spark.readStream.schema(schema).json(incoming)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
