"""Legal status as a stream: the last decisive event of each right is kept as state, in whatever order events come."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.legal import FINAL, evidence_line, effect
from ..operators.state import latest

EVENT = "canonical string, pos int, date string, code string, description string"
STATUS = "canonical string, status string, evidence string, needs_review boolean, version long, settled boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TOLD = Row(*[c.split()[0] for c in STATUS.split(", ")])
#: The position of no event.
NONE = -(2**31)


class Fold(StatefulProcessor):
    """Of each right its last decisive event by position, so that a late event counts where it stands and one that comes
    twice counts once; and how often its status was told. Where ``quiet`` milliseconds are given, a right of which
    nothing came for so long is told once more, as settled."""

    def __init__(self, quiet: int | None):
        self.quiet = quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "pos int, effect string, line string, version long")

    def _told(self, canonical: str, state: tuple, settled: bool) -> Row:
        _, found, line, version = state
        status = found or "UNKNOWN"
        return TOLD(canonical, status, line if status in FINAL else None, status == "UNKNOWN", version, settled)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        held = self.last.get()
        before = None if held is None else tuple(held)
        pos, found, line, version = before or (NONE, "", "", 0)
        for _, at, now, said in rows:
            if now is not None and (at, now, said) > (pos, found, line):
                pos, found, line = at, now, said
        if self.quiet is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet)
        if before is None or (found, line) != before[1:3]:
            state = (pos, found, line, version + 1)
            self.last.update(state)
            yield self._told(key[0], state, False)
        elif pos != before[0]:
            self.last.update((pos, found, line, version))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802
        pos, found, line, version = self.last.get()
        state = (pos, found, line, version + 1)
        self.last.update(state)
        yield self._told(key[0], state, True)

    def close(self) -> None:
        pass


def statuses(events: DataFrame, quiet: int | None = None) -> DataFrame:
    """A stream of statuses from a stream of events: a row whenever a right's status or its evidence becomes another,
    numbered by ``version``; ``settled`` marks those that only a timer brought. What an event means is worked out before
    the state, as columns; events without effect only make a right known."""
    rows = events.filter("canonical IS NOT NULL").select(
        "canonical",
        F.coalesce("pos", F.lit(NONE + 1)).alias("pos"),
        effect(F.col("code"), F.col("description")).alias("effect"),
        evidence_line(F.col("date"), F.col("code"), F.col("description")).alias("line"),
    )
    mode = "none" if quiet is None else "processingTime"
    return rows.groupBy("canonical").transformWithState(Fold(quiet), STATUS, "Update", mode)


def follow(spark: SparkSession, incoming: str, out: str, checkpoint: str, quiet: int | None = None) -> StreamingQuery:
    """Run once over event files that have come in; with ``quiet``, run on until stopped, as timers only fire while a
    stream runs. The statuses of a batch are a folder of ``out`` under the batch's id, written over when the batch runs
    again."""
    told = statuses(spark.readStream.schema(EVENT).json(incoming), quiet)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    key, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set(key, PROVIDER)  # a query keeps the setting that it started with
    try:
        how = {"availableNow": True} if quiet is None else {"processingTime": "1 second"}
        return told.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(**how).start()
    finally:
        spark.conf.set(key, old) if old else spark.conf.unset(key)


def current(spark: SparkSession, out: str) -> DataFrame:
    """``canonical, status, evidence, needs_review, version, settled`` of every right, as last told."""
    return latest(spark.read.schema(STATUS).parquet(out).withColumn("fetched_at", F.col("version"))).drop("fetched_at")
