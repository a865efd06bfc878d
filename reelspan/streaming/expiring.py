"""Latest decision per candidate with state that expires, and late rows sent aside."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter
from typing import Any

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from reelspan.operators import events as ev
from reelspan.streaming.versioned import VersionedTable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_VALUE = "us long, id long, action string, user_rating int"
_COLUMNS = ("project_id", "candidate_key", "us", "id", "action", "user_rating")
#: The candidates are dealt to so many states by hash. A checkpoint is bound to the number.
BUCKETS = 4096
#: What an output row says: a decision is now the newest one, a candidate's state has expired, a row came too late.
SET, GONE, LATE = "set", "gone", "late"


class LatestDecision(StatefulProcessor):
    """Keeps one decision per candidate of a bucket until the clock is ``ttl_us`` past its time, and one timer a bucket.

    A call to the state costs far more than a row, and a state per candidate takes several a row. A bucket is read and
    written once a batch, as parallel arrays; only the buckets of a batch's rows and those with something expired are.
    """

    def __init__(self, ttl_us: int, project_type: str):
        self.ttl_us, self.project_type = ttl_us, project_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live = handle.getValueState("live", (
            f"timer long, project_id array<{self.project_type}>, candidate_key array<long>, us array<long>, id array<long>, action array<string>, user_rating array<int>"))

    @staticmethod
    def _out(key: tuple, value: tuple, kind: str) -> Row:
        return Row(project_id=key[0], candidate_key=key[1], us=value[0], id=value[1], action=value[2], user_rating=value[3], kind=kind)

    def _held(self) -> tuple[int | None, dict[tuple, tuple]]:
        """When the bucket's timer ends, and the decision per (project_id, candidate_key)."""
        timer, *columns = self.live.get() or (None, *([] for _ in _COLUMNS))
        return timer, {r[:2]: r[2:] for r in zip(*columns)}

    def _ends(self, value: tuple) -> int:
        return -(-(value[0] + self.ttl_us) // 1000)

    def _keep(self, timer: int | None, held: dict[tuple, tuple]) -> None:
        """Write the bucket. Its timer ends with the first decision or before; one that ends earlier finds nothing and is set again."""
        if not held:
            self.live.clear()
            return
        first = min(map(self._ends, held.values()))
        if timer is None or first < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(first)
            timer = first
        self.live.update((timer, *map(list, zip(*(k + v for k, v in held.items())))))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        clock = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        timer, held = self._held()
        pick, fresh = None, set()
        for r in rows:
            pick = pick or itemgetter(*map(r.__fields__.index, _COLUMNS))
            row = pick(r)
            candidate, value = row[:2], row[2:]
            if value[0] < clock:
                yield self._out(candidate, value, LATE)
            elif candidate not in held or value[:2] > held[candidate][:2]:
                held[candidate] = value
                fresh.add(candidate)
        if fresh:
            self._keep(timer, held)
            for candidate in fresh:
                yield self._out(candidate, held[candidate], SET)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        clock = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        _, held = self._held()
        gone = {c: v for c, v in held.items() if self._ends(v) <= clock}
        self._keep(None, {c: v for c, v in held.items() if c not in gone})  # Spark drops the timer that has ended
        for candidate, value in gone.items():
            yield self._out(candidate, value, GONE)

    def close(self) -> None:
        pass


def expiring_decisions(feedback: DataFrame, delay: str, ttl_sec: int) -> DataFrame:
    """Changes of the latest decision per candidate: project_id, candidate_key, us (time in microseconds), id, action,
    user_rating, kind (SET, GONE, LATE).

    The watermark follows the newest row by ``delay``. A decision is forgotten once the watermark has passed its time by
    ``ttl_sec``; rows behind the watermark change nothing and come out as LATE. Rows without a time are left out.
    Spark drops late rows before a stateful operator sees them, by their watermarked column. So each row is doubled: one
    copy carries its time and moves the watermark, the other has none, is never late for Spark, and alone goes on.
    """
    d = feedback.where(F.size(ev.feedback_violations()) == 0).where(ev.is_decision() & F.col("created_at").isNotNull())
    d = d.select("project_id", ev.candidate_key().cast("long").alias("candidate_key"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("us"),
                 F.col("id").cast("long").alias("id"), "action", "user_rating")
    d = d.withColumn("tick", F.explode(F.array(F.timestamp_micros("us"), F.lit(None).cast("timestamp"))))
    d = d.withWatermark("tick", delay).where(F.col("tick").isNull())  # not pushed below the watermark, as it asks for its column
    kind = d.schema["project_id"].dataType.simpleString()
    d = d.withColumn("bucket", F.pmod(F.xxhash64("project_id", "candidate_key"), F.lit(BUCKETS)))
    return d.groupBy("bucket").transformWithState(
        LatestDecision(ttl_sec * 1_000_000, kind), f"project_id {kind}, candidate_key long, {_VALUE}, kind string", "Update", "EventTime")


def decisions_table(spark, path: str, compact_every: int = 8) -> VersionedTable:
    return VersionedTable(spark, f"{path}/decisions", ["project_id", "candidate_key"], compact_every, gone="gone")


def write_decisions(changes: DataFrame, path: str, checkpoint: str, compact_every: int = 8, available_now: bool = True) -> StreamingQuery:
    """Keep ``path``/decisions at the live decisions and ``path``/late at the late rows; a replayed batch changes nothing."""
    spark = changes.sparkSession
    table = decisions_table(spark, path, compact_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            batch.where(F.col("kind") == LATE).drop("kind").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
            live = batch.where(F.col("kind") != LATE).withColumn("gone", F.col("kind") == GONE).drop("kind")
            # a decision that replaces an expired one in the same batch wins
            newest = live.groupBy("project_id", "candidate_key").agg(F.max(F.struct("us", "id", "action", "user_rating", "gone")).alias("r"))
            table.commit(newest.select("project_id", "candidate_key", "r.*"), batch_id)
        finally:
            batch.unpersist()

    w = changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)  # transformWithState needs it; a query keeps the settings it was started with
    try:
        return (w.trigger(availableNow=True) if available_now else w).start()
    finally:
        spark.conf.set(name, before)
