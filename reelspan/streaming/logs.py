"""Continuous versions of the event-log queries (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from reelspan.operators import events as ev
from reelspan.streaming.versioned import VersionedTable


def read_log(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).parquet(path)


def exactly_once(log: DataFrame, time: str, delay: str = "1 day", key: str = "id") -> DataFrame:
    """Drop repeated event ids; state is kept only as long as the watermark requires."""
    log = log.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need a zoned timestamp
    return log.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def latest_decisions(feedback: DataFrame) -> DataFrame:
    """Running latest decision per candidate. Late rows lose by event time, not by arrival.

    State is one row per candidate and has no expiry: an old decision stays
    valid until a newer one comes. ``expiring.expiring_decisions`` bounds the state by time.
    """
    d = feedback.where(F.size(ev.feedback_violations()) == 0).where(ev.is_decision())
    d = d.withColumn("candidate_key", ev.candidate_key())
    return d.groupBy("project_id", "candidate_key").agg(
        F.max(F.struct("created_at", "id", "action", "user_rating")).alias("d")
    ).select("project_id", "candidate_key", "d.*")


def latest_captures(metrics: DataFrame) -> DataFrame:
    """Running latest capture per publication."""
    d = metrics.withColumns({
        "candidate_key": ev.candidate_key(),
        "publication": F.coalesce(F.nullif(F.col("published_url"), F.lit("")), F.col("clip_id").cast("string")),
    })
    return d.groupBy("project_id", "candidate_key", "platform", "publication").agg(
        F.max(F.struct("captured_at", "id", "views", "retention_percent", "avg_watch_time_sec")).alias("c")
    ).select("project_id", "candidate_key", "platform", "publication", "c.*")


def upsert_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str], compact_every: int = 8, available_now: bool = True) -> StreamingQuery:
    """Keep a ``VersionedTable`` at the newest row per key.

    In update mode a batch holds only keys that changed, so the cost of a batch follows its changes, not the size of the
    table; every ``compact_every`` batches it also rewrites the snapshot. Path and checkpoint belong on shared storage.
    """
    table = VersionedTable(stream.sparkSession, path, keys, compact_every)
    w = stream.writeStream.outputMode("update").foreachBatch(lambda batch, i: table.commit(batch, i)).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def current_table(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest row per key, from the snapshot and the batches since."""
    return VersionedTable(spark, path, keys).read()


def analyze_arrivals(transcripts: DataFrame, analyse, path: str, checkpoint: str, compact_every: int = 8, available_now: bool = True) -> StreamingQuery:
    """Analyse transcripts as files arrive and replace the results of the projects each batch touches.

    ``analyse(batch)`` gives rows with project_id, and the project_ids it has looked at. The rows become one generation of a ``VersionedTable``: new files first, then
    one manifest that points to them. Readers take whole generations; a replayed batch leaves the same table.
    """
    table = VersionedTable(transcripts.sparkSession, path, ["project_id"], compact_every)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, projects = analyse(batch)
        table.commit(rows, batch_id, touched=projects)

    w = transcripts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
