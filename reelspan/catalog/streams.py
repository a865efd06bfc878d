"""Streaming queries run to completion; their results equal the batch queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelspan.catalog.moments import CLIP, POOL
from reelspan.catalog.sql import FIX, LATEST, r
from reelspan.functions.text import round_to
from reelspan.operators import events as ev, segment as sg, windows as wn
from reelspan.session import ensure_checkpoint_dir
from reelspan.sources import adapters as ad
from reelspan.streaming import expiring as ex, logs

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def _workspace(spark) -> str:
    """A fresh folder below the shared checkpoint directory."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


def _events(spark, sf):
    schema = ad.table(spark, sf, "events").schema
    return logs.read_log(spark, f"{sf}/events*.parquet", schema)


def _slices(df, order, n: int, folder: str) -> None:
    """Write ``df`` as ``n`` arrivals, one after the other, in ranges of the number ``order``."""
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    part = F.least(F.floor((order - F.lit(lo)) * n / F.lit((hi or 0) - (lo or 0) + 1)), F.lit(n - 1))
    for k in range(n):
        df.where(part == k).write.mode("append").parquet(folder)


def _arrivals(spark, sf, n: int, base: str):
    """The events as a stream of at least ``n`` batches in order of time."""
    e = ad.table(spark, sf, "events")
    _slices(e, F.unix_micros(F.col("ts").cast("timestamp")), n, f"{base}/events")
    return logs.read_log(spark, f"{base}/events", e.schema, 1)


def _run(spark, stream, keys, base, compact_every=8):
    logs.upsert_table(stream, f"{base}/table", f"{base}/checkpoint", keys, compact_every).awaitTermination()
    return logs.current_table(spark, f"{base}/table", keys)


@query(f"WITH {LATEST} SELECT project_id, candidate_key, id, action, user_rating FROM latest")
def streamed_decisions(spark, sf):
    d = _run(spark, logs.latest_decisions(ad.feedback_of(_events(spark, sf))), ["project_id", "candidate_key"], _workspace(spark))
    return d.select("project_id", "candidate_key", "id", "action", "user_rating")


@query(f"WITH {LATEST} SELECT project_id, candidate_key, metric_count, {r('retention_percent', 4)} AS retention_percent, {r('views', 4)} AS views FROM averages")
def streamed_metrics(spark, sf):
    """Latest captures are kept by the stream, in a snapshot and two batches at most; averages are a batch query over them."""
    base = _workspace(spark)
    keys = ["project_id", "candidate_key", "platform", "publication"]
    d = ev.candidate_metrics(_run(spark, logs.latest_captures(ad.metrics_of(_arrivals(spark, sf, 4, base))), keys, base, 3))
    return d.select("project_id", "candidate_key", "metric_count", round_to(F.col("retention_percent"), 4).alias("retention_percent"),
                    round_to(F.col("views"), 4).alias("views"))


@query("SELECT event_id AS id, user_id AS project_id FROM events")
def streamed_distinct_events(spark, sf):
    """Every event arrives twice in the stream and is kept once."""
    e = ad.feedback_of(_events(spark, sf))
    twice = e.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    base = _workspace(spark)
    logs.exactly_once(twice, "created_at", "40 days").writeStream.format("parquet").option("path", f"{base}/out").option(
        "checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").select("id", "project_id")


#: A decision is forgotten TTL after its time, once the clock, DELAY behind the newest row, has come there.
DELAY_DAYS, TTL_DAYS = 6, 10


@query(f"""WITH {LATEST} SELECT project_id, candidate_key, id, action, user_rating FROM latest
 WHERE created_at > (SELECT max(created_at) FROM latest) - INTERVAL {DELAY_DAYS + TTL_DAYS} DAY""")
def expiring_decisions(spark, sf):
    """Decisions that are still alive when the events have come in order of time; older ones have left the state."""
    base = _workspace(spark)
    changes = ex.expiring_decisions(ad.feedback_of(_arrivals(spark, sf, 6, base)), f"{DELAY_DAYS} days", TTL_DAYS * 86_400)
    ex.write_decisions(changes, base, f"{base}/checkpoint", compact_every=3).awaitTermination()
    d = ex.decisions_table(spark, base).read()
    # the last batch moves the clock once more; what has expired by then may not have been told
    clock = d.agg((F.max("us") - (DELAY_DAYS + TTL_DAYS) * 86_400_000_000).alias("c")).scalar()
    return d.where(F.col("us") > clock).select("project_id", "candidate_key", "id", "action", "user_rating")


@query(f"""WITH {POOL} SELECT project_id, id, s2 AS "start", e2 AS "end", kind AS moment_type, final_score FROM pool""")
def streamed_analysis(spark, sf):
    """Recordings come in parts: first without their later turns, then whole, in two arrivals. Each arrival replaces what was
    found for its projects, so the pools are those of the whole recordings."""
    base = _workspace(spark)
    c = ad.texts(spark, sf, "conversations")
    c.where("turn < 3").write.mode("append").parquet(f"{base}/in")
    for k in (0, 1):
        c.where(F.pmod("conv_id", F.lit(2)) == k).write.mode("append").parquet(f"{base}/in")
    stream = logs.read_log(spark, f"{base}/in", c.schema, 1)

    def analyse(batch):
        segs = ad.segments_of(batch)
        d = wn.heuristic_moments(wn.candidate_windows(sg.segment_sentences(segs), CLIP), CLIP, FIX)
        return d.select("project_id", "id", "start", "end", "moment_type", "final_score"), segs.select("project_id")

    logs.analyze_arrivals(stream, analyse, f"{base}/moments", f"{base}/checkpoint", compact_every=3).awaitTermination()
    return logs.current_table(spark, f"{base}/moments", ["project_id"])
