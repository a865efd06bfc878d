"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = (
    "latest_decisions", "training_input", "list_clips", "project_activity", "snapshot_backfill", "commercial_evidence",
    "text_scores", "structural_penalty", "mojibake_repair", "timed_sentences", "candidate_windows", "heuristic_pool",
    "interval_text", "promo_blocks", "clip_boundaries", "selection_audit", "prompt_windows", "shot_changes",
    "caption_cues", "edit_plans", "inherited_speakers", "filled_gaps", "nearest_speaker", "numeric_preferences",
    "personal_ranking", "streamed_decisions",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("reelspan-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        # text scoring is CPU-bound on small inputs: let AQE keep small partitions apart
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("reelspan.textPartitions", str(2 * int(cpus)) if cpus.isdigit() else "16")  # the tables are one row group each
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="reelspan-bench-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.log.level", "ERROR").getOrCreate()
    )


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    from reelspan.catalog import QUERIES

    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    QUERIES["top_moment_types"](spark, sf).write.format("noop").mode("overwrite").save()  # warm the JVM
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
