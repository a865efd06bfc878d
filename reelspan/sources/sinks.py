"""Writers. Results are distributed files; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelspan.operators.store import replace_generation

BUCKETS = 256


def with_bucket(df: DataFrame, n: int = BUCKETS) -> DataFrame:
    """Partition column: a hash bucket of the project, not the project itself (no tiny files)."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("project_id"), F.lit(n)).cast("int"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_projects(spark: SparkSession, path: str, staging: str, new: DataFrame, feedback: DataFrame, n: int = BUCKETS) -> None:
    """Replace one analysis generation of the projects in ``new``.

    Only buckets that hold a touched project are rewritten. Spark cannot
    overwrite what it reads, so the result goes to ``staging`` (shared storage)
    first and from there by dynamic partition overwrite; repeating a failed run
    gives the same state.
    """
    new = with_bucket(new, n)
    touched = new.select("bucket").distinct()
    old = spark.read.parquet(path).join(F.broadcast(touched), "bucket", "left_semi")  # at most n rows
    merged = replace_generation(old, new.select(*old.columns), feedback)
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(staging)
    (
        spark.read.parquet(staging).select(*old.columns).repartition("bucket").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    )


def write_audit(audit: DataFrame, summary: DataFrame, promo_blocks: DataFrame, path: str) -> None:
    audit.write.mode("overwrite").parquet(f"{path}/decisions")
    promo_blocks.write.mode("overwrite").parquet(f"{path}/promotional_ranges")
    summary.write.mode("overwrite").json(f"{path}/summary")


def write_texts(df: DataFrame, text: str, path: str) -> None:
    """One record per line; embedded newlines stay inside the JSON string."""
    df.select("project_id", "clip_id", text).write.mode("overwrite").json(path)
