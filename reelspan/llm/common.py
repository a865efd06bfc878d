"""Helpers the operators share: input tables, row keys, staged tables, decisions carried back to the documents."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from reelspan.session import ensure_checkpoint_dir

#: What separates words, as a Java and a Python pattern: the six ASCII white-space characters.
SPACES, WORD = r"[\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_LAST = (1 << 63) - 1


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """Write a table below the shared folder of ``spark.checkpoint.dir`` and read it back.

    Cuts lineage as checkpoint() does, but stays columnar: readers prune columns, and the planner knows its size.
    ``drop_staged`` deletes what a session has staged.
    """
    return stage_at(df)[0]


def stage_at(df: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """As ``stage``, in folders per value of ``by`` (the last columns), and the path, for ``drop_staged``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/staged-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path), path


_STAGED: list[str] = []


def drop_staged(spark: SparkSession, *paths: str) -> None:
    """Delete the staged tables of this session, or those at ``paths``; DataFrames that read them must not be used afterwards."""
    jvm = spark.sparkContext._jvm
    for path in paths or list(_STAGED):
        _STAGED.remove(path)
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage, after which Spark removes the shuffle files of jobs that nobody refers to."""
    for _ in range(2):  # the second time finds what the first has let go
        gc.collect()
        time.sleep(0.2)
        spark.sparkContext._jvm.System.gc()


def id_order(doc_id: str = "doc_id") -> Column:
    """doc_id for ordering and keys: null counts as the largest."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))


def row_keys() -> tuple[Column, Column]:
    """Names a row by doc_id and a hash of its text, so that null or repeated ids neither get lost nor meet in one task."""
    return id_order(), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def keep_rows(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """``docs`` without the rows whose key is in ``decisions`` with copies = 0, the others as often as copies says.

    decisions: _k1, _k2 (``row_keys``), copies int, single boolean; one row per key. Keys without a decision stay as
    they are. Of rows that share a key marked ``single`` the first by their other columns stands for all.
    """
    k1, k2 = row_keys()
    # the row travels as one value, so that its columns may have any names
    d = docs.select(k1.alias("_k1"), k2.alias("_k2"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = d.join(decisions, ["_k1", "_k2"], "left")
    single = F.coalesce(F.col("single"), F.lit(False))
    alive = F.coalesce(F.col("copies"), F.lit(1)) > 0
    order = [F.col(f"row.`{c}`") for c, t in docs.dtypes if c not in ("doc_id", "text") and not t.startswith(("map", "variant"))]
    w = W.partitionBy("_k1", "_k2").orderBy(*order or [F.lit(0)])
    one = d.where(alive & single).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    out = d.where(alive & ~single).unionByName(one)
    out = out.select("row", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("copies"), F.lit(1)))).alias("_i"))
    return out.select("row.*")


def first_of_groups(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, the first by _k1 and _k2. groups: _k1, _k2 (``row_keys``), component of every row."""
    first = groups.groupBy("component").agg(F.min(F.struct("_k1", "_k2")).alias("f"), F.count("*").alias("n")).where("n > 1")
    g = groups.join(first, "component")
    copies = F.max(((F.col("_k1") == F.col("f._k1")) & (F.col("_k2") == F.col("f._k2"))).cast("int"))
    return keep_rows(docs, g.groupBy("_k1", "_k2").agg(copies.alias("copies"), F.lit(True).alias("single")))
