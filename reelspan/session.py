"""Session helpers: durable lineage cuts for iterative jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names in ``spark.checkpoint.dir``.

    Where neither that setting nor a directory on the context exists, one process that is its own cluster takes a
    fresh folder of its machine; a cluster refuses, as its executors would not share such a folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="reelspan-ckpt-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder; survives executor loss. ``spark.cleaner.referenceTracking.cleanCheckpoints``
    lets Spark delete it once nothing refers to it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
