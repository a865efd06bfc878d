"""A table kept as a snapshot and the batches since, named by numbered manifests.

Data files are written first, into folders nobody reads yet; then one small manifest makes them the table. A manifest is
created under the next number and never changed: creating a file that must not exist is atomic on every store, so of two
writers one fails, and readers see the table before or after a batch, never between. A writer that dies before its
manifest leaves the table as it was, and the replayed batch writes new folders. A batch number the newest manifest
already covers is skipped, so a replay after the manifest changes nothing.

A batch holds, for the keys it touches, all that is now true of them: the newest row of a key (upsert) or all rows of a
group (replacement; a touched group without rows is then empty). Every ``compact_every`` batches are folded into a new
snapshot before the manifest is published, so a reader opens the snapshot and fewer batches than that.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


class VersionedTable:
    """``path`` on shared storage; ``keys`` name a row, or the group of rows that a batch replaces. ``gone``: a boolean
    column that marks keys as deleted."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], compact_every: int = 8, gone: str | None = None):
        self.spark, self.path, self.keys, self.compact_every, self.gone = spark, path, keys, compact_every, gone

    # -- manifests -----------------------------------------------------------

    def _hadoop(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._hadoop("manifest")
        if not fs.exists(p):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(p))
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The newest (or a given) manifest; of an empty table one without data."""
        found = self.versions()
        if not found:
            return {"version": 0, "batch": -1, "snapshot": None, "tail": []}
        p, fs = self._hadoop(f"manifest/v{version or found[-1]:012d}")
        stream = fs.open(p)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _publish(self, m: dict) -> None:
        p, fs = self._hadoop(f"manifest/v{m['version']:012d}")
        out = fs.create(p, False)  # fails if another writer was first
        try:
            out.write(bytearray(json.dumps(m).encode()))
        finally:
            out.close()

    # -- data ----------------------------------------------------------------

    def commit(self, rows: DataFrame, batch_id: int, touched: DataFrame | None = None) -> bool:
        """Make ``rows`` batch ``batch_id``; False if the table already holds it. ``touched``: keys replaced besides
        those of ``rows``."""
        m = self.manifest()
        if batch_id <= m["batch"]:
            return False
        folder = f"data/b{batch_id:012d}-{uuid.uuid4().hex}"
        rows.withColumn("_batch", F.lit(batch_id).cast("long")).write.parquet(f"{self.path}/{folder}/rows")
        if touched is not None:
            touched.select(*self.keys).distinct().withColumn("_batch", F.lit(batch_id).cast("long")).write.parquet(f"{self.path}/{folder}/touched")
        new = {"version": m["version"] + 1, "batch": batch_id, "snapshot": m["snapshot"], "tail": [*m["tail"], [folder, touched is not None]]}
        if len(new["tail"]) >= self.compact_every:
            new = {**new, **self._compacted(new)}
        self._publish(new)
        return True

    def _compacted(self, m: dict) -> dict:
        folder = f"data/s{m['batch']:012d}-{uuid.uuid4().hex}"
        self._current(m).write.parquet(f"{self.path}/{folder}/rows")
        return {"snapshot": folder, "tail": []}

    def _current(self, m: dict) -> DataFrame:
        """Rows of the batch that touched their key last, with ``_batch``. Only keys and batch numbers are grouped."""
        folders = [*([m["snapshot"]] if m["snapshot"] else []), *(f for f, _ in m["tail"])]
        rows = self.spark.read.parquet(*[f"{self.path}/{f}/rows" for f in folders])
        if m["tail"]:
            seen = rows.select(*self.keys, "_batch")
            marks = [f"{self.path}/{f}/touched" for f, has in m["tail"] if has]
            if marks:
                seen = seen.unionByName(self.spark.read.parquet(*marks))
            newest = seen.groupBy(*self.keys).agg(F.max("_batch").alias("_newest"))
            r, n = rows.alias("r"), newest.alias("n")
            on = [F.col(f"r.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            rows = r.join(n, [*on, F.col("r._batch") == F.col("n._newest")], "left_semi")
        return rows.where(~F.coalesce(F.col(self.gone), F.lit(False))) if self.gone else rows

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of the newest (or a given) manifest, from its snapshot and the batches since."""
        m = self.manifest(version)
        if m["version"] == 0:
            raise ValueError(f"nothing was committed to {self.path}")
        return self._current(m).drop("_batch")

    def vacuum(self, keep: int = 2) -> int:
        """Delete the manifests but the newest ``keep``, and folders that none of those names; returns how many folders.
        Only for times without a writer and without readers of older versions."""
        found = self.versions()
        kept = [self.manifest(v) for v in found[-keep:]]
        named = {f for m in kept for f in [m["snapshot"], *(t for t, _ in m["tail"])] if f}
        for v in found[:-keep]:
            p, fs = self._hadoop(f"manifest/v{v:012d}")
            fs.delete(p, False)
        p, fs = self._hadoop("data")
        gone = [s.getPath() for s in fs.listStatus(p) if f"data/{s.getPath().getName()}" not in named] if fs.exists(p) else []
        for g in gone:
            fs.delete(g, True)
        return len(gone)
