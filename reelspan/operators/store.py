"""Appends, upserts, generation replacement and backfills of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from reelspan.functions import text as tx
from reelspan.lexicon import DEFAULT, Lexicon
from reelspan.operators import events as ev
from reelspan.operators.features import with_features
from reelspan.session import cut_lineage

MOMENT_TEXTS = ("text", "summary", "hook_text", "payoff_text", "suggested_title", "suggested_caption")


def feature_snapshots(moments: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """(project_id, moment_id, snapshot): feature JSON, null where a moment's values break a rule."""
    d = with_features(moments, lex, "_features")
    return d.select("project_id", F.col("id").alias("moment_id"), F.to_json("_features").alias("snapshot"))


def feedback_rows(requests: DataFrame, moments: DataFrame, lex: Lexicon = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(rows to append with an immutable feature snapshot, rejected rows with ``rule_violations``)."""
    good, bad = ev.split_valid(requests, ev.feedback_violations())
    snaps = feature_snapshots(moments, lex)
    rows = good.drop("features_json").join(snaps, ["project_id", "moment_id"], "left")
    return rows.withColumnRenamed("snapshot", "features_json"), bad


def metric_rows(captures: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with project and moment resolved through the clip, rows of unknown clips).

    A capture that already names both ids needs no clip.
    """
    c = clips.select(F.col("id").alias("clip_id"), F.col("project_id").alias("_p"), F.col("moment_id").alias("_m"), F.lit(True).alias("_known"))
    d = captures.join(c, "clip_id", "left")
    complete = F.col("project_id").isNotNull() & F.col("moment_id").isNotNull()
    ok = complete | F.coalesce("_known", F.lit(False))
    d = d.withColumns({
        "_ok": ok, "project_id": F.coalesce("project_id", "_p"), "moment_id": F.coalesce("moment_id", "_m"),
    }).drop("_p", "_m", "_known")
    return d.where("_ok").drop("_ok"), d.where("NOT _ok").drop("_ok")


def rebuild_metrics(metrics: DataFrame, clips: DataFrame) -> DataFrame:
    """Resolve missing ids through clips, drop rows that stay without a project."""
    c = clips.select(F.col("id").alias("clip_id"), F.col("project_id").alias("_p"), F.col("moment_id").alias("_m"))
    d = metrics.join(c, "clip_id", "left").withColumns({
        "project_id": F.coalesce("project_id", "_p"), "moment_id": F.coalesce("moment_id", "_m"),
    })
    return d.where(F.col("project_id").isNotNull()).drop("_p", "_m")


def kept_moments(moments: DataFrame, feedback: DataFrame) -> DataFrame:
    """Old moments some feedback refers to."""
    refs = feedback.where(F.col("moment_id").isNotNull()).select("project_id", F.col("moment_id").alias("id")).distinct()
    return moments.join(refs, ["project_id", "id"], "left_semi")


def replace_generation(old: DataFrame, new: DataFrame, feedback: DataFrame) -> DataFrame:
    """Moments after an analysis run: untouched projects, new rows, and old rows that feedback needs."""
    touched = new.select("project_id").distinct()
    untouched = old.join(touched, "project_id", "left_anti")
    survivors = kept_moments(old.join(touched, "project_id", "left_semi"), feedback)
    survivors = survivors.join(new.select("project_id", "id"), ["project_id", "id"], "left_anti")
    fixed = new.withColumns({c: tx.repair_mojibake(F.col(c)) for c in MOMENT_TEXTS if c in new.columns})
    return untouched.unionByName(survivors).unionByName(fixed)


def upsert(current: DataFrame, changes: DataFrame, keys: list[str], version: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """Row with the highest version per key; columns in ``keep_first`` keep their smallest value.

    One aggregation with map-side combining; every change of a key may arrive in any order.
    """
    allrows = current.unionByName(changes)
    rest = [c for c in allrows.columns if c not in keys and c not in keep_first]
    g = allrows.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.col(version)).alias("_row"), *[F.min(c).alias(c) for c in keep_first]
    )
    return g.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], *keep_first).select(*allrows.columns)


def replace_per_project(current: DataFrame, new: DataFrame) -> DataFrame:
    """Delete + insert per project."""
    return current.join(new.select("project_id").distinct(), "project_id", "left_anti").unionByName(new)


def backfill_snapshots(feedback: DataFrame, moments: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Fill missing feature snapshots from the moment, then from the newest donor row of the
    same project that shares the moment or the clip.

    The donor search is two aggregations by key and two joins, never an OR-join.
    """
    own = feature_snapshots(moments, lex).select(F.col("moment_id"), F.col("snapshot").alias("_own"))
    d = feedback.join(own, "moment_id", "left").withColumn("features_json", F.coalesce("features_json", "_own")).drop("_own")
    d = cut_lineage(d)  # read three times; the snapshots must not be computed three times
    donors = d.where(F.col("features_json").isNotNull())

    def newest(key: str, out: str) -> DataFrame:
        return donors.where(F.col(key).isNotNull()).groupBy("project_id", key).agg(
            F.max(F.struct("created_at", "id", "features_json")).alias(out)
        )

    d = d.join(newest("moment_id", "_by_moment"), ["project_id", "moment_id"], "left")
    d = d.join(newest("clip_id", "_by_clip"), ["project_id", "clip_id"], "left")
    donor = F.greatest("_by_moment", "_by_clip")["features_json"]
    return d.withColumn("features_json", F.coalesce("features_json", donor)).select(*feedback.columns)


def backfill_from_metadata(feedback: DataFrame, metadata: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Legacy backfill from clip metadata (clip_id, moment_id and feature columns): the moment must agree."""
    snaps = feature_snapshots(metadata.withColumn("id", F.col("moment_id")), lex)
    m = metadata.select("project_id", "clip_id", F.col("moment_id").alias("moment_id")).join(
        snaps, ["project_id", "moment_id"]
    ).groupBy("project_id", "clip_id", "moment_id").agg(F.max("snapshot").alias("_s"))
    eligible = F.col("features_json").isNull() & F.col("action").isin("accept", "reject")
    d = feedback.join(m, ["project_id", "clip_id", "moment_id"], "left")
    return d.withColumn("features_json", F.when(eligible, F.col("_s")).otherwise(F.col("features_json"))).select(*feedback.columns)
