"""Feedback and publish-metric logs: latest rows, averages, labels, activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelspan.operators.ranking import latest_per_key

METRIC_NAMES = ("retention_percent", "avg_watch_time_sec", "views")


def candidate_key() -> Column:
    return F.coalesce(F.col("moment_id"), F.col("clip_id"))


def is_decision() -> Column:
    return F.col("action").isin("accept", "reject") | F.col("user_rating").isNotNull()


def latest_decisions(feedback: DataFrame) -> DataFrame:
    """Newest accept / reject / rated row per project and candidate, with ``candidate_key``."""
    d = feedback.where(is_decision()).withColumn("candidate_key", candidate_key())
    return latest_per_key(d, [F.col("project_id"), F.col("candidate_key")], [F.desc("created_at"), F.desc("id")])


def latest_captures(metrics: DataFrame) -> DataFrame:
    """Newest capture per publication (an empty URL counts as missing)."""
    d = metrics.withColumns({
        "candidate_key": candidate_key(),
        "publication": F.coalesce(F.nullif(F.col("published_url"), F.lit("")), F.col("clip_id").cast("string")),
    })
    return latest_per_key(
        d, [F.col("project_id"), F.col("candidate_key"), F.col("platform"), F.col("publication")],
        [F.desc("captured_at"), F.desc("id")],
    )


def candidate_metrics(captures: DataFrame) -> DataFrame:
    """Averages per candidate over its latest captures."""
    return captures.groupBy("project_id", "candidate_key").agg(
        F.count("*").alias("metric_count"), *[F.avg(n).alias(n) for n in METRIC_NAMES]
    )


def decisions_with_metrics(feedback: DataFrame, moments: DataFrame, metrics: DataFrame) -> DataFrame:
    """Training input: latest decisions ⟕ moments ⟕ metric averages.

    ``moments`` columns come back with the prefix ``m_``.
    """
    m = moments.select(*[F.col(c).alias(f"m_{c}") for c in moments.columns])
    d = latest_decisions(feedback).join(m, F.col("moment_id") == F.col("m_id"), "left")
    d = d.join(candidate_metrics(latest_captures(metrics)), ["project_id", "candidate_key"], "left")
    return d.withColumn("metric_count", F.coalesce("metric_count", F.lit(0)))


def label() -> Column:
    rating = F.col("user_rating")
    return (
        F.when(F.col("action") == "accept", 1).when(F.col("action") == "reject", 0)
        .when(rating.isin(4, 5), 1).when(rating.isin(1, 2), 0)
    )


def metric_value(name: str) -> Column:
    """Number, or null when not numeric, not finite, negative or (retention) above 100."""
    x = F.col(name).try_cast("double")
    ok = ~F.isnan(x) & (x != float("inf")) & (x >= 0)
    if name == "retention_percent":
        ok = ok & (x <= 100)
    return F.when(ok, x)


def feedback_violations() -> Column:
    """Names of broken request rules."""
    rating = F.col("user_rating")
    return F.array_compact(F.array(
        F.when(~F.coalesce(F.col("action").isin("accept", "reject", "edited", "rendered"), F.lit(False)), F.lit("action")),
        F.when((rating < 1) | (rating > 5), F.lit("rating range")),
        F.when((F.col("action") == "accept") & (rating <= 2), F.lit("accept needs rating >= 3")),
        F.when((F.col("action") == "reject") & (rating >= 4), F.lit("reject needs rating <= 3")),
    ))


def metric_violations() -> Column:
    counts = ("views", "likes", "comments", "shares", "saves")
    infinite = float("inf")

    def bad(c: str, top: float | None = None) -> Column:
        x = F.col(c)
        wrong = (x < 0) | F.isnan(x) | (x == infinite)
        return wrong | (x > top) if top is not None else wrong

    return F.array_compact(F.array(
        F.when(~F.length(F.coalesce("platform", F.lit(""))).between(1, 40), F.lit("platform")),
        *[F.when(F.col(c) < 0, F.lit(c)) for c in counts],
        F.when(bad("avg_watch_time_sec"), F.lit("avg_watch_time_sec")),
        F.when(bad("retention_percent", 100.0), F.lit("retention_percent")),
    ))


def split_valid(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    d = df.withColumn("rule_violations", violations)
    return (
        d.where(F.size("rule_violations") == 0).drop("rule_violations"),
        d.where(F.size("rule_violations") > 0),
    )


def dashboard_decisions(feedback: DataFrame, moments: DataFrame) -> DataFrame:
    """One row: accepted, rejected, mean score of accepted. The key omits the project here."""
    d = feedback.where(F.col("action").isin("accept", "reject"))
    latest = latest_per_key(d, [candidate_key()], [F.desc("created_at"), F.desc("id")])
    m = moments.select(F.col("id").alias("moment_id"), "final_score")
    accept = F.col("action") == "accept"
    return latest.select("moment_id", "action").join(m, "moment_id", "left").agg(
        F.count_if(accept).alias("accepted_count"), F.count_if(F.col("action") == "reject").alias("rejected_count"),
        F.coalesce(F.avg(F.when(accept, F.col("final_score"))), F.lit(0.0)).alias("average_score_accepted"),
    )


def top_moment_types(moments: DataFrame, n: int = 5) -> DataFrame:
    return moments.groupBy("moment_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "moment_type").limit(n)


def feedback_count(feedback: DataFrame) -> DataFrame:
    return feedback.where(is_decision()).agg(F.countDistinct(candidate_key()).alias("feedback_count"))


def feedback_by_clip(clips: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback rows of a clip: same project and (same clip or same moment).

    Two equi-joins and a de-duplication instead of an OR, which would be a nested loop.
    """
    c = clips.select("project_id", F.col("id").alias("_clip"), F.col("moment_id").alias("_moment"))
    f = feedback.select("project_id", "id", "clip_id", "moment_id", "action", "created_at")
    by_clip = c.join(f, (c.project_id == f.project_id) & (F.col("_clip") == F.col("clip_id"))).drop(c.project_id)
    by_moment = c.join(f, (c.project_id == f.project_id) & (F.col("_moment") == F.col("moment_id"))).drop(c.project_id)
    # rows that match on both keys come from the first branch only
    by_moment = by_moment.where(~F.col("_clip").eqNullSafe(F.col("clip_id")))
    return by_clip.unionByName(by_moment)


def list_clips(clips: DataFrame, moments: DataFrame, plans: DataFrame, feedback: DataFrame) -> DataFrame:
    """Clip list with scores, edit profile, last actions and the edited flag, best first.

    ``max_by`` aggregates replace the per-clip subqueries, with map-side combining.
    """
    when = F.struct("created_at", "id")
    review = F.col("action").isin("accept", "reject")
    acts = feedback_by_clip(clips, feedback).groupBy("project_id", F.col("_clip").alias("id")).agg(
        F.max_by("action", when).alias("latest_feedback_action"),
        F.max_by("action", F.when(review, when)).alias("_review"),
        F.bool_or(review).alias("_reviewed"), F.bool_or(F.col("action") == "edited").alias("boundaries_edited"),
    )
    m = moments.select(F.col("id").alias("moment_id"), "final_score", "moment_type", "text")
    pl = plans.select(F.col("clip_id").alias("id"), F.col("profile").alias("_profile"))
    d = clips.join(m, "moment_id").join(pl, "id", "left").join(acts, ["project_id", "id"], "left")
    return d.withColumns({
        "edit_profile": F.coalesce("_profile", F.lit("balanced")),
        "review_action": F.when(F.col("_reviewed"), F.col("_review")),
        "boundaries_edited": F.coalesce("boundaries_edited", F.lit(False)),
    }).drop("_profile", "_review", "_reviewed").orderBy(F.desc("final_score"), "project_id", "id")


def clip_flags(projects: DataFrame, clips: DataFrame) -> DataFrame:
    """has_clips / has_rendered per project."""
    g = clips.groupBy("project_id").agg(F.lit(True).alias("has_clips"), F.bool_or("rendered").alias("has_rendered"))
    return projects.select("project_id").join(g, "project_id", "left").na.fill(False)


def newest_video(videos: DataFrame) -> DataFrame:
    """Last ingested video per project (``seq`` is the ingest sequence)."""
    return latest_per_key(videos, [F.col("project_id")], [F.desc("seq")])


def project_activity(projects: DataFrame, videos: DataFrame, transcripts: DataFrame, feedback: DataFrame) -> DataFrame:
    """Upload, analysis, render, feedback and last-activity time of every project."""
    v = videos.groupBy("project_id").agg(
        F.max_by(F.struct(F.col("uploaded_at").alias("at")), "seq").alias("_v"),
    )
    t = transcripts.groupBy("project_id").agg(F.max("created_at").alias("analyzed_at"))
    f = feedback.groupBy("project_id").agg(
        F.max(F.when(F.col("action") == "rendered", F.col("created_at"))).alias("rendered_at"),
        F.max("created_at").alias("feedback_at"),
    )
    d = projects.join(v, "project_id", "left").join(t, "project_id", "left").join(f, "project_id", "left")
    d = d.withColumn(
        "uploaded_at", F.when(F.col("_v").isNotNull(), F.coalesce(F.col("_v.at"), F.col("created_at")))
    ).drop("_v")
    return d.withColumn(
        "last_activity_at", F.greatest("created_at", "uploaded_at", "analyzed_at", "rendered_at", "feedback_at")
    )


def select_clips(clips: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Explicit ids (a table with column ``id``) or all selected clips."""
    return clips.where("selected") if ids is None else clips.join(ids.select("id"), "id", "left_semi")
