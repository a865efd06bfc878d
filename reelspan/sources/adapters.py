"""Shape the generic test tables into the library's tables (formulas in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelspan.functions import text as tx
from reelspan.operators.scan import running
from reelspan.session import cut_lineage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table of long texts, as its files are split. For files that cannot be split (one row group each) a user may
    set ``reelspan.textPartitions``, to which rows are then dealt out before the text rules; nothing is inspected."""
    d, n = table(spark, sf, name), spark.conf.get("reelspan.textPartitions", None)
    return d.repartition(int(n)) if n else d


def segments(spark: SparkSession, sf: str, words: bool = False) -> DataFrame:
    return segments_of(texts(spark, sf, "conversations"), words)


def segments_of(conversations: DataFrame, words: bool = False) -> DataFrame:
    """Conversations as timed recordings: 0.4 s per word, pauses of 0-4 s."""
    d = conversations.select(
        F.col("conv_id").alias("project_id"), F.col("turn").alias("pos"), F.col("role").alias("speaker"), "text"
    )
    dur = 40 * tx.n_words(F.col("text"))
    gap = ((F.col("project_id") * 7 + F.col("pos") * 13) % 5) * 100
    d = d.withColumns({"_dur": dur.cast("long"), "_gap": gap})
    d = running(d, ["project_id"], ["pos"], F.floor(F.col("pos") / 4096), {"_cs": ("sum", F.col("_dur") + F.col("_gap"))})
    d = d.select(
        "project_id", "pos", (F.col("_cs") / 100.0).alias("start"), ((F.col("_cs") + F.col("_dur")) / 100.0).alias("end"),
        "text", "speaker", "_cs",
    )
    d = cut_lineage(d)  # the timeline is read by every branch of every query
    if not words:
        return d.drop("_cs")
    cs, pos = F.col("_cs"), F.col("pos")
    split = F.filter(F.split(tx.collapse(F.col("text")), " "), lambda w: w != "")
    arr = F.transform(
        split,
        lambda w, i: F.struct(
            w.alias("word"), ((cs + i * 40) / 100.0).alias("start"), ((cs + i * 40 + 35) / 100.0).alias("end"),
            (((pos * 7 + i * 13) % 100) / 100.0).alias("probability"), F.lit(None).cast("string").alias("speaker"),
        ),
    )
    return d.withColumn("words", arr).drop("_cs")


def recording_durations(segs: DataFrame) -> DataFrame:
    return segs.groupBy("project_id").agg(F.max("end").alias("transcript_duration"))


def feedback(spark: SparkSession, sf: str) -> DataFrame:
    return feedback_of(table(spark, sf, "events"))


def feedback_of(events: DataFrame) -> DataFrame:
    clip = F.col("event_id") % 40
    kind = F.col("event_type")
    action = F.when(kind == "purchase", "accept").when(kind == "error", "reject").when(kind == "view", "rendered").otherwise("edited")
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), clip.alias("clip_id"),
        F.when(F.col("event_id") % 7 != 0, clip).alias("moment_id"), action.alias("action"),
        F.when(kind == "signup", (1 + F.col("event_id") % 5).cast("int")).alias("user_rating"),
        F.col("ts").alias("created_at"),
    )


def publish_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics_of(table(spark, sf, "events"))


def metrics_of(events: DataFrame) -> DataFrame:
    clip, e = F.col("event_id") % 40, F.col("event_id")
    return events.select(
        e.alias("id"), F.col("user_id").alias("project_id"), clip.alias("clip_id"),
        F.when(e % 7 != 0, clip).alias("moment_id"),
        F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (e % 3).cast("int")).alias("platform"),
        F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("u"), clip)).alias("published_url"),
        (e % 1000).alias("views"), F.when(e % 6 != 0, F.col("value")).alias("retention_percent"),
        (F.col("value") / 4).alias("avg_watch_time_sec"), F.col("ts").alias("captured_at"),
    )


def moments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as stored moments: deterministic scores, real text."""
    kinds = [F.lit(x) for x in ("insight", "controversial_take", "how_to", "personal_story", "result")]
    i = F.col("doc_id")
    return texts(spark, sf, "documents").select(
        i.alias("id"), F.col("source").alias("project_id"), (i * 10.0).alias("start"), (i * 10.0 + 20 + i % 9).alias("end"),
        (20.0 + i % 9).alias("duration"), "text", F.left("text", F.lit(60)).alias("summary"),
        F.left("text", F.lit(20)).alias("hook_text"), F.get(F.array(*kinds), (i % 5).cast("int")).alias("moment_type"),
        *[((i * (k + 3)) % 101).cast("double").alias(n) for k, n in enumerate((
            "semantic_interest_score", "hook_score", "clarity_score", "emotion_score", "novelty_score",
            "standalone_score", "retention_score", "speech_density_score", "audio_energy_score", "visual_energy_score"))],
        (i % 4).cast("int").alias("speaker_count"), (i % 6).cast("int").alias("speaker_switches"),
        ((i * 5) % 101).cast("double").alias("dialogue_score"), ((i * 7) % 101).cast("double").alias("base_score"),
        ((i * 7) % 101).cast("double").alias("final_score"),
    )


def clips(spark: SparkSession, sf: str) -> DataFrame:
    """One clip per (user, event_id mod 40); its moment differs from its clip number."""
    g = table(spark, sf, "events").groupBy(F.col("user_id").alias("project_id"), (F.col("event_id") % 40).alias("id")).agg(
        F.min("ts").alias("created_at"), F.max("value").alias("_v"), F.count("*").alias("n_events")
    )
    return g.select(
        "project_id", "id", ((F.col("id") * 7) % 40).alias("moment_id"), (F.col("id") * 10.0).alias("start"),
        (F.col("id") * 10.0 + 25).alias("end"), F.lit(25.0).alias("duration"), (F.col("n_events") % 2 == 0).alias("selected"),
        (F.col("_v") > 100).alias("rendered"), "created_at",
    )


def training_rows(spark: SparkSession, sf: str, lex) -> DataFrame:
    """Labelled documents: project = source, label = quality, features from the text."""
    from reelspan.operators.features import with_features

    d = moments(spark, sf).join(
        table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), "toxic"), "id"
    )
    d = tx.settle(with_features(d, lex, "features"), "features")
    return d.withColumns({
        "retention_percent": F.when(F.col("id") % 3 != 0, (F.col("id") % 120).cast("double")),
        "avg_watch_time_sec": (F.col("id") % 50) / 2.0, "views": F.col("id") % 1000,
        "moment_id": F.col("id"), "clip_id": F.col("id"),
    }).where(F.col("features").isNotNull())


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as segment items of recordings of 50 turns each."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        F.floor(v / 50).alias("project_id"), (v % 50).alias("pos"), "embedding",
        (F.lit(0.4) + (v % 5) * 0.4).alias("duration"), (1 + v % 4).cast("int").alias("n_words"),
        F.concat(F.lit("S"), 1 + F.col("label") % 3).alias("truth"),
    )
