"""Transcript segments to timed sentences and word streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelspan.functions import text as tx
from reelspan.functions.arrays import unfold
from reelspan.operators.scan import running


def speaker_labels(words: Column, fallback: Column) -> Column:
    """Labels of the words in order; the segment label if no word has one."""
    labels = F.filter(F.transform(words, lambda w: w["speaker"]), lambda s: s.isNotNull() & (s != ""))
    usable_fallback = fallback.isNotNull() & (fallback != "")
    return (
        F.when(F.size(labels) > 0, labels)
        .when(usable_fallback, F.array(fallback))
        .otherwise(F.array().cast("array<string>"))
    )


def count_switches(labels: Column) -> Column:
    """Changes between neighbours of an ordered label array."""
    return F.size(
        F.filter(
            F.transform(labels, lambda s, i: (i > 0) & (s != F.get(labels, i - 1))), lambda changed: changed
        )
    )


def split_plain_text(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence: ``sentence_pos`` (0-based) and ``sentence``."""
    parts = df.withColumn("_parts", tx.split_sentences(F.col(text))).drop(text)
    return unfold(parts, "_parts", "sentence", pos="sentence_pos").drop("_parts")


def segment_sentences(segments: DataFrame) -> DataFrame:
    """Timed sentences of every recording, numbered from 0 in speech order.

    A single sentence keeps the segment's times. Several sentences take words
    by running word count; without words the segment's time is split evenly.
    """
    has_words = "words" in segments.columns
    d = segments.withColumn("_parts", tx.split_sentences(F.col("text")))
    d = running(
        d, ["project_id"], ["pos"], F.floor(F.col("pos") / 4096), {"_base": ("sum", F.size("_parts"))}
    )
    span = (F.col("end") - F.col("start")) / F.size("_parts")
    single = F.size("_parts") == 1
    if not has_words:
        d = unfold(d, "_parts", "sentence", pos="_i")
        labels = F.when(
            F.col("speaker").isNotNull() & (F.col("speaker") != ""), F.array("speaker")
        ).otherwise(F.array().cast("array<string>"))
        return d.select(
            "project_id", (F.col("_base") + F.col("_i")).cast("long").alias("pos"),
            F.col("pos").alias("seg_pos"),
            F.when(single, F.col("start")).otherwise(F.col("start") + F.col("_i") * span).alias("start"),
            F.when(single, F.col("end")).otherwise(F.col("start") + F.col("_i") * span + span).alias("end"),
            F.col("sentence").alias("text"), F.get(labels, F.lit(0)).alias("speaker"),
            labels.alias("speakers"), F.lit(0).alias("speaker_switches"),
        )
    # cursor of every sentence into the word array
    cursors = F.aggregate(
        F.transform("_parts", tx.n_words),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
        lambda acc: acc["out"],
    )
    d = unfold(d.withColumn("_cursors", cursors), "_parts", "sentence", pos="_i")
    taken = F.slice("words", F.get("_cursors", F.col("_i")) + 1, tx.n_words(F.col("sentence")))
    d = d.withColumn("_words", F.when(single, F.col("words")).otherwise(taken))
    d = d.withColumn("_labels", speaker_labels(F.col("_words"), F.col("speaker")))
    timed = ~single & (F.size("_words") > 0)
    unique = F.array_distinct("_labels")
    return d.select(
        "project_id", (F.col("_base") + F.col("_i")).cast("long").alias("pos"), F.col("pos").alias("seg_pos"),
        F.when(single, F.col("start")).when(timed, F.get("_words", F.lit(0))["start"])
        .otherwise(F.col("start") + F.col("_i") * span).alias("start"),
        F.when(single, F.col("end")).when(timed, F.try_element_at("_words", F.lit(-1))["end"])
        .otherwise(F.col("start") + F.col("_i") * span + span).alias("end"),
        F.col("sentence").alias("text"),
        F.when(F.size(unique) == 1, F.get(unique, F.lit(0))).alias("speaker"),
        unique.alias("speakers"), count_switches(F.col("_labels")).alias("speaker_switches"),
        F.col("_words").alias("words"),
    )


def repair_transcript(transcripts: DataFrame) -> DataFrame:
    """Repair document, segment and word text; rebuild the document text if anything changed."""
    fixed = F.transform(
        "segments",
        lambda s: s.withField("text", tx.repair_mojibake(s["text"])).withField(
            "words", F.transform(s["words"], lambda w: w.withField("word", tx.repair_mojibake(w["word"])))
        ),
    )
    d = transcripts.withColumns({"_fixed": fixed, "_text": tx.repair_mojibake(F.col("text"))})
    d = d.withColumn(
        "text_changed",
        F.coalesce(F.col("text") != F.col("_text"), F.lit(False))
        | ~F.col("segments").eqNullSafe(F.col("_fixed")),
    )
    joined = F.array_join(F.transform("_fixed", lambda s: s["text"]), " ")
    return d.withColumns({
        "text": F.when(F.col("text_changed"), joined).otherwise(F.col("text")), "segments": F.col("_fixed"),
    }).drop("_fixed", "_text")


def pseudo_words(text: Column, start: Column, end: Column, speaker: Column) -> Column:
    """Segment text spread evenly over its time, as an array of words."""
    words = F.split(tx.collapse(text), " ")
    step = F.greatest(F.lit(0.08), (end - start) / F.size(words))
    return F.transform(
        words,
        lambda w, i: F.struct(
            w.alias("word"), (start + i * step).alias("start"),
            F.least(end, start + (i + 1) * step).alias("end"),
            F.lit(None).cast("double").alias("probability"), speaker.alias("speaker"),
        ),
    )
