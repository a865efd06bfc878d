"""Candidate windows over sentences and their speaker metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from reelspan.functions import scoring as sc, text as tx
from reelspan.functions.arrays import unfold
from reelspan.lexicon import DEFAULT, Lexicon
from reelspan.operators.chain import greedy_spacing
from reelspan.operators.intervals import overlap_aggregate, point_join
from reelspan.operators.ranking import top_per_key
from reelspan.operators.scan import with_halo
from reelspan.operators.segment import count_switches
from reelspan.params import ClipParams, SuggestionParams


def speaker_metrics(labels: Column, intra_switches: Column, duration: Column) -> Column:
    """struct(speaker_count, speaker_switches, dialogue_score) of an ordered label array."""
    unique = F.array_distinct(labels)
    counts = F.sort_array(
        F.transform(unique, lambda u: F.size(F.filter(labels, lambda s: s == u))), asc=False
    )
    switches = count_switches(labels) + intra_switches
    second = F.coalesce(F.get(counts, F.lit(1)), F.lit(0))
    balanced = (second >= 2) & (second / F.size(labels) >= 0.12)
    score = tx.clamp(
        38 + (F.size(unique) - 1) * 15
        + F.least(F.lit(25.0), switches / F.greatest(F.lit(1.0), duration) * 85),
        0.0, 100.0,
    )
    return F.struct(
        F.size(unique).alias("speaker_count"), switches.alias("speaker_switches"),
        F.when((F.size(unique) >= 2) & balanced & (switches >= 2), score).otherwise(0.0).alias("dialogue_score"),
    )


def clip_speaker_metrics(labels: Column, duration: Column) -> Column:
    """Simpler variant without balance gate, for rows stored without metrics."""
    unique, switches = F.size(F.array_distinct(labels)), count_switches(labels)
    score = F.least(
        F.lit(100.0),
        42 + (unique - 1) * 18 + F.least(F.lit(28.0), switches / F.greatest(F.lit(1.0), duration) * 90),
    )
    return F.struct(
        unique.alias("speaker_count"), switches.alias("speaker_switches"),
        F.when(unique >= 2, tx.round2(score)).otherwise(0.0).alias("dialogue_score"),
    )


def sentence_labels(window: Column) -> Column:
    """Ordered labels of sentence structs: all labels of a sentence, else its single one."""
    return F.flatten(
        F.transform(
            window,
            lambda s: F.when(F.size(s["speakers"]) > 0, s["speakers"])
            .when(s["speaker"].isNotNull() & (s["speaker"] != ""), F.array(s["speaker"]))
            .otherwise(F.array().cast("array<string>")),
        )
    )


def _sum_switches(window: Column) -> Column:
    return F.aggregate(window, F.lit(0), lambda acc, s: acc + s["speaker_switches"])


def target_lengths(p: ClipParams) -> list[float]:
    preferred = max(p.min_duration_sec, min(p.max_duration_sec, p.preferred_duration_sec or p.min_duration_sec * 1.6))
    return sorted({p.min_duration_sec, preferred, min(p.max_duration_sec, preferred + 12.0)})


def candidate_windows(sentences: DataFrame, p: ClipParams = ClipParams(), chunk_sec: float = 1800.0) -> DataFrame:
    """Windows that start at every second sentence and reach up to three target lengths.

    A window looks ahead at most ``max_duration_sec``, so each 30-minute chunk
    of a recording is computed on its own with that much halo.
    """
    longest = p.max_duration_sec
    d = with_halo(sentences, F.col("start"), chunk_sec, after=longest)
    frame = (
        Window.partitionBy("project_id", "_chunk").orderBy("start")
        .rangeBetween(0, int(math.ceil(longest)))
    )
    item = F.struct("pos", "start", "end", "text", "speaker", "speakers", "speaker_switches")
    d = d.withColumn("_ahead", F.collect_list(item).over(frame)).where("_home AND pos % 2 = 0")
    anchor_pos = F.col("pos")
    d = d.select(
        "project_id", F.col("pos").alias("anchor_pos"), F.col("start").alias("_s0"),
        F.sort_array(F.filter("_ahead", lambda x: x["pos"] >= anchor_pos)).alias("_ahead"),
    )
    s0 = F.col("_s0")

    def first_index(arr: Column, cond) -> Column:
        return F.get(F.array_compact(F.transform(arr, lambda x, i: F.when(cond(x, i), i))), F.lit(0))

    d = d.withColumn(
        "_cut", F.coalesce(first_index(F.col("_ahead"), lambda x, i: (i > 0) & (x["end"] - s0 > longest)), F.size("_ahead"))
    ).withColumn("_ahead", F.slice("_ahead", F.lit(1), F.col("_cut")))
    targets = F.array(*[F.lit(float(t)) for t in target_lengths(p)])
    lasts = F.transform(
        targets,
        lambda t: F.coalesce(first_index(F.col("_ahead"), lambda x, i: x["end"] - s0 >= t), F.col("_cut") - 1),
    )
    long_enough = F.filter(
        F.array_distinct(lasts), lambda j: F.get("_ahead", j)["end"] - s0 >= p.min_duration_sec * 0.85
    )
    d = unfold(d, long_enough, "_last")
    win = F.slice("_ahead", F.lit(1), F.col("_last") + 1)
    d = d.withColumn("_win", win)
    d = d.withColumn("_end", F.element_at("_win", -1)["end"])
    metrics = speaker_metrics(sentence_labels(F.col("_win")), _sum_switches(F.col("_win")), F.col("_end") - s0)
    d = d.withColumn("_m", metrics)
    return d.select(
        "project_id", "anchor_pos", F.element_at("_win", -1)["pos"].alias("last_pos"),
        s0.alias("start"), F.col("_end").alias("end"), (F.col("_end") - s0).alias("duration"),
        F.array_join(F.transform("_win", lambda x: x["text"]), " ").alias("text"),
        F.get("_win", F.lit(0))["text"].alias("first_text"), F.element_at("_win", -1)["text"].alias("last_text"),
        "_m.speaker_count", "_m.speaker_switches", "_m.dialogue_score",
    )


def pool_order() -> list:
    """Total order of a candidate pool."""
    return [F.desc("final_score"), F.asc("start"), F.asc("end"), F.asc("id")]


def heuristic_moments(windows: DataFrame, p: ClipParams = ClipParams(), lex: Lexicon = DEFAULT, judge=None) -> DataFrame:
    """Score windows, drop weak ones twice (before and after the quality penalty), keep the pool. ``judge`` may add columns
    while the facts of the texts are at hand."""
    d = sc.with_text_signs(sc.with_text_facts(windows, "text"), "text", lex)
    d = sc.with_text_scores(d, "text", "duration", lex)
    d = tx.settle(d.withColumn("base_score", sc.base_score()), "base_score").where(
        F.col("base_score") >= max(32.0, p.min_score - 22)
    )
    d = sc.with_moment_type(d, "text", lex)
    if judge is not None:
        d = judge(d)
    clean = F.col(sc.fact("text", "clean"))
    d = d.withColumns({
        "moment_type": F.when((F.col("dialogue_score") > 0) & (F.col("moment_type") == "insight"), "conversation")
        .otherwise(F.col("moment_type")),
        "hook_text": tx.summarize(tx.collapse(F.col("first_text")), 90),
        "summary": tx.summarize(clean, 180),
        "payoff_text": tx.summarize(tx.collapse(F.col("last_text")), 100),
        "problems": F.array_compact(F.array(
            F.when(F.col("duration") < p.min_duration_sec, F.lit("short context")),
            F.when(F.col("duration") > p.max_duration_sec, F.lit("long clip")),
        )),
        "id": F.format_string("moment_%d_%d", "anchor_pos", "last_pos"),
        "personal_score": F.col("base_score"), "final_score": F.col("base_score"),
    })
    d = d.withColumns({
        "start": tx.round2(F.col("start")), "end": tx.round2(F.col("end")),
        "duration": tx.round2(F.col("duration")),
        "suggested_title": F.left("hook_text", F.lit(80)),
        "suggested_caption": F.concat("summary", F.lit("\n\n#shorts #tiktok #reels")),
        "reason": F.concat(
            F.lit("Content arc: "), F.replace("moment_type", F.lit("_"), F.lit(" ")),
            F.lit("; hook and payoff scored from the transcript."),
        ),
    })
    d = tx.settle(sc.drop_text_facts(sc.apply_quality_penalty(d, lex)), "final_score").where(
        F.col("final_score") >= max(32.0, p.min_score - 18)
    )
    return top_per_key(d, ["project_id"], pool_order(), p.pool_size).drop("first_text", "last_text", "anchor_pos", "last_pos")


def _with_sentences(moments: DataFrame, sentences: DataFrame, closed: bool, slack: float, fields: tuple[str, ...]) -> DataFrame:
    """Add ``_win``: the overlapped sentences in order, of each its position and ``fields``."""
    item = F.struct("pos", *fields).alias("item")
    s = sentences.select("project_id", "start", "end", item)
    win = F.sort_array(F.collect_list("r_item")).alias("_win")
    return overlap_aggregate(moments, s, "project_id", ["id"], [win], closed=closed, slack=slack)


def interval_text(moments: DataFrame, sentences: DataFrame, slack: float = 0.02) -> DataFrame:
    """``interval_text`` of all sentences that overlap the interval by more than the slack."""
    text = F.array_join(
        F.filter(F.transform("_win", lambda x: tx.strip_ws(x["text"])), lambda t: t != ""), " "
    )
    return _with_sentences(moments, sentences, False, slack, ("text",)).withColumn("interval_text", text).drop("_win")


def closed_interval_text(moments: DataFrame, sentences: DataFrame) -> DataFrame:
    """As ``interval_text`` but touching sentences belong to the interval."""
    text = tx.strip_ws(F.array_join(F.transform("_win", lambda x: x["text"]), " "))
    return _with_sentences(moments, sentences, True, 0.0, ("text",)).withColumn("interval_text", text).drop("_win")


def interval_speaker_metrics(moments: DataFrame, sentences: DataFrame) -> DataFrame:
    """Replace the three speaker columns by metrics over the closed interval."""
    d = _with_sentences(
        moments.drop("speaker_count", "speaker_switches", "dialogue_score"), sentences, True, 0.0, ("start", "end", "speaker", "speakers", "speaker_switches")
    )
    duration = F.coalesce(
        F.try_element_at("_win", F.lit(-1))["end"] - F.get("_win", F.lit(0))["start"], F.lit(0.0)
    )
    m = speaker_metrics(sentence_labels(F.col("_win")), _sum_switches(F.col("_win")), duration)
    return d.withColumn("_m", m).select(
        *[c for c in d.columns if c != "_win"], "_m.speaker_count", "_m.speaker_switches", "_m.dialogue_score"
    )


def boost_dialogue(moments: DataFrame, sentences: DataFrame) -> DataFrame:
    """Raise the scores of intervals with a real dialogue, once."""
    d = interval_speaker_metrics(moments, sentences).withColumn(
        "_boosted", (F.col("dialogue_score") > 0) & ~F.col("reason").contains("Dialogue signal")
    )
    boost = F.least(F.lit(6.0), F.col("dialogue_score") * 0.06)
    up = {
        s: F.when(F.col("_boosted"), tx.round2(F.least(F.lit(100.0), F.col(s) + boost))).otherwise(F.col(s))
        for s in ("base_score", "personal_score", "final_score")
    }
    up["moment_type"] = F.when(
        F.col("_boosted") & (F.col("moment_type") == "insight"), "conversation"
    ).otherwise(F.col("moment_type"))
    up["reason"] = F.when(
        F.col("_boosted"),
        F.concat("reason", F.format_string(" Dialogue signal: %d speakers, %d turns.", "speaker_count", "speaker_switches")),
    ).otherwise(F.col("reason"))
    return d.withColumns(up).drop("_boosted")


def prompt_windows(sentences: DataFrame, p: SuggestionParams = SuggestionParams()) -> DataFrame:
    """Overlapping windows of fixed length for an external suggester, with the transcript lines.

    The start of a window depends on the previous one; ``greedy_spacing``
    resolves that chain in logarithmically many distributed rounds.
    """
    longest = max(30.0, p.max_window_sec)
    step = longest - max(0.0, min(p.overlap_sec, longest * 0.45))
    starts = greedy_spacing(sentences, "project_id", "start", step, "pos", chunk=longest * 4)
    final = sentences.groupBy("project_id").agg(F.max("start").alias("_last"))
    starts = starts.select("project_id", F.col("pos").alias("window_pos"), F.col("start").alias("window_start")).join(
        final, "project_id"
    ).withColumn("_complete", F.col("window_start") + longest > F.col("_last"))
    # the first window that holds the last sentence ends the series
    stop = starts.where("_complete").groupBy("project_id").agg(F.min("window_pos").alias("_stop"))
    starts = starts.join(stop, "project_id").where(F.col("window_pos") <= F.col("_stop"))
    starts = starts.withColumn("window_end", F.col("window_start") + longest)
    line = F.concat(
        F.format_string("%.2f-%.2f: ", "start", "end"), F.col("text")
    )
    joined = point_join(
        sentences.select("project_id", "pos", "start", F.struct("pos", line.alias("line")).alias("_line")),
        starts.select("project_id", "window_pos", "window_start", "window_end"),
        "project_id", "start", "window_start", "window_end", width=longest, open_hi=True,
    ).where(F.col("pos") >= F.col("r_window_pos"))
    return joined.groupBy("project_id", F.col("r_window_pos").alias("window_pos")).agg(
        F.first("r_window_start").alias("window_start"), F.count("*").alias("n_sentences"),
        F.array_join(F.transform(F.sort_array(F.collect_list("_line")), lambda x: x["line"]), "\n").alias("transcript"),
    )


def add_cut_counts(moments: DataFrame, cuts: DataFrame) -> DataFrame:
    """``n_cuts``: shot changes inside the closed interval (cuts: project_id, ts)."""
    points = cuts.select("project_id", "ts", F.col("ts").alias("ts_end"))
    return overlap_aggregate(
        moments, points, "project_id", ["id"], [F.count("r_ts").alias("n_cuts")], r=("ts", "ts_end"), closed=True
    )
