"""Caption cues of clips, entirely as array expressions per clip.

A clip is short (tens of seconds), so its words form one bounded array; the
left-to-right chunking is a fold over it and stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelspan.functions import text as tx
from reelspan.functions.arrays import unfold
from reelspan.lexicon import DEFAULT, Lexicon
from reelspan.operators.intervals import overlap_join
from reelspan.operators.segment import pseudo_words


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clip_words(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """(project_id, id, start, end, words): words of every clip in absolute time, clipped and de-duplicated.

    Segment text is spread evenly where word timing is absent, or covers at most
    45% of the text of a segment that lies fully inside.
    """
    o = overlap_join(
        clips.select("project_id", "id", "start", "end"),
        segments.select("project_id", "pos", "start", "end", "text", "speaker", "words"),
        "project_id", closed=True,
    )
    lo, hi = F.col("start"), F.col("end")

    def inside(words: Column) -> Column:
        return F.filter(words, lambda w: (w["end"] > lo + 0.02) & (w["start"] < hi - 0.02))

    o = o.withColumns({"_timed": inside(F.col("r_words")), "_n": tx.n_words(F.col("r_text"))})
    spread_ok = (F.least("r_end", hi) - F.greatest("r_start", lo) >= 0.08) & (F.col("_n") > 0)
    none = F.array().cast(segments.schema["words"].dataType)
    spread = F.when(
        spread_ok, inside(pseudo_words(F.col("r_text"), F.col("r_start"), F.col("r_end"), F.col("r_speaker")))
    ).otherwise(none)
    sparse = (
        (F.col("r_start") >= lo) & (F.col("r_end") <= hi) & (F.col("_n") > 2) & (F.size("_timed") <= F.col("_n") * 0.45)
    )
    o = o.withColumn("_use", F.when((F.size("_timed") == 0) | sparse, spread).otherwise(F.col("_timed")))
    seg_pos, seg_speaker = F.col("r_pos"), F.col("r_speaker")
    clipped = F.transform(
        "_use",
        lambda w, i: F.struct(
            F.greatest(w["start"], lo).alias("start"), F.least(w["end"], hi).alias("end"),
            seg_pos.alias("seg"), i.alias("i"), w["word"].alias("word"), w["probability"].alias("probability"),
            F.coalesce(F.when(w["speaker"] != "", w["speaker"]), seg_speaker).alias("speaker"),
        ),
    )
    o = o.withColumn("_words", F.filter(clipped, lambda w: w["end"] - w["start"] >= 0.0))
    g = o.groupBy("project_id", "id").agg(
        F.first("start").alias("start"), F.first("end").alias("end"),
        F.sort_array(F.flatten(F.collect_list("_words"))).alias("_words"),
    )
    word_type = "array<struct<start:double,end:double,seg:bigint,i:int,word:string,probability:double,speaker:string>>"

    def keep(acc: Column, w: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        repeat = (F.abs(w["start"] - last["start"]) < 0.02) & (w["word"] == last["word"])
        return F.when(F.coalesce(repeat, F.lit(False)), acc).otherwise(F.array_append(acc, w))

    deduped = F.aggregate(F.col("_words").cast(word_type), F.array().cast(word_type), keep)
    return g.select("project_id", "id", "start", "end", deduped.alias("words"))


def _with_word_facts(words: Column, lex: Lexicon) -> Column:
    """Attach what the chunking rules ask about each word."""

    def fact(w: Column, i: Column) -> Column:
        nxt = F.get(words, i + 1)
        pause = F.coalesce(F.greatest(F.lit(0.0), nxt["start"] - w["end"]), F.lit(0.0))
        text = F.rtrim(w["word"])
        ellipsis = tx.ends_with_any(text, ("...", "…"))
        terminal = tx.ends_with_any(text, (".", "!", "?", ";", ":")) & ~ellipsis
        return F.struct(
            w["start"].alias("start"), w["end"].alias("end"), w["word"].alias("word"),
            w["probability"].alias("probability"), w["speaker"].alias("speaker"), i.alias("i"),
            F.length(w["word"]).alias("len"), nxt["speaker"].alias("next_speaker"),
            (terminal | (pause >= 0.38)).alias("hard"),
            (text.endswith(",") | ellipsis | (pause >= 0.20)).alias("soft"),
            tx.bare_word(w["word"]).isin(*lex.caption_orphans).alias("orphan"),
        )

    return F.transform(words, fact)


def _chars(words: Column, a: Column, n: Column) -> Column:
    """Length of n words (one at least) from index a joined by blanks. Words are looked up: a slice copies the whole array first."""
    return F.aggregate(F.sequence(a, a + n - 1), F.lit(0), lambda s, i: s + F.get(words, i)["len"]) + n - 1


def _chunk(words: Column, cap: int) -> Column:
    """Array of struct(a, b): half-open spans of word indexes."""
    span = "array<struct<a:int,b:int>>"
    state = F.struct(
        F.array().cast(span).alias("spans"), F.lit(0).alias("a"), F.get(words, F.lit(0))["speaker"].alias("speaker")
    )

    def close(spans: Column, a: Column, b: Column) -> Column:
        return F.array_append(spans, F.struct(a.cast("int").alias("a"), b.cast("int").alias("b")))

    def st(spans: Column, a: Column, speaker: Column) -> Column:
        return F.struct(spans.alias("spans"), a.cast("int").alias("a"), speaker.alias("speaker"))

    def step(acc: Column, w: Column) -> Column:
        i = w["i"]
        turn = (acc["a"] < i) & ~w["speaker"].eqNullSafe(acc["speaker"])
        turned = F.when(turn, st(close(acc["spans"], acc["a"], i), i, w["speaker"])).otherwise(acc)

        def fit(s: Column) -> Column:
            n = i - s["a"]
            full = (n > 0) & ((n >= cap) | (_chars(words, s["a"], n + 1) > 52))
            carry = (n > 1) & F.get(words, i - 1)["orphan"]
            cut = F.when(carry, i - 1).otherwise(i)
            return F.when(full, st(close(s["spans"], s["a"], cut), cut, w["speaker"])).otherwise(s)

        def finish(s: Column) -> Column:
            duration = F.greatest(F.lit(0.0), w["end"] - F.get(words, s["a"])["start"])
            done = w["hard"] | (i - s["a"] + 1 >= cap) | (duration >= 2.5) | ((duration >= 1.15) & w["soft"])
            return F.when(
                done & ~w["orphan"], st(close(s["spans"], s["a"], i + 1), i + 1, w["next_speaker"])
            ).otherwise(s)

        return _let(_let(turned, fit), finish)

    def end(acc: Column) -> Column:
        n = F.size(words)
        return F.when(acc["a"] < n, close(acc["spans"], acc["a"], n)).otherwise(acc["spans"])

    return F.aggregate(words, state, step, end)


def _merge_short(words: Column, spans: Column, cap: int) -> Column:
    """Join a chunk to the previous one where either is shorter than 0.62 s and both fit."""

    def seconds(s: Column) -> Column:
        return F.greatest(F.lit(0.0), F.get(words, s["b"] - 1)["end"] - F.get(words, s["a"])["start"])

    def step(acc: Column, s: Column) -> Column:
        def with_last(last: Column) -> Column:
            n = s["b"] - last["a"]
            fits = (
                F.get(words, last["b"] - 1)["speaker"].eqNullSafe(F.get(words, s["a"])["speaker"])
                & (n <= cap + 1) & (_chars(words, last["a"], n) <= 56)
            )
            short = (seconds(s) < 0.62) | (seconds(last) < 0.62)
            joined = F.array_append(
                F.slice(acc, F.lit(1), F.size(acc) - 1), F.struct(last["a"].alias("a"), s["b"].alias("b"))
            )
            return F.when(last.isNotNull() & fits & short, joined).otherwise(F.array_append(acc, s))

        return _let(F.try_element_at(acc, F.lit(-1)), with_last)

    return F.aggregate(spans, F.array().cast("array<struct<a:int,b:int>>"), step)


def majority_speaker(words: Column, fallback: Column) -> Column:
    """Most frequent label, the earliest on a tie."""
    labels = F.filter(F.transform(words, lambda w: w["speaker"]), lambda s: s.isNotNull() & (s != ""))
    ranked = F.transform(
        F.array_distinct(labels),
        lambda u, i: F.struct(F.size(F.filter(labels, lambda s: s == u)).alias("n"), (-i).alias("i"), u.alias("u")),
    )
    return F.coalesce(F.array_max(ranked)["u"], fallback)


def caption_cues(clips: DataFrame, segments: DataFrame, max_words: int = 3, lex: Lexicon = DEFAULT) -> DataFrame:
    """One row per cue: idx, start, end (clip time), text, speaker, words."""
    cap = max(2, max_words * 2 + 1)
    d = clip_words(clips, segments).where(F.size("words") > 0)
    d = d.withColumn("_w", _with_word_facts(F.col("words"), lex))
    d = d.withColumn("_spans", _chunk(F.col("_w"), cap))
    d = d.withColumn("_spans", _merge_short(F.col("_w"), F.col("_spans"), cap))
    lo, hi = F.col("start"), F.col("end")

    def cue(s: Column, k: Column) -> Column:
        words = F.transform(F.sequence(s["a"], s["b"] - 1), lambda i: F.get("_w", i))
        nxt = F.get("_spans", k + 1)
        return F.struct(
            (k + 1).alias("idx"), words.alias("words"),
            F.replace(F.array_join(F.transform(words, lambda w: w["word"]), " "), F.lit(" -"), F.lit("-")).alias("text"),
            (F.get("_w", s["a"])["start"] - lo).alias("start"),
            (F.get("_w", s["b"] - 1)["end"] - lo).alias("end"),
            F.when(nxt.isNotNull(), F.get("_w", nxt["a"])["start"] - lo).otherwise(hi - lo).alias("next_start"),
        )

    d = unfold(d, F.transform("_spans", cue), "c").select("project_id", "id", "start", "end", "c")
    target = F.greatest(F.lit(0.65), F.length("c.text") / 18.0)
    stretched = F.least(
        F.greatest(F.col("c.end"), F.col("c.start") + target),
        F.greatest(F.col("c.end"), F.col("c.next_start") - 0.08), F.col("end") - F.col("start"),
    )
    cue_end = F.when(F.col("c.end") - F.col("c.start") < target, stretched).otherwise(F.col("c.end"))
    words = F.transform(
        "c.words",
        lambda w: F.struct(
            w["word"].alias("word"), (w["start"] - lo).alias("start"), (w["end"] - lo).alias("end"),
            w["probability"].alias("probability"), w["speaker"].alias("speaker"),
        ),
    )
    return d.select(
        "project_id", F.col("id").alias("clip_id"), F.col("c.idx").alias("idx"), F.col("c.start").alias("start"),
        cue_end.alias("end"), F.col("c.text").alias("text"),
        majority_speaker(F.col("c.words"), F.get("c.words", F.lit(0))["speaker"]).alias("speaker"),
        words.alias("words"),
    ).where(F.col("end") - F.col("start") >= 0.08)


def srt_documents(cues: DataFrame) -> DataFrame:
    """One SubRip text per clip; a clip's cues are bounded by its length."""
    block = F.struct(
        "idx", "start", "end", tx.collapse(F.col("text")).alias("text")
    )
    g = cues.groupBy("project_id", "clip_id").agg(F.sort_array(F.collect_list(block)).alias("_c"))
    blocks = F.transform(
        "_c",
        lambda c, i: F.concat(
            (i + 1).cast("string"), F.lit("\n"), tx.timecode(c["start"]), F.lit(" --> "), tx.timecode(c["end"]),
            F.lit("\n"), c["text"], F.lit("\n"),
        ),
    )
    return g.select("project_id", "clip_id", F.array_join(blocks, "\n").alias("srt"))


def caption_quality(clips: DataFrame, cues: DataFrame) -> DataFrame:
    """Cue statistics per clip and ``needs_pass``: whether its captions need a second transcription."""
    item = F.struct("start", "end", "text", "words")
    g = cues.groupBy("project_id", F.col("clip_id").alias("id")).agg(F.sort_array(F.collect_list(item)).alias("_c"))
    d = clips.select("project_id", "id", "start", "end", "duration").join(g, ["project_id", "id"], "left")
    c = F.coalesce(F.col("_c"), F.array().cast(g.schema["_c"].dataType))
    d = d.withColumn("_c", c)
    gaps = F.transform("_c", lambda x, i: F.when(i > 0, x["start"] - F.get("_c", i - 1)["end"]).otherwise(0.0))
    counts = F.transform("_c", lambda x: F.greatest(F.size(x["words"]), tx.n_words(x["text"])))
    words = F.flatten(F.transform("_c", lambda x: x["words"]))
    d = d.withColumns({
        "n_cues": F.size("_c"),
        "tail": F.coalesce(F.array_max(F.transform("_c", lambda x: x["end"])), F.lit(0.0)),
        "largest_gap": F.greatest(F.lit(0.0), F.coalesce(F.array_max(gaps), F.lit(0.0))),
        "word_count": F.aggregate(counts, F.lit(0), lambda a, n: a + n),
        "_words": words,
    })
    probs = F.filter(F.transform("_words", lambda w: w["probability"]), lambda p: p.isNotNull())
    d = d.withColumns({"_p": probs, "_blink": F.exists("_words", lambda w: w["end"] - w["start"] < 0.04)})
    low = F.size(F.filter("_p", lambda p: p < 0.25)) / F.size("_p")
    mean = F.aggregate("_p", F.lit(0.0), lambda a, p: a + p) / F.size("_p")
    unsure = (F.size("_p") > 0) & ((low > 0.10) | (mean < 0.72))
    dur = F.col("duration")
    needs = F.when(dur < 8, F.col("n_cues") == 0).otherwise(
        (F.col("n_cues") == 0) | F.col("_blink")
        | (F.col("word_count") / F.greatest(dur, F.lit(1.0)) < 0.65)
        | (F.col("largest_gap") > 4.0) | F.coalesce(unsure, F.lit(False)) | (F.col("tail") < dur - 5)
    )
    return d.withColumn("needs_pass", needs).select(
        "project_id", "id", "n_cues", "tail", "largest_gap", "word_count", "needs_pass"
    )


def caption_source(full: DataFrame, local: DataFrame) -> DataFrame:
    """Choose per clip between the full and a clip-local transcript.

    ``full``: output of caption_quality on the full transcript; ``local``: same
    columns plus ``synthetic``. A synthetic transcript never wins.
    """
    l = local.select("project_id", "id", F.col("tail").alias("_lt"), F.col("synthetic").alias("_syn"))
    d = full.join(l, ["project_id", "id"], "left")
    has_full = F.col("n_cues") > 0
    source = (
        F.when(has_full & ~F.col("needs_pass"), "full")
        .when(F.col("_lt").isNull() | F.col("_syn"), F.when(has_full, "full"))
        .when(~has_full | (F.col("_lt") > F.col("tail") + 2), "local")
        .otherwise("full")
    )
    return d.select("project_id", "id", source.alias("source"))
