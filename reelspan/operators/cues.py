"""Cue, beat and edit-plan operators on the word stream of a clip.

Words of a clip form one short ordered array. Look-back, look-ahead and
spaced picking are array expressions, so a plan for millions of clips is one
join plus projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelspan.functions import text as tx
from reelspan.lexicon import DEFAULT, GENERATED_EFFECTS, MONTAGE_PROFILES, MOTION_SCALES, Lexicon
from reelspan.operators.intervals import overlap_aggregate
from reelspan.params import EditParams

_WORD = "array<struct<start:double,end:double,seg:bigint,i:int,text:string,speaker:string,probability:double>>"
_CUE = "struct<ts:double,score:double,kind:string,reason:string,text:string>"


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spoken_words(clips: DataFrame, segments: DataFrame) -> DataFrame:
    """Add ``words`` (clip time). Segments without word timing are spread evenly over the clipped part."""
    segs = segments.select("project_id", "pos", "start", "end", "text", "speaker", "words")
    lo, hi, dur = F.col("start"), F.col("end"), F.col("duration")
    seg, speaker = F.col("r_pos"), F.col("r_speaker")

    def local(text: Column, s: Column, e: Column, sp: Column, prob: Column, i: Column) -> Column:
        return F.struct(
            F.greatest(F.lit(0.0), s - lo).alias("start"), F.least(dur, e - lo).alias("end"), seg.alias("seg"),
            i.alias("i"), text.alias("text"), sp.alias("speaker"), prob.alias("probability"),
        )

    timed = F.transform(
        F.filter("r_words", lambda w: (w["end"] >= lo) & (w["start"] <= hi)),
        lambda w, i: local(
            tx.strip_ws(w["word"]), w["start"], w["end"],
            F.coalesce(F.when(w["speaker"] != "", w["speaker"]), speaker), w["probability"], i,
        ),
    )
    toks = F.regexp_extract_all("r_text", F.lit(r"(?U)(\w+(?:[?!.,…]+)?)"), F.lit(1))
    first, last = F.greatest("r_start", lo), F.least("r_end", hi)

    def spread(t: Column) -> Column:
        step = F.greatest(F.lit(0.05), (last - first) / F.size(t))
        return F.transform(
            t, lambda x, i: local(x, first + i * step, first + i * step + step, speaker, F.lit(None).cast("double"), i)
        )

    empty = F.coalesce(F.size("r_words"), F.lit(0)) <= 0
    heard = F.when(empty, _let(toks, spread).cast(_WORD)).otherwise(timed.cast(_WORD))
    heard = F.when(seg.isNotNull(), heard)
    return overlap_aggregate(
        clips, segs, "project_id", ["id"], [F.sort_array(F.flatten(F.collect_list(heard))).alias("words")], closed=True, uses=("start", "end", "duration")
    )


def _cue(ts: Column, score: Column, kind: str | Column, reason: Column, text: Column | None = None) -> Column:
    return F.struct(
        ts.cast("double").alias("ts"), score.cast("double").alias("score"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), reason.alias("reason"),
        (F.lit("") if text is None else text).alias("text"),
    )


def lexical_cue(word: Column, moment_type: Column, lex: Lexicon = DEFAULT) -> Column:
    """Question, reveal, contrast or stakes cue of one annotated word; else null."""
    n, ts = word["norm"], word["start"] + 0.06

    def boost(*kinds: str) -> Column:
        return F.when(moment_type.isin(*kinds), 0.4).otherwise(0.0)

    def cue(score: Column, kind: str) -> Column:
        return _cue(ts, score, kind, F.concat(F.lit(f"{kind} cue: "), n))

    return (
        F.when(n.isin(*lex.question_strong), cue(9.4 + boost("controversial_take", "question"), "question"))
        .when(n.isin(*lex.cue_reveal), cue(8.9 + boost("insight", "explanation"), "reveal"))
        .when(n.isin(*lex.cue_contrast), cue(8.5 + boost("controversial_take"), "contrast"))
        .when(tx.starts_with_any(n, lex.cue_stakes), cue(F.lit(7.9), "stakes"))
    )


def question_cue(words: Column, i: Column, moment_type: Column, lex: Lexicon = DEFAULT) -> Column:
    """Cue of a question that ends at word i: look back to a pause or terminal mark, at most 11 words."""
    recent = F.slice(words, F.greatest(i - 10, F.lit(0)) + 1, F.least(i + 1, F.lit(11)))
    start = F.coalesce(
        F.array_max(F.transform(F.filter(recent, lambda w: w["brk"]), lambda w: w["n"])), F.greatest(i - 11, F.lit(0))
    )

    def judge(phrase: Column) -> Column:
        anchor = F.get(F.filter(phrase, lambda w: w["norm"].isin(*lex.question_cues)), F.lit(0))
        content = F.size(F.filter(
            phrase, lambda w: (F.length(w["norm"]) >= 3) & ~w["norm"].isin(*lex.question_fillers)
        ))
        ok = anchor["norm"].isin(*lex.question_strong) | ((F.size(phrase) >= 3) & (content >= 2))
        sure = tx.clamp(F.coalesce(anchor["probability"], F.lit(0.75)), 0.0, 1.0)
        boost = F.when(moment_type.isin("controversial_take", "question", "question_answer"), 0.4).otherwise(0.0)
        preview = F.array_join(F.transform(F.slice(phrase, 1, 6), lambda w: w["text"]), " ")
        return F.when(
            anchor.isNotNull() & ok,
            _cue(anchor["start"] + 0.06, 9.45 + boost + sure * 0.15, "question", F.concat(F.lit("question phrase: "), preview)),
        )

    asked = F.get(words, i)["text"].contains("?")
    return F.when(asked, _let(F.slice(words, start + 1, i - start + 1), judge))


def fact_label(words: Column, i: Column, lex: Lexicon = DEFAULT) -> Column:
    """Number plus the unit word that follows within 0.42 s, upper case, 24 characters."""
    w, nxt = F.get(words, i), F.get(words, i + 1)
    near = (nxt["start"] - w["end"] <= 0.42) & tx.starts_with_any(nxt["norm"], lex.fact_units)
    strip = " ,.!?;:…"
    label = F.when(near, F.concat(tx.strip_set(w["text"], strip), F.lit(" "), tx.strip_set(nxt["text"], strip))).otherwise(
        tx.strip_set(w["text"], strip)
    )
    return F.left(F.upper(label), F.lit(24))


def annotate_words(clips: DataFrame, max_pause_sec: float = 0.65, lex: Lexicon = DEFAULT) -> DataFrame:
    """Turn ``words`` into annotated words and add the cue arrays ``facts``, ``cues`` and ``turns``."""
    words = F.col("words")

    def facts(w: Column, i: Column) -> Column:
        prev = F.get(words, i - 1)
        stop = (w["start"] - prev["end"] > 0.65) | tx.ends_with_any(F.rtrim(prev["text"]), (".", "!", "?", ";", ":", "…"))
        return F.struct(
            i.alias("n"), w["start"].alias("start"), w["end"].alias("end"), w["text"].alias("text"),
            w["speaker"].alias("speaker"), w["probability"].alias("probability"),
            tx.bare_word(w["text"]).alias("norm"), ((i == 0) | F.coalesce(stop, F.lit(True))).alias("brk"),
            prev["end"].alias("prev_end"), prev["speaker"].alias("prev_speaker"),
        )

    d = clips.withColumn("words", F.transform(words, facts))
    words, kind = F.col("words"), F.col("moment_type")
    scores = F.create_map(*[x for k, v in lex.quantity_scores for x in (F.lit(k), F.lit(v))])

    def is_fact(w: Column) -> Column:
        return w["norm"].rlike(r"(?U)^\d+(?:[.,]\d+)?%?$") | w["norm"].isin(*[k for k, _ in lex.quantity_scores])

    def fact(w: Column) -> Column:
        digits = F.length(F.regexp_replace(w["norm"], r"(?U)\D", ""))
        score = F.when(digits > 0, 9.6 + F.least(F.lit(0.8), digits * 0.12)).otherwise(F.try_element_at(scores, w["norm"]))
        return F.when(
            is_fact(w),
            _cue(
                F.greatest(F.lit(0.35), tx.round2(w["start"] - 0.04)), tx.round2(score), "evidence",
                F.concat(F.lit("timed factual anchor: "), w["norm"]), fact_label(words, w["n"], lex),
            ),
        )

    def cue(w: Column) -> Column:
        return F.coalesce(question_cue(words, w["n"], kind, lex), lexical_cue(w, kind, lex))

    pause = max(0.50, max_pause_sec)

    def turns(w: Column) -> Column:
        resume = F.when(
            (w["n"] > 0) & (w["start"] - w["prev_end"] >= pause),
            _cue(w["start"] + 0.05, F.lit(7.7), "resume", F.lit("speech resumes after a meaningful pause")),
        )
        change = F.when(
            (w["n"] > 0) & (w["speaker"] != "") & (w["prev_speaker"] != "") & (w["speaker"] != w["prev_speaker"]),
            _cue(w["start"] + 0.04, F.lit(8.3), "speaker", F.lit("speaker change")),
        )
        return F.array(resume, change)

    return d.withColumns({
        "facts": F.array_compact(F.transform(words, fact)),
        "cues": F.array_compact(F.transform(words, cue)),
        # cues of words that are facts themselves never become accents
        "accent_cues": F.array_compact(F.transform(F.filter(words, lambda w: ~is_fact(w)), cue)),
        "turns": F.array_compact(F.flatten(F.transform(words, turns))),
    })


def _best_first(cues: Column) -> Column:
    """Sort by (-score, time), earlier input first on ties."""
    keyed = F.transform(
        cues, lambda c, i: F.struct((-c["score"]).alias("neg"), c["ts"].alias("t"), i.alias("i"), c.alias("c"))
    )
    return F.transform(F.sort_array(keyed), lambda k: k["c"])


def spaced_picks(sorted_cues: Column, min_gap: Column, limit: Column | None = None) -> Column:
    """Best first, each at least ``min_gap`` away from every pick, at most ``limit``."""

    def step(acc: Column, c: Column) -> Column:
        near = F.exists(acc, lambda e: F.abs(c["ts"] - e["ts"]) < min_gap)
        full = F.lit(False) if limit is None else F.size(acc) >= limit
        return F.when(near | full, acc).otherwise(F.array_append(acc, c))

    return F.aggregate(sorted_cues, F.array().cast(f"array<{_CUE}>"), step)


def _by_time(cues: Column) -> Column:
    keyed = F.transform(cues, lambda c, i: F.struct(c["ts"].alias("t"), i.alias("i"), c.alias("c")))
    return F.transform(F.sort_array(keyed), lambda k: k["c"])


def _clear_of(c: Column, cuts: Column, guard: float) -> Column:
    return ~F.exists(cuts, lambda t: F.abs(c["ts"] - t) < guard)


def with_accents(clips: DataFrame) -> DataFrame:
    """``accents``: up to two facts 6 s apart plus one strong audible cue, in time order."""
    cuts, dur = F.col("cuts"), F.col("duration")
    facts = F.filter(
        F.transform("facts", lambda c: c), lambda c: (c["ts"] <= dur - 1.1) & _clear_of(c, cuts, 0.18)
    )
    rounded = F.transform(
        F.filter("accent_cues", lambda c: c["kind"].isin("question", "reveal", "contrast")),
        lambda c: _cue(tx.round2(c["ts"]), tx.round2(c["score"]), c["kind"], c["reason"]),
    )
    audible = F.filter(
        rounded, lambda c: (c["score"] >= 9.0) & (c["ts"] <= dur - 1.1) & ~F.exists(cuts, lambda t: F.abs(c["ts"] - t) < 0.60)
    )
    picked = spaced_picks(_best_first(facts), F.lit(6.0), F.lit(2))
    return clips.withColumn("accents", _by_time(F.concat(picked, F.slice(_best_first(audible), 1, 1))))


def with_inner_cuts(clips: DataFrame) -> DataFrame:
    """Sort ``cuts`` and keep those inside (0.08, span - 0.4); adds ``span``."""
    d = clips.withColumn("span", F.greatest(F.lit(1.0), F.col("end") - F.col("start")))
    span = F.col("span")
    return d.withColumn("cuts", F.sort_array(F.filter("cuts", lambda t: (t > 0.08) & (t < span - 0.4))))


def with_shot_motion(clips: DataFrame) -> DataFrame:
    """``motions``: slow zooms over the first three shots of 4.2 s or more."""
    span, cuts = F.col("span"), F.col("cuts")
    bounds = F.concat(F.array(F.lit(0.0)), cuts, F.array(span))
    shots = F.filter(
        F.transform(
            F.slice(bounds, F.lit(1), F.size(bounds) - 1),
            lambda s, i: F.struct(i.alias("shot"), s.alias("start"), F.get(bounds, i + 1).alias("end")),
        ),
        lambda x: (x["end"] - x["start"] >= 4.2) & ((x["start"] >= 0.18) | (x["end"] >= 0.70)),
    )
    peak = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for kv in MOTION_SCALES.items() for x in kv]), F.col("profile")), F.lit(1.020)
    )

    def motion(x: Column, k: Column) -> Column:
        tail = F.when(x["end"] >= span - 0.05, 0.22).otherwise(0.04)
        low = F.when(k == 2, F.least(peak, F.lit(1.018))).when(k == 1, 1.008).otherwise(1.0)
        high = F.when(k == 2, 1.002).when(k == 1, peak).otherwise(F.least(peak, F.lit(1.022)))
        name = F.when(k == 2, "release").when(k == 1, "build").otherwise("push")
        return F.struct(
            tx.round2(x["start"]).alias("start"),
            tx.round2(F.greatest(x["start"] + 0.8, x["end"] - tail)).alias("end"),
            tx.round_to(low, 3).alias("scale_from"), tx.round_to(high, 3).alias("scale_to"),
            F.concat(F.lit("source shot "), x["shot"].cast("string"), F.lit(": cut-shaped "), name).alias("reason"),
        )

    motions = F.transform(F.slice(shots, 1, 3), motion)
    skip = (F.col("profile") == "clean") | (F.size(cuts) == 0)
    return clips.withColumn("motions", F.when(skip, F.slice(motions, 1, 0)).otherwise(motions))


def with_profile(clips: DataFrame) -> DataFrame:
    names = ("max_beats", "seconds_per_beat", "min_gap", "zoom", "beat_sec")
    d = clips
    for k, name in enumerate(names):
        table = F.create_map(*[F.lit(x) for p, v in MONTAGE_PROFILES.items() for x in (p, float(v[k]))])
        d = d.withColumn(f"p_{name}", F.coalesce(F.try_element_at(table, F.col("profile")), F.lit(float(MONTAGE_PROFILES["balanced"][k]))))
    return d


def beat_budget(p: EditParams = EditParams()) -> Column:
    """Number of generated beats; natural cuts are credited."""
    cuts, span = F.col("cuts"), F.col("span")
    by_time = F.greatest(F.lit(1), F.ceil(span / F.col("p_seconds_per_beat")))
    by_config = F.greatest(F.lit(1), F.floor(span / 10 * p.max_punch_zoom_per_10_sec))
    base = F.least(F.col("p_max_beats").cast("long"), by_time, by_config)
    opening = F.coalesce(F.get(cuts, F.lit(0)), span)
    floor = F.when(opening >= F.greatest(F.lit(4.8), F.col("p_min_gap")), 1).otherwise(0)
    budget = F.greatest(floor, base - F.floor((F.size(cuts) + 1) / 2)).cast("int")
    if p.max_punch_zoom_per_10_sec <= 0:
        return F.lit(0)
    return F.when(F.col("p_max_beats") <= 0, 0).otherwise(budget)


def with_beats(clips: DataFrame, p: EditParams = EditParams()) -> DataFrame:
    """``beats``: hook, cue, pause and speaker events, spaced and within the budget."""
    span, cuts, words = F.col("span"), F.col("cuts"), F.col("words")
    first = F.get(words, F.lit(0))["start"]
    spoken = F.when(F.coalesce(F.col("hook_text"), F.lit("")) != "", F.col("hook_text")).otherwise(F.col("text"))
    hook = F.when(
        first < 2.4, _cue(F.greatest(F.lit(0.45), first + 0.12), F.lit(10.5), "hook", F.lit("hook: first spoken phrase"))
    ).when(
        tx.strip_ws(F.coalesce(spoken, F.lit(""))) != "",
        _cue(F.lit(0.55), F.lit(9.8), "hook", F.lit("hook: transcript timing unavailable")),
    )
    d = clips.withColumn("budget", beat_budget(p))
    every = F.concat(F.array_compact(F.array(hook)), F.col("cues"), F.col("turns"))
    distinct = spaced_picks(_best_first(every), F.lit(0.55))
    guard = max(0.35, p.scene_guard_sec)
    ok = F.filter(distinct, lambda c: (c["ts"] >= 0.35) & (c["ts"] <= span - 1.45) & _clear_of(c, cuts, guard))
    chosen = spaced_picks(ok, F.greatest(F.col("p_min_gap"), F.lit(p.pattern_interrupt_every_sec)), F.col("budget"))

    def beat(c: Column) -> Column:
        strength = F.greatest(F.lit(0.55), F.least(F.lit(1.0), c["score"] / 10.5))
        return F.struct(
            tx.round2(c["ts"]).alias("ts"),
            tx.round2(F.greatest(F.lit(0.65), F.least(F.col("p_beat_sec"), span - c["ts"]))).alias("duration"),
            tx.round2(c["score"]).alias("score"), c["kind"].alias("kind"), c["reason"].alias("reason"),
            tx.round_to(1.0 + (F.col("p_zoom") - 1.0) * strength, 3).alias("scale_to"),
        )

    return d.withColumn("beats", F.transform(_by_time(chosen), beat))


def plan_cues(clips: DataFrame, segments: DataFrame, p: EditParams = EditParams(), lex: Lexicon = DEFAULT) -> DataFrame:
    """Clips with ``words``, ``facts``, ``cues``, ``accents``, ``motions`` and ``beats``.

    Needs project_id, id, start, end, duration, moment_type, profile, cuts
    (array of clip times), hook_text, suggested_title, text.
    """
    d = annotate_words(with_inner_cuts(spoken_words(clips, segments)), p.max_pause_sec, lex)
    return with_beats(with_profile(with_shot_motion(with_accents(d))), p)


_OP = "array<struct<type:string,start:double,end:double,text:string,scale_from:double,scale_to:double,reason:string>>"


def _op(kind: str, start=None, end=None, text=None, lo=None, hi=None, reason=None) -> Column:
    def c(x, t):
        return (F.lit(None) if x is None else (x if isinstance(x, Column) else F.lit(x))).cast(t)

    return F.struct(
        F.lit(kind).alias("type"), c(start, "double").alias("start"), c(end, "double").alias("end"),
        c(text, "string").alias("text"), c(lo, "double").alias("scale_from"), c(hi, "double").alias("scale_to"),
        c(reason, "string").alias("reason"),
    )


def edit_plan(planned: DataFrame, p: EditParams = EditParams()) -> DataFrame:
    """One row per clip: profile, strategy, counts and ordered ``operations``."""
    span = F.col("span")
    clean = F.col("profile") == "clean"

    def until(start: Column, length) -> Column:
        return tx.round2(F.least(span, start + length))

    none = F.array().cast(_OP)
    trim = F.array(_op("trim", F.col("start"), F.col("end"), reason="chosen clip boundaries"))
    if not p.enabled:
        return planned.select(
            "project_id", F.col("id").alias("clip_id"), "profile", F.lit("disabled").alias("strategy"),
            F.lit(0).alias("natural_cut_count"), F.lit(0).alias("generated_effect_count"), trim.cast(_OP).alias("operations"),
        )
    source_cuts = F.transform("cuts", lambda t: _op(
        "source_cut", tx.round2(t), until(t, 0.04), reason="existing shot change; suppress nearby generated effects"))
    title = F.coalesce(F.when(F.col("suggested_title") != "", F.col("suggested_title")), F.col("hook_text"))
    titles = F.array(_op("hook_title", 0.0, F.least(F.lit(2.5), span), title, reason="first seconds need a clear premise")) if p.hook_title_enabled else none
    zoom = tx.round_to(F.least(F.lit(1.045), F.greatest(F.lit(1.032), F.col("p_zoom"))), 3)

    def accent_ops(a: Column) -> Column:
        note = F.format_string("; score=%.1f", a["score"])
        stamp = F.when(a["text"] != "", _op(
            "evidence_stamp", a["ts"], until(a["ts"], 1.28), a["text"], reason=F.concat(a["reason"], note)))
        audible = a["kind"].isin("question", "reveal", "contrast")
        sound = F.when(audible, _op(
            "audio_accent", a["ts"], until(a["ts"], 0.18), a["kind"],
            reason=F.concat(F.lit("single semantic sound cue; "), a["reason"])))
        visual = F.when(audible & F.lit(p.punch_zoom_enabled), _op(
            "punch_zoom", a["ts"], until(a["ts"], 0.82), None, 1.0, zoom,
            F.concat(F.lit("paired semantic visual cue; "), a["reason"], note)))
        return F.array(stamp, sound, visual)

    accents = F.when(clean, none).otherwise(F.array_compact(F.flatten(F.transform("accents", accent_ops))).cast(_OP))
    motions = F.transform("motions", lambda m: _op("shot_motion", m["start"], m["end"], None, m["scale_from"], m["scale_to"], m["reason"]))

    def beat_ops(b: Column) -> Column:
        punch = _op("punch_zoom", b["ts"], until(b["ts"], b["duration"]), None, 1.0, b["scale_to"],
                    F.concat(b["reason"], F.format_string("; score=%.1f", b["score"])))
        flash = F.when(
            F.col("profile").isin("gaming", "meme") & b["kind"].isin("question", "reveal"),
            _op("micro_flash", b["ts"], until(b["ts"], 0.10), reason=F.concat(F.lit("accent "), b["kind"], F.lit(" beat"))))
        return F.array(punch, flash)

    d = planned.withColumn("_accents", accents)
    paired = F.exists("_accents", lambda o: o["type"] == "punch_zoom")
    use_beats = F.lit(p.punch_zoom_enabled) & (F.size("motions") == 0) & ~paired
    beats = F.when(use_beats, F.array_compact(F.flatten(F.transform("beats", beat_ops))).cast(_OP)).otherwise(none)
    closing = []
    if p.progress_bar_enabled:
        closing.append(_op("progress_bar", 0.0, span, reason="show clip duration"))
    if p.audio_normalization_enabled:
        closing.append(_op("audio_normalization", reason="normalize speech loudness"))
    parts = [trim, source_cuts, titles, F.col("_accents"), motions, beats] + ([F.array(*closing)] if closing else [])
    d = d.withColumn("operations", F.concat(*[x.cast(_OP) for x in parts]))
    return d.select(
        "project_id", F.col("id").alias("clip_id"), "profile",
        F.when(clean, "clean_native_v1").otherwise("semantic_tension_v1").alias("strategy"),
        F.size("cuts").alias("natural_cut_count"),
        F.size(F.filter("operations", lambda o: o["type"].isin(*GENERATED_EFFECTS))).alias("generated_effect_count"),
        "operations",
    )
