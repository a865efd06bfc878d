"""Text scores, penalties and moment types, staged as DataFrame steps.

Each step adds its intermediate results as columns first (normalised text,
flags) so that Catalyst evaluates every one of them once per row.
All steps expect text that was repaired at ingestion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelspan.functions import text as tx
from reelspan.lexicon import DEFAULT, QUALITY_PROBLEMS, SCORE_WEIGHTS, Lexicon

SCORE_NAMES = tuple(SCORE_WEIGHTS)


def fact(text: str, name: str) -> str:
    return f"_x_{name}_{text}"


def with_text_facts(df: DataFrame, text: str = "text") -> DataFrame:
    """What several steps ask about a text, as columns named by ``fact``: collapsed (clean), normalised (low), its first
    sentence and its tokens. Steps that find them do not compute them again; ``drop_text_facts`` takes them away."""
    d = df.withColumn(fact(text, "clean"), tx.collapse(F.col(text)))
    d = d.withColumns({
        fact(text, "low"): tx.normalize_clean(F.col(fact(text, "clean"))),
        fact(text, "first"): tx.first_sentence(F.col(fact(text, "clean"))),
    })
    return d.withColumn(fact(text, "words"), tx.tokens(F.col(fact(text, "low"))))


def drop_text_facts(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_x_")])


def _facts(df: DataFrame, text: str) -> DataFrame:
    return df if fact(text, "low") in df.columns else with_text_facts(df, text)


def _drop_temp(d: DataFrame, df: DataFrame) -> DataFrame:
    """Without what a step added to ``df`` for itself."""
    return d.drop(*[c for c in d.columns if c.startswith("_s_") or (c.startswith("_x_") and c not in df.columns)])


def _problem_list(*pairs) -> Column:
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def with_quality_penalty(
    df: DataFrame, text: str = "text", lex: Lexicon = DEFAULT,
    penalty: str = "quality_penalty", problems: str = "quality_problems",
) -> DataFrame:
    norm, words = F.col(fact(text, "low")), F.col(fact(text, "words"))
    d = _facts(df, text).withColumns({
        "_s_evidence": tx.commercial_evidence(F.col(text), norm, lex),
        "_s_generic": sum([norm.contains(p).cast("int") for p in lex.generic], F.lit(0)),
        "_s_low": sum([norm.contains(p).cast("int") for p in lex.low_information], F.lit(0)),
    })
    d = d.withColumns({
        "_s_ad": tx.is_commercial(F.col("_s_evidence")),
        "_s_n": F.size(words),
        "_s_unique": F.size(F.array_distinct(words)) / F.greatest(F.lit(1), F.size(words)),
    })
    ad, n = F.col("_s_ad"), F.col("_s_n")
    generic, low = F.col("_s_generic"), F.col("_s_low")
    repetitive = (n >= 12) & (F.col("_s_unique") < 0.45)
    empty = norm == ""
    total = (
        F.when(ad, F.least(F.lit(70), 28 + F.size("_s_evidence") * 12)).otherwise(0)
        + F.when(generic > 0, F.least(F.lit(60), 34 + generic * 8)).otherwise(0)
        + F.when(low > 0, F.least(F.lit(35), 15 + low * 8)).otherwise(0)
        + F.when(n < 8, 12).otherwise(0)
        + F.when(repetitive, 12).otherwise(0)
    )
    d = d.withColumns({
        penalty: F.when(empty, F.lit(35)).otherwise(F.least(F.lit(95), total)).cast("double"),
        problems: F.when(empty, F.array(F.lit("empty text"))).otherwise(
            _problem_list(
                ("ad or CTA language", ad),
                ("generic clip-analysis text", generic > 0),
                ("low-information intro/outro", low > 0),
                ("too little speech", n < 8),
                ("repetitive speech", repetitive),
            )
        ),
    })
    return _drop_temp(d, df)


def _joined_facts(df: DataFrame, out: str, parts: tuple[str, ...]) -> DataFrame:
    """Normalised text and tokens of ``out``, the ``parts`` with blanks between them, the first of which has its facts:
    neither reaches over a blank."""
    d = df.withColumns({f"_j_{c}": tx.normalize_clean(tx.collapse(F.col(c))) for c in parts[1:]})
    lows = [F.col(fact(parts[0], "low")), *[F.col(f"_j_{c}") for c in parts[1:]]]
    words = [F.col(fact(parts[0], "words")), *[tx.tokens(x) for x in lows[1:]]]
    none = F.array().cast("array<string>")
    return d.withColumns({
        fact(out, "low"): F.concat_ws(" ", *[F.when(x != "", x) for x in lows]),
        fact(out, "words"): F.concat(*[F.coalesce(w, none) for w in words]),
    }).drop(*[f"_j_{c}" for c in parts[1:]])


def apply_quality_penalty(df: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Subtract the penalty from the three scores unless it was applied before."""
    full = F.concat_ws(
        " ", *[F.when(F.col(c) != "", F.col(c)) for c in ("text", "summary", "hook_text")]
    )
    d = df.withColumn("_q_text", full)
    if fact("text", "low") in df.columns:
        d = _joined_facts(d, "_q_text", ("text", "summary", "hook_text"))
    d = with_quality_penalty(d, "_q_text", lex, "_q_penalty", "_q_problems").drop(*[fact("_q_text", n) for n in ("low", "words")]).withColumn(
        "_q_apply",
        ~F.arrays_overlap("problems", tx.lit_array(QUALITY_PROBLEMS)) & (F.col("_q_penalty") > 0),
    )
    apply, pen = F.col("_q_apply"), F.col("_q_penalty")
    changed = {
        s: F.when(apply, tx.round2(F.greatest(F.lit(0.0), F.col(s) - pen))).otherwise(F.col(s))
        for s in ("base_score", "personal_score", "final_score")
    }
    changed["problems"] = F.when(
        apply, F.array_distinct(F.concat("problems", "_q_problems"))
    ).otherwise(F.col("problems"))
    changed["reason"] = F.when(
        apply,
        F.concat(
            "reason", F.format_string(" Quality penalty: -%.0f for ", pen),
            F.array_join("_q_problems", ", "), F.lit("."),
        ),
    ).otherwise(F.col("reason"))
    return d.withColumns(changed).drop("_q_text", "_q_penalty", "_q_problems", "_q_apply")


def filter_quality(df: DataFrame, min_score: float, n: int, lex: Lexicon = DEFAULT) -> DataFrame:
    """Penalise, drop advertising and weak rows, keep the best n per recording."""
    from reelspan.operators.ranking import top_per_key

    kept = tx.settle(apply_quality_penalty(df, lex), "final_score", "problems").where(
        (F.col("final_score") >= min_score) & ~F.array_contains("problems", "ad or CTA language")
    )
    return top_per_key(kept, ["project_id"], [F.desc("final_score"), F.asc("id")], n)


def with_structural_penalty(
    df: DataFrame, text: str = "text", lex: Lexicon = DEFAULT,
    penalty: str = "arc_penalty", problems: str = "arc_problems",
) -> DataFrame:
    clean, norm, words = (F.col(fact(text, n)) for n in ("clean", "low", "words"))
    d = _facts(df, text).withColumn("_s_hook", tx.hook_of(F.col(fact(text, "first"))))
    d = d.withColumns({
        "_s_first": tx.normalize_clean(F.col("_s_hook")),
        "_s_concrete": tx.has_concrete_payoff(norm, lex),
    })
    hook, first = F.col("_s_hook"), F.col("_s_first")
    d = d.withColumns({
        "_s_strong": hook.contains("?") | hook.contains("!") | tx.has_number(first),
        "_s_last": F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")),
        # earliest reset phrase, 0-based; -1 when there is none
        "_s_reset": F.coalesce(
            F.array_min(F.array_compact(F.array(*[
                F.when(norm.contains(p), F.instr(norm, p) - 1) for p in lex.topic_resets
            ]))),
            F.lit(-1),
        ),
    })
    concrete = F.col("_s_concrete")
    rules = [
        ("dependent opening", 14, tx.starts_with_any(first, lex.dependent_openings) & ~F.col("_s_strong")),
        ("filler opening", 18, tx.starts_with_any(first, lex.filler_openings)),
        ("teaser without payoff", 38, tx.contains_any(norm, lex.arc_teasers) & ~concrete),
        ("mixed topics", 26, (F.col("_s_reset") >= 0) & (F.col("_s_reset") > F.length(norm) * 0.25)),
        (
            "unfinished ending", 22,
            tx.ends_with_any(clean, (",", ";", ":", "...", "…")) | F.col("_s_last").isin(*lex.dangling),
        ),
        ("unanswered question", 28, clean.endswith("?")),
        (
            "weak payoff", 9,
            ~concrete & (F.size(words) >= 18) & ~clean.contains("?") & ~clean.contains("!"),
        ),
    ]
    d = d.withColumn(problems, _problem_list(*[(name, cond) for name, _, cond in rules]))
    points = sum(
        [F.when(F.array_contains(problems, name), F.lit(float(p))).otherwise(0.0) for name, p, _ in rules],
        F.lit(0.0),
    )
    return _drop_temp(d.withColumn(penalty, points), df)


def with_moment_type(
    df: DataFrame, text: str = "text", lex: Lexicon = DEFAULT, out: str = "moment_type"
) -> DataFrame:
    d, low = _facts(df, text), F.col(fact(text, "low"))

    def has(words):
        return tx.contains_any(low, words)

    kind = (
        F.when(low.contains(lex.design_marker), "before_after")
        .when(has(lex.meme_markers), "comedy")
        .when(tx.has_quantity(low, lex) & tx.has_result(low, lex), "metric_reveal")
        .when(has(lex.humor), "comedy")
        .when(has(lex.controversial), "controversial_take")
        .when(F.col(text).contains("?"), "question_answer")
        .when(has(lex.before_after), "before_after")
        .when(has(lex.how_to), "how_to")
        .when(has(lex.warning), "warning")
        .when(has(lex.result), "result")
        .when(has(lex.personal_story), "personal_story")
        .otherwise("insight")
    )
    return _drop_temp(d.withColumn(out, kind), df)


def with_text_signs(df: DataFrame, text: str = "text", lex: Lexicon = DEFAULT) -> DataFrame:
    """What ``with_text_scores`` asks about the text alone, as columns named by ``fact``."""
    d = _facts(df, text).withColumn("_s_phrase", tx.first_words(F.col(fact(text, "first")), 16))
    d = d.withColumn("_s_first", tx.normalize_clean(F.col("_s_phrase")))
    clean, low, words = (F.col(fact(text, n)) for n in ("clean", "low", "words"))
    first, phrase = F.col("_s_first"), F.col("_s_phrase")

    def flag(c: Column) -> Column:
        return c.cast("int")

    signs = {
        "n": F.size(words),
        "q": F.length(clean) - F.length(F.replace(clean, F.lit("?"), F.lit(""))),
        "ex": F.length(clean) - F.length(F.replace(clean, F.lit("!"), F.lit(""))),
        "conflict": flag(tx.contains_any(low, lex.controversial)),
        "story": flag(tx.contains_any(low, lex.personal_story)),
        "result": flag(tx.has_result(low, lex)),
        "quantity": flag(tx.has_quantity(low, lex)),
        "humor": flag(tx.contains_any(low, lex.humor)),
        "contrast": flag(tx.contains_any(low, lex.contrast)),
        "dependent": flag(tx.starts_with_any(first, lex.dependent_openings)),
        "teaser": flag(tx.contains_any(low, lex.score_teasers)),
        "unfinished": flag(
            tx.ends_with_any(clean, (",", ";", ":"))
            | F.coalesce(F.try_element_at(words, F.lit(-1)).isin(*lex.dangling), F.lit(False))
        ),
        "hooked": phrase.contains("?") | phrase.contains("!") | tx.has_quantity(first, lex),
    }
    return d.withColumns({fact(text, n): c for n, c in signs.items()}).drop("_s_phrase", "_s_first")


SIGNS = (
    "n", "q", "ex", "conflict", "story", "result", "quantity", "humor", "contrast", "dependent", "teaser", "unfinished", "hooked",
)


def with_text_scores(
    df: DataFrame, text: str = "text", duration: str = "duration", lex: Lexicon = DEFAULT
) -> DataFrame:
    """Ten 0-100 scores of one interval's text."""
    d = df if fact(text, "hooked") in df.columns else with_text_signs(df, text, lex)
    dur = F.col(duration).cast("double")
    n, q, ex, conflict, story, result, quantity, humor, contrast, dependent, teaser, unfinished, hooked = (
        F.col(fact(text, s)) for s in SIGNS
    )
    d = d.withColumns({
        "_s_rate": n / F.greatest(dur, F.lit(1.0)),
        "_s_hook": q * 11 + ex * 5 + quantity * 14 + conflict * 12
        - F.when((dependent == 1) & ~hooked, 22).otherwise(0) - teaser * 18,
        "_s_payoff": ((result == 1) | (quantity == 1) | ((contrast == 1) & (unfinished == 0))).cast("int"),
    })
    rate, hook, payoff = F.col("_s_rate"), F.col("_s_hook"), F.col("_s_payoff")
    raw = {
        "semantic_interest_score": (
            38 + conflict * 16 + story * 5 + result * 18 + quantity * 12 + humor * 12 + q * 6 - teaser * 20, 0),
        "hook_score": (36 + hook, 0),
        "clarity_score": (
            78 - dependent * 20 - teaser * 20 - unfinished * 16
            - F.greatest(F.lit(0.0), dur - 42) * 0.7, 0),
        "emotion_score": (
            38 + conflict * 15 + story * 7 + humor * 16 + q * 5 + ex * 8 + quantity * 5, 0),
        "novelty_score": (40 + conflict * 14 + result * 15 + quantity * 14 + humor * 14, 0),
        "standalone_score": (76 - dependent * 24 - teaser * 28 - unfinished * 24 + payoff * 14, 0),
        "retention_score": (
            40 + F.greatest(F.lit(0), hook) * 0.62 + payoff * 16 + contrast * 8 + humor * 12 - teaser * 20, 0),
        "speech_density_score": (rate * 28, 25),
        "audio_energy_score": (
            36 + F.least(F.lit(28), ex * 8) + F.least(F.lit(12), q * 4) + F.least(F.lit(20.0), rate * 7), 0),
    }
    d = d.withColumns({n: tx.clamp(x.cast("double"), float(lo), 100.0) for n, (x, lo) in raw.items()})
    return _drop_temp(d.withColumn("visual_energy_score", F.lit(45.0)), df)


def base_score() -> Column:
    """Weighted sum of the ten score columns."""
    total = sum(
        [tx.clamp(F.coalesce(F.col(n), F.lit(0.0)), 0.0, 100.0) * w for n, w in SCORE_WEIGHTS.items()],
        F.lit(0.0),
    )
    return tx.round2(tx.clamp(total, 0.0, 100.0))


def combine_personal_score(base: Column, learned: Column, weight: float = 0.35) -> Column:
    w = max(0.0, min(1.0, weight))
    return tx.round2(tx.clamp(base * (1 - w) + learned * w, 0.0, 100.0))
