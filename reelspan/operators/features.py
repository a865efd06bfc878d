"""Feature rows of moments and the labelled training set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from reelspan.functions import scoring as sc, text as tx
from reelspan.lexicon import DEFAULT, Lexicon
from reelspan.operators import events as ev

# FIXED VALUES: feature names in order.
SCORES = (
    "semantic_interest_score", "hook_score", "clarity_score", "emotion_score", "novelty_score",
    "standalone_score", "retention_score", "speech_density_score", "audio_energy_score", "visual_energy_score",
)
NUMERIC = (
    "duration", "word_count", "words_per_second", *SCORES, "speaker_count", "speaker_switches", "dialogue_score",
    "base_score", "quality_penalty", "starts_with_hook", "has_conflict", "has_story", "has_result", "is_ad_like",
    "is_generic_clip_text", "is_low_information",
)
FLAGS = NUMERIC[-7:]
PERCENT = (*SCORES, "dialogue_score", "base_score")
FEATURES_TYPE = T.StructType(
    [T.StructField("moment_type", T.StringType())] + [T.StructField(n, T.DoubleType()) for n in NUMERIC]
)


def valid_features(f: Column) -> Column:
    """All numbers finite and in range, flags 0 or 1."""
    checks = []
    for n in NUMERIC:
        x = f[n]
        top = 100.0 if n in PERCENT else 1.0 if n in FLAGS else 1.7976931348623157e308
        checks.append(x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x <= top))
        if n in FLAGS:
            checks.append((x == 0) | (x == 1))
    return F.coalesce(reduce(lambda a, b: a & b, checks), F.lit(False))


def with_features(df: DataFrame, lex: Lexicon = DEFAULT, out: str = "features") -> DataFrame:
    """Add the 26-feature struct; null where a value breaks its rule. Missing columns count as 0."""
    have = set(df.columns)

    def col(name: str, kind: str) -> Column:
        base = F.col(name) if name in have else F.lit(None)
        return F.coalesce(base.cast(kind), F.lit("" if kind == "string" else 0.0).cast(kind))

    full = F.concat_ws(" ", *[col(n, "string") for n in ("text", "summary", "hook_text")])
    d = sc.with_quality_penalty(df.withColumn("_f_full", full), "_f_full", lex, "_f_penalty", "_f_problems")
    kind = F.trim(col("moment_type", "string"))
    words = tx.n_words(col("text", "string")).cast("double")
    low = F.lower("_f_full")

    def flag(c: Column) -> Column:
        return c.cast("int").cast("double")

    def problem(name: str) -> Column:
        return flag(F.array_contains("_f_problems", name))

    special = {
        "word_count": words, "words_per_second": words / F.greatest(col("duration", "double"), F.lit(1.0)),
        "quality_penalty": F.col("_f_penalty"), "starts_with_hook": flag(col("hook_text", "string") != ""),
        "has_conflict": flag(kind == "controversial_take"), "has_story": flag(kind == "personal_story"),
        "has_result": flag(tx.contains_any(low, lex.feature_results)), "is_ad_like": problem("ad or CTA language"),
        "is_generic_clip_text": problem("generic clip-analysis text"),
        "is_low_information": problem("low-information intro/outro"),
    }
    struct = F.struct(
        F.when(kind == "", "unknown").otherwise(kind).alias("moment_type"),
        *[special.get(n, col(n, "double")).alias(n) for n in NUMERIC],
    )
    d = d.withColumn("_f", struct)
    return d.withColumn(out, F.when(valid_features(F.col("_f")), F.col("_f"))).drop(
        "_f", "_f_full", "_f_penalty", "_f_problems"
    )


def parse_snapshot(json: Column) -> Column:
    """Stored feature JSON as struct; null if damaged, out of range, or holding explicit nulls.

    Absent keys take their defaults (0, type 'unknown').
    """
    schema = T.StructType([*FEATURES_TYPE.fields, T.StructField("_damaged", T.StringType())])
    raw = F.from_json(json, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"})
    flat = F.from_json(json, "map<string,string>")
    filled = F.struct(
        F.when(F.trim(F.coalesce(raw["moment_type"], F.lit(""))) == "", "unknown")
        .otherwise(F.trim(raw["moment_type"])).alias("moment_type"),
        *[F.coalesce(raw[n], F.lit(0.0)).alias(n) for n in NUMERIC],
    )
    ok = (
        raw["_damaged"].isNull() & flat.isNotNull() & json.rlike(r"^\s*\{")
        & ~F.exists(F.map_values(flat), lambda v: v.isNull())
    )
    return F.when(F.coalesce(ok, F.lit(False)) & valid_features(filled), filled)


def labeled_rows(decisions: DataFrame, lex: Lexicon = DEFAULT) -> DataFrame:
    """Rows fit for training: a label, valid features, a known type.

    An existing snapshot is final: if it is damaged the row is dropped, never
    refilled from mutable moment data. Only rows without one use the moment's
    columns (prefix ``m_``).
    """
    d = decisions.withColumn("label", ev.label()).where(F.col("label").isNotNull())
    d = d.withColumn("_snap", parse_snapshot(F.col("features_json")))
    fallback_cols = [c for c in d.columns if c.startswith("m_")]
    m = d.select("*", *[F.col(c).alias(c[2:]) for c in fallback_cols if c[2:] not in d.columns])
    m = with_features(m, lex, "_live").drop(*[c[2:] for c in fallback_cols if c[2:] not in d.columns])
    m = m.withColumn("features", F.when(F.col("features_json").isNotNull(), F.col("_snap")).otherwise(F.col("_live")))
    m = tx.settle(m, "features").where(F.col("features").isNotNull() & (F.col("features.moment_type") != "unknown")).drop("_snap", "_live")
    return m.withColumns({n: ev.metric_value(n) for n in ev.METRIC_NAMES})
