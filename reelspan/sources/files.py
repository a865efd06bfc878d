"""Readers: transcripts, tables, probes, shot-change logs, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelspan import schemas
from reelspan.functions import media as md, text as tx
from reelspan.operators.chain import greedy_spacing
from reelspan.operators.scan import running
from reelspan.operators.segment import repair_transcript


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A stored table with its declared schema (parquet: pruning and pushdown apply)."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{base}/{name}")


def read_transcripts(spark: SparkSession, path: str, repair: bool = True) -> DataFrame:
    """One row per transcript document, text repaired once at ingestion."""
    d = spark.read.schema(schemas.TRANSCRIPT).option("multiLine", True).json(path)
    return repair_transcript(d) if repair else d


def scan_transcripts(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Transcript documents as semi-structured values: one row per JSON document, columns ``file`` and ``doc``. A file is a
    document or, with ``lines``, has one per line; such files are split between tasks.

    Nothing is unfolded here; ``segment_rows`` turns a document into a row per segment while it is read, so a recording of
    ten hours is thousands of small rows, never an array that is copied from step to step.
    """
    d = spark.read.option("singleVariantColumn", "doc").option("multiLine", not lines).json(path)
    return d.select(F.col("_metadata.file_path").alias("file"), "doc")


def segment_rows(scan: DataFrame, repair: bool = True) -> DataFrame:
    """(project_id, pos, start, end, text, speaker, words, changed) of every segment of ``scan_transcripts``.

    A document may be a part of a recording: ``first`` is the position of its first segment (0 without it). Values of a wrong
    type are null, other fields are ignored; documents without a list of segments have none. With ``repair`` damaged text
    of segments and words is mended here, once, and ``changed`` tells where.
    """
    heads = scan.select(
        F.try_variant_get("doc", F.lit("$.project_id"), "string").alias("project_id"),
        F.coalesce(F.try_variant_get("doc", F.lit("$.first"), "long"), F.lit(0)).alias("first"),
        F.try_variant_get("doc", F.lit("$.segments"), "variant").alias("s"),
    )
    d = scan.sparkSession.sql("SELECT h.project_id, h.first, t.pos AS i, t.key, t.value AS v FROM {h} h, LATERAL variant_explode(h.s) t", h=heads)
    d = d.where("key IS NULL")  # an object in place of the list has no segments
    kinds = {"start": "double", "end": "double", "text": "string", "speaker": "string", "words": f"array<{schemas.WORD}>"}
    d = d.select("project_id", (F.col("first") + F.col("i")).cast("long").alias("pos"), *[F.try_variant_get("v", F.lit(f"$.{k}"), t).alias(k) for k, t in kinds.items()])
    if not repair:
        return d.withColumn("changed", F.lit(False))
    d = d.withColumns({
        "_text": tx.repair_mojibake(F.col("text")),
        "_words": F.transform("words", lambda w: w.withField("word", tx.repair_mojibake(w["word"]))),
    })
    same = F.col("text").eqNullSafe(F.col("_text")) & F.col("words").eqNullSafe(F.col("_words"))
    return d.select("project_id", "pos", "start", "end", F.col("_text").alias("text"), "speaker", F.col("_words").alias("words"), (~same).alias("changed"))


def transcript_documents(segments: DataFrame) -> DataFrame:
    """(project_id, segments, words, duration, text_changed) per recording from ``segment_rows``; sums only, no text is gathered."""
    return segments.groupBy("project_id").agg(
        F.count("*").alias("segments"), F.sum(F.coalesce(F.size("words"), F.lit(0))).alias("words"), F.max("end").alias("duration"),
        F.bool_or("changed").alias("text_changed"))


def transcript_segments(transcripts: DataFrame) -> DataFrame:
    """Segments with their 0-based position."""
    return transcripts.select("project_id", F.posexplode("segments").alias("pos", "s")).select(
        "project_id", F.col("pos").cast("long").alias("pos"), "s.start", "s.end", "s.text", "s.speaker", "s.words"
    )


def transcript_words(segments: DataFrame) -> DataFrame:
    return segments.select("project_id", F.col("pos").alias("seg_pos"), F.posexplode("words").alias("word_pos", "w")).select(
        "project_id", "seg_pos", "word_pos", "w.*"
    )


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PROBE).json(path)


def parse_probes(raw: DataFrame, json: str = "json") -> DataFrame:
    """Probe JSON text column to typed metadata columns."""
    d = raw.withColumn("_p", F.from_json(F.col(json), schemas.PROBE))
    d = d.withColumns({"streams": F.col("_p.streams"), "format": F.col("_p.format")})
    return d.withColumns(md.probe_columns()).drop("_p", json)


def parse_scene_log(lines: DataFrame, durations: DataFrame, min_gap: float = 0.25) -> DataFrame:
    """Shot changes (project_id, ts) from log lines (project_id, line).

    Stamps too close to the edges are dropped, the rest is thinned so that every
    kept one lies ``min_gap`` or more after the last kept one. ``durations``:
    project_id, duration.
    """
    stamps = F.regexp_extract_all("line", F.lit(r"pts_time:([0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    d = lines.select("project_id", F.explode(stamps).alias("t")).select(
        # whole centiseconds keep the 0.25 s rule exact
        "project_id", F.round(F.col("t").cast("decimal(18,6)") * 100).cast("long").alias("cs")
    )
    d = d.join(durations, "project_id").where((F.col("cs") > 8) & (F.col("cs") < F.round(F.col("duration") * 100) - 40))
    d = d.select("project_id", "cs").distinct()  # an equal stamp is never far enough away
    d = running(d, ["project_id"], ["cs"], F.floor(F.col("cs") / 360000), {"pos": ("sum", F.lit(1))})
    kept = greedy_spacing(d, "project_id", "cs", round(min_gap * 100), "pos", chunk=6000)
    return kept.select("project_id", (F.col("cs") / 100.0).alias("ts"))


def parse_suggestions(responses: DataFrame, preferred_sec: float = 28.0) -> DataFrame:
    """Valid suggestions of (project_id, window_id, response) rows.

    The response must be a JSON array. One invalid item rejects its whole
    response. A missing end means start + preferred duration.
    """
    d = responses.withColumn("_items", F.from_json("response", f"array<struct<{schemas.SUGGESTION[7:-1]},_damaged:string>>", {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}))
    bad = F.exists(
        "_items",
        lambda s: s["start"].isNull() | F.isnan(s["start"]) | (s["start"] < 0) | F.coalesce(s["end"] <= s["start"], F.lit(False)),
    )
    d = d.where(F.col("_items").isNotNull() & ~bad & F.col("response").rlike(r"^\s*\["))
    d = d.select("project_id", "window_id", F.posexplode("_items").alias("item", "s"))
    text = {"summary": "", "moment_type": "insight", "hook_text": "", "reason": "Local LLM suggested this moment."}
    end = F.coalesce(F.when(F.col("s.end") != 0, F.col("s.end")), F.col("s.start") + preferred_sec)
    return d.select(
        "project_id", F.format_string("suggested_%s_%s", F.col("window_id").cast("string"), F.col("item").cast("string")).alias("id"),
        F.col("s.start").alias("start"), end.alias("end"),
        *[F.coalesce(F.col(f"s.{k}"), F.lit(v)).alias(k) for k, v in text.items()],
    ).where(F.col("end") > F.col("start"))
