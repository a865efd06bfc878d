"""Probe and render checks; the metadata rows are shaped from the event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reelspan.catalog import sql as S
from reelspan.catalog.sql import r
from reelspan.catalog.text import mended
from reelspan.functions import media as md
from reelspan.functions.text import round_to
from reelspan.session import ensure_checkpoint_dir
from reelspan.sources import adapters as ad, files as fl

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def _probe_json(spark, sf):
    """Streams: a cover picture first on every fifth row, video unless id mod 11 = 0, audio unless id mod 4 = 1."""
    i = F.col("event_id")

    def stream(kind, codec, extra):
        return F.concat(F.lit(f'{{"codec_type":"{kind}","codec_name":"{codec}"'), extra, F.lit("}"))

    cover = F.when(i % 5 == 0, stream("video", "mjpeg", F.lit(',"disposition":{"attached_pic":1},"width":9,"height":9')))
    dur = F.when(i % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(',"duration":"'), F.format_string("%.2f", "value"), F.lit('"')))
    rate = F.when(i % 2 == 0, F.lit("30000/1001")).when(i % 7 == 0, F.lit("0/0")).otherwise(F.lit("25"))
    video = F.when(i % 11 != 0, stream("video", "h264", F.concat(dur, F.lit(',"width":1080,"height":1920,"avg_frame_rate":"'), rate, F.lit('"'))))
    audio = F.when(i % 4 != 1, stream("audio", "aac", F.concat(F.lit(',"duration":"'), F.format_string("%.2f", F.col("value") + 1), F.lit('"'))))
    fmt = F.when(i % 13 == 0, F.lit('"N/A"')).otherwise(F.format_string('"%.2f"', F.col("value") + 2))
    js = F.concat(F.lit('{"streams":['), F.concat_ws(",", cover, video, audio), F.lit('],"format":{"duration":'), fmt, F.lit("}}"))
    return ad.table(spark, sf, "events").select(i.alias("id"), "value", js.alias("json"))


PROBE = """p AS (SELECT event_id AS id, value, event_id % 11 <> 0 AS has_v, event_id % 4 <> 1 AS has_a,
  CASE WHEN event_id % 11 <> 0 AND event_id % 3 <> 0 THEN round(value, 2) ELSE 0 END AS dv, CASE WHEN event_id % 4 <> 1 THEN round(value + 1, 2) ELSE 0 END AS da,
  CASE WHEN event_id % 13 <> 0 THEN round(value + 2, 2) ELSE 0 END AS df FROM events)"""


@query(f"""WITH {PROBE} SELECT id, {r('CASE WHEN dv > 0 THEN dv WHEN df > 0 THEN df ELSE da END')} AS duration, CASE WHEN has_v THEN 1080 ELSE 0 END AS width,
 {r('CASE WHEN NOT has_v THEN 0 WHEN id % 2 = 0 THEN 30000 / 1001.0::DOUBLE WHEN id % 7 = 0 THEN 0 ELSE 25 END', 4)} AS fps,
 CASE WHEN has_v THEN 'h264' ELSE '' END AS video_codec, CASE WHEN has_a THEN 'aac' ELSE '' END AS audio_codec,
 {r('CASE WHEN dv > 0 THEN dv WHEN da > 0 THEN da ELSE df END')} AS target_duration,
 CASE WHEN dv > 0 THEN 'video' WHEN da > 0 THEN 'audio' WHEN df > 0 THEN 'format' ELSE 'unknown' END AS target_source FROM p""")
def media_probe(spark, sf):
    d = fl.parse_probes(_probe_json(spark, sf))
    return d.select("id", round_to(F.col("duration"), 2).alias("duration"), "width", round_to(F.col("fps"), 4).alias("fps"), "video_codec",
                    "audio_codec", round_to(F.col("target_duration"), 2).alias("target_duration"), "target_source")


@query(f"""WITH {PROBE} SELECT id, dv >= 0.5 AND (da <= 0 OR dv >= da - greatest(2.0, least(20.0, da * 0.02))) AS usable FROM p""")
def usable_audio(spark, sf):
    d = fl.parse_probes(_probe_json(spark, sf))
    v, a = md.video_stream(F.col("streams")), md.audio_stream(F.col("streams"))
    return d.select("id", md.usable_duration(md.seconds(v["duration"]), md.seconds(a["duration"])).alias("usable"))


def _renders(spark, sf):
    """Rendered files that deviate from the plan in length, canvas, frames or streams."""
    i, v = F.col("event_id"), F.col("value")
    stream = "struct<codec_type:string,codec_name:string,duration:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,disposition:struct<attached_pic:int>>"

    def s(kind, dur, w, h, frames):
        return F.struct(F.lit(kind).alias("codec_type"), F.lit("x").alias("codec_name"), dur.cast("string").alias("duration"), w.cast("int").alias("width"),
                        h.cast("int").alias("height"), F.lit("30").alias("avg_frame_rate"), F.lit("30").alias("r_frame_rate"), frames.cast("string").alias("nb_frames"),
                        F.struct(F.lit(0).alias("attached_pic")).alias("disposition")).cast(stream)

    plan = F.round(v, 2)
    video = F.when(i % 10 != 3, s("video", plan + 1 - i % 4, F.when(i % 9 == 0, 720).otherwise(1080), F.lit(1920), F.floor((plan + 1) * 30) - i % 40))
    audio = F.when(i % 8 != 5, s("audio", plan + 1 + i % 3 - 1, F.lit(0), F.lit(0), F.lit(0)))
    return ad.table(spark, sf, "events").select(i.alias("id"), plan.alias("duration"), F.array_compact(F.array(video, audio)).alias("streams"))


@query("""WITH p AS (SELECT event_id AS id, CAST(round(value, 2) AS DECIMAL(12,2)) AS d FROM events),
 x AS (SELECT id, d, CAST(d AS DOUBLE) + 1.0::DOUBLE AS ex, id % 10 <> 3 AS hv, id % 8 <> 5 AS ha, greatest(0, d + 1 - id % 4) AS dv, CASE WHEN id % 9 = 0 THEN 720 ELSE 1080 END AS w,
   floor((CAST(d AS DOUBLE) + 1) * 30) - id % 40 AS fr, greatest(0, d + 1 + id % 3 - 1) AS da FROM p)
 SELECT id, (hv AND w = 1080 AND dv >= ex - 0.22 AND NOT (fr <> 0 AND fr < trunc((ex - 0.22::DOUBLE) * 30)) AND ha AND NOT ((da > 0 AND da < ex - 0.22) OR da > ex + 0.65)) AS ok,
  array_to_string(list_filter([CASE WHEN NOT hv THEN 'video' END, CASE WHEN hv AND w <> 1080 THEN 'canvas' END, CASE WHEN hv AND dv < ex - 0.22 THEN 'short' END,
   CASE WHEN hv AND fr <> 0 AND fr < trunc((ex - 0.22::DOUBLE) * 30) THEN 'frames' END, CASE WHEN NOT ha THEN 'audio' END,
   CASE WHEN ha AND ((da > 0 AND da < ex - 0.22) OR da > ex + 0.65) THEN 'audio length' END], lambda v: v IS NOT NULL), ',') AS kinds FROM x""")
def render_quality(spark, sf):
    d = _renders(spark, sf)
    d = d.withColumns(md.render_report(F.col("duration"), F.col("streams")))
    kind = F.transform("errors", lambda e: (
        F.when(e.startswith("missing video"), "video").when(e.startswith("unexpected"), "canvas").when(e.startswith("video stream"), "short")
        .when(e.startswith("video has"), "frames").when(e.startswith("missing audio"), "audio").otherwise("audio length")))
    return d.select("id", "ok", F.array_join(kind, ",").alias("kinds"))


# Every third recording was decoded wrongly once; a recording comes in documents of 64 segments.
_FILES = f"""WITH {S.SEGMENTS}, hexed AS (SELECT project_id, pos, "start", "end", speaker, text AS whole, hex(encode(text)) AS h FROM segments),
src AS (SELECT {{'p': project_id, 'i': pos}} AS k, CASE WHEN project_id % 3 = 0
  THEN array_to_string(list_transform(range(1, length(h), 2), lambda i: chr(CAST('0x' || substr(h, i, 2) AS INT))), '') ELSE whole END AS text FROM hexed),
{mended('src', 'k')}"""


@query(_FILES + f""" SELECT CAST(k.p AS VARCHAR) AS project_id, k.i AS pos, {r('"start"', 4)} AS "start", {r('"end"', 4)} AS "end", speaker, md5(repaired) AS text, mended.text <> repaired AS changed
 FROM mended JOIN segments g ON g.project_id = k.p AND g.pos = k.i""")
def transcript_files(spark, sf):
    """Recordings written as JSON documents and read back by segment, damaged text mended."""
    d = fl.segment_rows(fl.scan_transcripts(spark, _written(spark, sf), lines=True))
    return d.select("project_id", "pos", round_to(F.col("start"), 4).alias("start"), round_to(F.col("end"), 4).alias("end"), "speaker",
                    F.md5(F.col("text").cast("binary")).alias("text"), "changed")


@query(_FILES + f""" SELECT CAST(k.p AS VARCHAR) AS project_id, count(*) AS segments, {r('max("end")', 4)} AS duration, bool_or(mended.text <> repaired) AS text_changed
 FROM mended JOIN segments g ON g.project_id = k.p AND g.pos = k.i GROUP BY 1""")
def transcript_documents(spark, sf):
    """Per recording what its documents hold, and whether any text had to be mended."""
    d = fl.transcript_documents(fl.segment_rows(fl.scan_transcripts(spark, _written(spark, sf), lines=True)))
    return d.select("project_id", "segments", round_to(F.col("duration"), 4).alias("duration"), "text_changed")


def _written(spark, sf) -> str:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/transcripts-{uuid.uuid4().hex}"
    wrong = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    d = ad.segments(spark, sf).withColumn("text", F.when(F.col("project_id") % 3 == 0, wrong).otherwise(F.col("text")))
    d = d.groupBy(F.col("project_id").cast("string").alias("project_id"), F.floor(F.col("pos") / 64).alias("part")).agg(
        F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "start", "end", "text", "speaker"))).alias("segments"))
    d.write.json(folder)
    return folder
