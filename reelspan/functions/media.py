"""Projections and checks over media-probe metadata."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from reelspan.functions import text as tx
from reelspan.params import RenderParams

MIN_AUDIO_SECONDS = 0.5  # FIXED VALUE, see min_audio in usable_duration


def seconds(x: Column) -> Column:
    """Non-negative number, 0 when missing or not a number."""
    v = x.try_cast("double")
    return F.coalesce(F.greatest(F.lit(0.0), F.when(~F.isnan(v), v)), F.lit(0.0))


def fps(x: Column) -> Column:
    """'30000/1001' or '25' as a number; 0 for anything else."""
    parts = F.split(F.coalesce(x, F.lit("")), "/")
    num, den = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    value = F.when(F.size(parts) == 1, num).when((F.size(parts) == 2) & (den != 0), num / den)
    return F.coalesce(value, F.lit(0.0))


def video_stream(streams: Column, skip_pictures: bool = True) -> Column:
    def wanted(s: Column) -> Column:
        picture = F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 0
        video = s["codec_type"] == "video"
        return video & ~picture if skip_pictures else video

    return F.get(F.filter(streams, wanted), F.lit(0))


def audio_stream(streams: Column) -> Column:
    return F.get(F.filter(streams, lambda s: s["codec_type"] == "audio"), F.lit(0))


def first_positive(*values: Column) -> Column:
    return F.coalesce(*[F.when(v > 0, v) for v in values], F.lit(0.0))


def probe_columns(streams: str = "streams", container: str = "format") -> dict[str, Column]:
    """Columns duration, width, height, fps, codecs and the extraction target of a probe row."""
    v, a = video_stream(F.col(streams)), audio_stream(F.col(streams))
    dv, da, df = seconds(v["duration"]), seconds(a["duration"]), seconds(F.col(container)["duration"])
    rate = F.when(F.coalesce(v["avg_frame_rate"], F.lit("")) != "", v["avg_frame_rate"]).otherwise(v["r_frame_rate"])
    return {
        "duration": first_positive(dv, df, da),
        "width": F.coalesce(v["width"].cast("int"), F.lit(0)), "height": F.coalesce(v["height"].cast("int"), F.lit(0)),
        "fps": fps(rate), "video_codec": F.coalesce(v["codec_name"], F.lit("")),
        "audio_codec": F.coalesce(a["codec_name"], F.lit("")),
        "target_duration": first_positive(dv, da, df),
        "target_source": F.when(dv > 0, "video").when(da > 0, "audio").when(df > 0, "format").otherwise("unknown"),
    }


def usable_duration(actual: Column, expected: Column, min_audio: float = MIN_AUDIO_SECONDS) -> Column:
    tolerance = F.greatest(F.lit(2.0), F.least(F.lit(20.0), expected * 0.02))
    return (actual >= min_audio) & ((expected <= 0) | (actual >= expected - tolerance))


def render_report(duration: Column, streams: Column, p: RenderParams = RenderParams()) -> dict[str, Column]:
    """``ok`` and ``errors`` of a rendered file against the planned clip duration."""
    v, a = video_stream(streams, skip_pictures=False), audio_stream(streams)
    extra = max(0.8, p.end_card_sec) if p.end_card_sec > 0 else 0.0
    expected = duration + extra
    tol = max(0.22, 4 / max(1, p.fps))
    dv, da = seconds(v["duration"]), seconds(a["duration"])
    frames = F.coalesce(v["nb_frames"].try_cast("int"), F.lit(0))
    want_frames = ((expected - tol) * p.fps).cast("int")
    w, h = F.coalesce(v["width"].cast("int"), F.lit(0)), F.coalesce(v["height"].cast("int"), F.lit(0))
    has_video, has_audio = v.isNotNull(), a.isNotNull()
    off = ((da > 0) & (da < expected - tol)) | (da > expected + max(0.65, tol * 2))
    rules = [
        (~has_video, F.lit("missing video stream")),
        (has_video & ((w != p.width) | (h != p.height)), F.concat(F.lit("unexpected canvas "), w, F.lit("x"), h)),
        (has_video & (dv < expected - tol), F.format_string("video stream is %.2fs, expected %.2fs", dv, expected)),
        (has_video & (frames != 0) & (frames < want_frames),
         F.format_string("video has %d frames, expected at least %d", frames, want_frames)),
    ]
    if p.expect_audio:
        rules += [
            (~has_audio, F.lit("missing audio stream")),
            (has_audio & off, F.format_string("audio stream is %.2fs, expected %.2fs", da, expected)),
        ]
    errors = F.array_compact(F.array(*[F.when(c, m) for c, m in rules]))
    return {
        "expected_duration": tx.round_to(expected, 3), "video_duration": tx.round_to(dv, 3),
        "audio_duration": tx.round_to(da, 3), "frame_count": frames, "errors": errors, "ok": F.size(errors) == 0,
    }
