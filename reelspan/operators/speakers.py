"""Speaker labels: clustering, nearest voice, gap filling, inheritance, coverage."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from reelspan.functions import text as tx
from reelspan.operators.intervals import overlap_join, overlap_seconds, point_join
from reelspan.operators.quantiles import exact_quantiles
from reelspan.operators.scan import running
from reelspan.params import SpeakerParams
from reelspan.session import cut_lineage

PIPELINE_VERSION = "speaker-pipeline-v3"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """Array scaled to length 1 (unchanged if it is zero), as doubles."""
    d = v.cast("array<double>")
    norm = F.sqrt(dot(d, d))
    return F.get(F.transform(F.array(norm), lambda n: F.transform(d, lambda x: F.when(n > 0, x / n).otherwise(x))), F.lit(0))


def distance(a: Column, b: Column) -> Column:
    """Cosine distance of unit vectors."""
    return 1.0 - dot(a, b)


def anchors(items: DataFrame, p: SpeakerParams = SpeakerParams()) -> DataFrame:
    """Items long enough to define a voice; all items where a recording has fewer than two."""
    good = (F.col("duration") >= max(1.0, p.min_segment_sec)) & (F.col("n_words") >= 2)
    n = items.groupBy("project_id").agg(F.count_if(good).alias("_anchors"))
    return items.join(n, "project_id").where(good | (F.col("_anchors") < 2)).drop("_anchors")


def _assigned(items: DataFrame, centres: DataFrame) -> DataFrame:
    """Items (project_id, pos, u) once per (project_id, k) of ``centres``, with the nearest centre's number."""
    d = items.join(centres, "project_id")
    far = F.transform("c", lambda x: dot(x, x) - 2 * dot(F.col("u"), x))
    return d.withColumn("_far", far).select("project_id", "k", "pos", "u", (F.array_position("_far", F.array_min("_far")) - 1).cast("int").alias("cluster"))


def _gathered(assigned: DataFrame, value: Column, name: str) -> DataFrame:
    """(project_id, k, ``name``): per cluster its number of items and ``value``, an array of at most k entries."""
    g = assigned.groupBy("project_id", "k", "cluster").agg(F.count("*").alias("n"), value.alias("v"))
    entry = F.struct("cluster", "n", vector_to_array("v").alias("v"))
    return g.groupBy("project_id", "k").agg(F.sort_array(F.collect_list(entry)).alias(name))


def cluster_recordings(items: DataFrame, p: SpeakerParams = SpeakerParams(), rounds: int = 12) -> DataFrame:
    """(project_id, pos, cluster): per recording the best number of voices, 1 to the maximum.

    Lloyd rounds run for all recordings and all numbers of voices at once, from starts that are farthest from each
    other; means combine map-side, so a recording of any length is no single task's. The silhouette (cosine) follows
    from each cluster's sum of unit vectors. Recordings of one or two items follow fixed rules.
    """
    d = cut_lineage(items.select("project_id", "pos", unit(F.col("embedding")).alias("u")))
    counts = d.groupBy("project_id").agg(F.count("*").alias("items"))
    d = d.join(counts, "project_id")
    first = F.first("u").over(Window.partitionBy("project_id").orderBy("pos"))
    few = d.where("items <= 2").select("project_id", "pos", (distance(F.col("u"), first) >= p.distance_threshold).cast("int").alias("cluster"))

    many = d.where("items > 2")
    starts = many.groupBy("project_id").agg(F.array(F.min_by("u", "pos")).alias("c"), F.first("items").alias("items"))
    for _ in range(p.max_speakers - 1):
        near = F.array_min(F.transform("c", lambda x: distance(F.col("u"), x)))
        far = many.drop("items").join(starts, "project_id").groupBy("project_id").agg(F.max_by("u", F.struct(near, -F.col("pos"))).alias("_u"))
        starts = cut_lineage(starts.join(far, "project_id").select("project_id", F.array_append("c", F.col("_u")).alias("c"), "items"))
    ks = F.sequence(F.lit(2), F.least(F.lit(p.max_speakers), (F.col("items") - 1).cast("int")))
    centres = starts.select("project_id", F.explode(ks).alias("k"), "c").select("project_id", "k", F.slice("c", F.lit(1), F.col("k")).alias("c"))
    many = many.drop("items")
    vector = array_to_vector("u")
    for _ in range(rounds):
        means = _gathered(_assigned(many, centres), Summarizer.mean(vector), "m")
        moved = cut_lineage(means.select("project_id", "k", F.transform("m", lambda x: x["v"]).alias("c")))
        # centres that stay where they are give the same clusters again
        far = F.exists(F.arrays_zip("c", "old"), lambda x: F.exists(F.arrays_zip(x["c"], x["old"]), lambda y: F.abs(y["c"] - y["old"]) > 1e-12))
        old = centres.select("project_id", "k", F.col("c").alias("old"))
        rest = moved.join(old, ["project_id", "k"]).where((F.size("c") != F.size("old")) | far)
        centres = moved
        if rest.isEmpty():
            break
    done = cut_lineage(_assigned(many, centres))

    # figures per recording and number of voices, read by all that follows
    sums = cut_lineage(_gathered(done, Summarizer.sum(vector), "s").join(counts, "project_id"))
    mean = F.transform("s", lambda x: unit(x["v"]))
    gaps = F.flatten(F.transform("_mean", lambda x, i: F.transform(F.filter("_mean", lambda y, j: j > i), lambda y: distance(x, y))))
    smallest = F.when(F.col("items") < 8, 1).otherwise(F.greatest(F.lit(2), F.ceil(F.col("items") * 0.03)))
    fit = sums.withColumn("_mean", mean).where(
        (F.size("s") > 1) & (F.array_min(F.transform("s", lambda x: x["n"])) >= smallest)
        & (F.array_min(gaps) >= max(0.06, p.distance_threshold * 0.35))).select("project_id", "k", "s")
    own = F.get(F.filter("s", lambda x: x["cluster"] == F.col("cluster")), F.lit(0))
    within = (F.col("_own.n") - dot(F.col("u"), F.col("_own.v"))) / (F.col("_own.n") - 1)
    other = F.array_min(F.transform(F.filter("s", lambda x: x["cluster"] != F.col("cluster")), lambda x: (x["n"] - dot(F.col("u"), x["v"])) / x["n"]))
    s = done.join(fit, ["project_id", "k"]).withColumn("_own", own).withColumns({"_a": F.when(F.col("_own.n") > 1, within), "_b": other})
    silhouette = F.when(F.greatest("_a", "_b") > 0, (F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")).otherwise(0.0)
    scores = s.groupBy("project_id", "k").agg((F.avg(F.when(F.col("_a").isNotNull(), silhouette).otherwise(0.0))).alias("_score"))
    scores = scores.withColumn("_score", tx.round_to(F.col("_score") - F.greatest(F.lit(0), F.col("k") - 2) * 0.008, 9))
    best = cut_lineage(scores.where("_score >= 0.10").groupBy("project_id").agg(F.max_by("k", F.struct("_score", -F.col("k"))).alias("k")))
    chosen = done.join(best, ["project_id", "k"]).select("project_id", "pos", "cluster")
    single = many.join(best, "project_id", "left_anti").select("project_id", "pos", F.lit(0).alias("cluster"))
    return cut_lineage(few.unionByName(chosen).unionByName(single))


def label_by_first_seen(clusters: DataFrame) -> DataFrame:
    """(project_id, pos, speaker): S1, S2, ... in order of first appearance per recording."""
    first = clusters.groupBy("project_id", "cluster").agg(F.min("pos").alias("_first"))
    w = Window.partitionBy("project_id").orderBy("_first")
    names = first.select("project_id", "cluster", F.concat(F.lit("S"), F.row_number().over(w)).alias("speaker"))
    return clusters.join(names, ["project_id", "cluster"]).select("project_id", "pos", "speaker")


def centroids(items: DataFrame, labels: DataFrame) -> DataFrame:
    """(project_id, speaker, centroid): normalised mean of unit embeddings, combined map-side."""
    d = items.select("project_id", "pos", unit(F.col("embedding")).alias("u")).join(labels, ["project_id", "pos"])
    g = d.groupBy("project_id", "speaker").agg(Summarizer.mean(array_to_vector("u")).alias("m"))
    return g.select("project_id", "speaker", unit(vector_to_array("m")).alias("centroid"))


def assignment_limits(items: DataFrame, labels: DataFrame, cents: DataFrame, p: SpeakerParams = SpeakerParams()) -> DataFrame:
    """Largest distance still accepted per voice: 95th percentile + 0.08, clamped. The percentile is exact."""
    d = (
        items.select("project_id", "pos", unit(F.col("embedding")).alias("u"))
        .join(labels, ["project_id", "pos"]).join(cents, ["project_id", "speaker"])
        .select("project_id", "speaker", distance(F.col("u"), F.col("centroid")).alias("_d"))
    )
    low = max(0.28, p.distance_threshold * 1.45)
    return exact_quantiles(d, ["project_id", "speaker"], "_d", {"q": 0.95}).select(
        "project_id", "speaker", F.least(F.lit(0.82), F.greatest(F.lit(low), F.col("q") + 0.08)).alias("limit"))


def nearest_speaker(items: DataFrame, cents: DataFrame) -> DataFrame:
    """Add nearest (speaker, distance) and the margin to the second voice of the recording.

    A recording has at most ``max_speakers`` centroids, kept as one small array."""
    per = cents.groupBy("project_id").agg(F.collect_list(F.struct("speaker", "centroid")).alias("_c"))
    d = items.join(per, "project_id", "left").withColumn("_u", unit(F.col("embedding")))
    ranked = F.sort_array(F.transform(
        "_c", lambda c: F.struct(distance(F.col("_u"), c["centroid"]).alias("d"), c["speaker"].alias("s"))
    ))
    d = d.withColumn("_r", ranked)
    best, second = F.get("_r", F.lit(0)), F.get("_r", F.lit(1))
    return d.withColumns({
        "nearest": best["s"], "distance": F.coalesce(best["d"], F.lit(1.0)),
        "margin": F.when(best.isNull(), 0.0).when(second.isNull(), 1.0).otherwise(second["d"] - best["d"]),
    }).drop("_c", "_u", "_r")


def assign_short_turns(items: DataFrame, labels: DataFrame, cents: DataFrame, limits: DataFrame,
                       p: SpeakerParams = SpeakerParams()) -> DataFrame:
    """(project_id, pos, speaker) for all items: given labels, else a close and clear nearest voice."""
    default = max(0.28, p.distance_threshold * 1.45)
    d = nearest_speaker(items, cents).join(labels, ["project_id", "pos"], "left")
    lim = limits.select("project_id", F.col("speaker").alias("nearest"), "limit")
    d = d.join(lim, ["project_id", "nearest"], "left")
    close = (F.col("distance") <= F.coalesce("limit", F.lit(default))) & (F.col("margin") >= 0.012)
    return d.select("project_id", "pos", F.coalesce("speaker", F.when(close, F.col("nearest"))).alias("speaker"))


def fill_gaps(segments: DataFrame) -> DataFrame:
    """Fill unlabelled segments between two equal voices 0.75 s or less away on both sides.

    ``fillable`` marks segments that have an embedding. A filled segment serves
    as left neighbour of the next: within one unlabelled run, everything after
    the first segment that qualifies is filled too.
    """
    voiced = F.col("speaker").isNotNull()
    block = F.floor(F.col("pos") / 4096)
    d = running(segments, ["project_id"], ["pos"], block, {
        "_prev": ("max", F.when(voiced, F.struct("pos", F.col("end").alias("t"), F.col("speaker").alias("s"))))})
    d = running(d, ["project_id"], [F.desc("pos")], -block, {
        "_next": ("max", F.when(voiced, F.struct((-F.col("pos")).alias("pos"), F.col("start").alias("t"), F.col("speaker").alias("s"))))})
    near = (
        ~voiced & F.col("fillable") & (F.col("_prev.s") == F.col("_next.s"))
        & (F.greatest(F.lit(0.0), F.col("start") - F.col("_prev.t")) <= 0.75)
        & (F.greatest(F.lit(0.0), F.col("_next.t") - F.col("end")) <= 0.75)
    )
    d = running(d, ["project_id"], ["pos"], block, {"_run": ("max", F.when(near, F.col("_prev.pos")))}, inclusive=True)
    filled = ~voiced & F.col("fillable") & (F.col("_run") == F.col("_prev.pos"))
    return d.withColumn("speaker", F.when(filled, F.col("_prev.s")).otherwise(F.col("speaker"))).drop("_prev", "_next", "_run")


def inherit_speakers(items: DataFrame, reference: DataFrame) -> DataFrame:
    """Add ``speaker`` from reference segments: largest total overlap, else nearest edge within 0.35 s.

    ``items``: project_id, id, start, end in the reference's time (segments or words).
    """
    ref = reference.where(F.coalesce("speaker", F.lit("")) != "").select("project_id", "pos", "start", "end", "speaker")
    it = items.select("project_id", "id", "start", "end")
    o = overlap_join(it, ref, "project_id")
    by_voice = o.groupBy("project_id", "id", F.col("r_speaker").alias("voice")).agg(
        F.round(F.sum(overlap_seconds(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))), 6).alias("sec"),
        F.min("r_pos").alias("first"),
    ).where("sec > 0")
    best = by_voice.groupBy("project_id", "id").agg(F.max_by("voice", F.struct("sec", -F.col("first"))).alias("_by_overlap"))
    edges = ref.select("project_id", "pos", "speaker", F.explode(F.array("start", "end")).alias("edge"))
    mid = (F.col("start") + F.col("end")) / 2
    spans = it.select("project_id", "id", mid.alias("mid"), (mid - 0.35).alias("lo"), (mid + 0.35).alias("hi"))
    near = point_join(edges, spans, "project_id", "edge", "lo", "hi", width=60.0).groupBy("project_id", F.col("r_id").alias("id")).agg(
        F.min_by("speaker", F.struct(F.abs(F.col("edge") - F.col("r_mid")), F.col("pos"))).alias("_by_edge")
    )
    d = items.drop("speaker").join(best, ["project_id", "id"], "left").join(near, ["project_id", "id"], "left")
    return d.withColumn("speaker", F.coalesce("_by_overlap", "_by_edge")).drop("_by_overlap", "_by_edge")


def inherit_transcript(local: DataFrame, reference: DataFrame) -> DataFrame:
    """Segments of clip-local transcripts with inherited labels on segments and words.

    ``local``: project_id, id (clip), pos, start, end, offset, words. Words fall back to the segment's label.
    """
    seg_id = F.concat_ws("/", "id", "pos")
    segs = local.select("project_id", seg_id.alias("id"), (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"))
    words = local.select("project_id", seg_id.alias("sid"), "offset", F.posexplode("words").alias("wi", "w")).select(
        "project_id", F.concat_ws("/", "sid", "wi").alias("id"), "sid", "wi", "w",
        (F.col("w.start") + F.col("offset")).alias("start"), (F.col("w.end") + F.col("offset")).alias("end"),
    )
    s = inherit_speakers(segs, reference).select("project_id", F.col("id").alias("sid"), F.col("speaker").alias("_seg_speaker"))
    w = inherit_speakers(words, reference).join(s, ["project_id", "sid"], "left")
    labelled = w.withColumn("w", F.col("w").withField("speaker", F.coalesce("speaker", "_seg_speaker")))
    packed = labelled.groupBy("project_id", "sid").agg(F.sort_array(F.collect_list(F.struct("wi", "w"))).alias("_w"))
    d = local.withColumn("sid", seg_id).join(s, ["project_id", "sid"], "left").join(packed, ["project_id", "sid"], "left")
    return d.withColumns({
        "speaker": F.col("_seg_speaker"), "words": F.coalesce(F.transform("_w", lambda x: x["w"]), F.col("words")),
    }).drop("sid", "_seg_speaker", "_w")


def spread_labels(segments: DataFrame) -> DataFrame:
    """Copy the segment label to all its words."""
    s = F.col("speaker")
    return segments.withColumn("words", F.transform("words", lambda w: w.withField("speaker", s)))


def speaker_counts(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("speaker").isNotNull() & (F.col("speaker") != "")).groupBy("project_id", "speaker").agg(
        F.count("*").alias("n")
    )


def speaker_coverage(segments: DataFrame) -> DataFrame:
    """Share of labelled segments, rounded to 4 places, and whether labels are ready to use."""
    labelled = F.coalesce(F.col("speaker") != "", F.lit(False))
    g = segments.groupBy("project_id").agg(
        tx.round_to(F.avg(labelled.cast("double")), 4).alias("speaker_coverage"), F.bool_or(labelled).alias("any_label")
    )
    return g.withColumn("speaker_model_version", F.lit(PIPELINE_VERSION))


def labels_ready(transcripts: DataFrame) -> Column:
    """Current pipeline version and at least one label."""
    return F.coalesce((F.col("speaker_model_version") == PIPELINE_VERSION) & F.col("any_label"), F.lit(False))


def speaker_summary(counts: DataFrame, coverage: DataFrame) -> DataFrame:
    """'speakers=S1:80, S2:40; coverage=90%' per recording (one entry per voice)."""
    entry = F.struct("speaker", F.concat_ws(":", "speaker", "n").alias("t"))
    g = counts.groupBy("project_id").agg(F.sort_array(F.collect_list(entry)).alias("_e"))
    d = coverage.join(g, "project_id", "left")
    text = F.concat(
        F.lit("speakers="), F.array_join(F.transform("_e", lambda e: e["t"]), ", "),
        F.format_string("; coverage=%.0f%%", F.col("speaker_coverage") * 100),
    )
    return d.select("project_id", F.coalesce(text, F.lit("speakers=none")).alias("summary"))
