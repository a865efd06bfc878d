"""Timeline queries: segments, sentences, windows, promo blocks, boundaries, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspan.catalog import sql as S
from reelspan.catalog.sql import FIX, q, r
from reelspan.functions import scoring as sc
from reelspan.functions.text import jaccard, normalize_clean, round2, round_to, terms
from reelspan.operators import boundary as bd, calibrate as cal, chain as ch, promo as pr, segment as sg, select as sl, windows as wn
from reelspan.params import ClipParams, LearningParams, Params, SuggestionParams
from reelspan.plans import analyze as an
from reelspan.session import cut_lineage
from reelspan.sources import adapters as ad, files as fl

QUERIES, ORACLES = {}, {}
CLIP = ClipParams(min_score=50.0)


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def sentences(spark, sf):
    """The sentence table; checkpointed because every query reads it more than once."""
    return cut_lineage(sg.segment_sentences(ad.segments(spark, sf)))


def windows(spark, sf):
    return wn.candidate_windows(sentences(spark, sf), CLIP)


@query(f"""WITH {S.SEGMENTS} SELECT project_id, pos, speaker, "start", "end", {S.n_words('text')} AS n_words FROM segments""")
def timed_segments(spark, sf):
    from reelspan.functions.text import n_words

    return ad.segments(spark, sf).select("project_id", "pos", "speaker", "start", "end", n_words(F.col("text")).alias("n_words"))


@query(f"""WITH {S.SENTENCES} SELECT project_id, pos, seg_pos, text, speaker, {r('"start"', 4)} AS "start", {r('"end"', 4)} AS "end" FROM sentences""")
def timed_sentences(spark, sf):
    return sentences(spark, sf).select(
        "project_id", "pos", "seg_pos", "text", "speaker", round_to(F.col("start"), 4).alias("start"), round_to(F.col("end"), 4).alias("end"))


# Words carry the time here: a sentence starts with its first and ends with its last word.
@query(f"""WITH {S.SEGMENTS}, p AS (SELECT *, {S.sentences_of('text')} AS parts FROM segments),
 e AS (SELECT project_id, pos, cs, speaker, len(parts) AS k, dur0, unnest(parts) AS text, generate_subscripts(parts, 1) AS i FROM (SELECT *, "end" AS dur0 FROM p)),
 w AS (SELECT *, {S.n_words('text')} AS n FROM e),
 c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY project_id, pos ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM w)
 SELECT project_id, pos AS seg_pos, text, speaker, {r('CASE WHEN k = 1 THEN cs / 100.0::DOUBLE ELSE (cs + cur * 40) / 100.0::DOUBLE END', 4)} AS "start",
  {r('CASE WHEN k = 1 THEN dur0 ELSE (cs + (cur + n - 1) * 40 + 35) / 100.0::DOUBLE END', 4)} AS "end", CAST(n AS INT) AS n_words FROM c""")
def worded_sentences(spark, sf):
    d = sg.segment_sentences(ad.segments(spark, sf, words=True))
    return d.select("project_id", "seg_pos", "text", "speaker", round_to(F.col("start"), 4).alias("start"),
                    round_to(F.col("end"), 4).alias("end"), F.size("words").alias("n_words"))


WINDOWS = S.SENTENCES + """,
ahead AS (SELECT a.project_id, a.pos AS anchor_pos, a."start" AS s0, b.pos, b."start", b."end", b.text, b.speaker
  FROM sentences a JOIN sentences b ON b.project_id = a.project_id AND b.pos >= a.pos AND b."start" <= a."start" + 48 WHERE a.pos % 2 = 0),
cutoff AS (SELECT project_id, anchor_pos, min(pos) AS cut FROM ahead WHERE pos > anchor_pos AND "end" - s0 > 48 GROUP BY ALL),
inside AS (SELECT a.* FROM ahead a LEFT JOIN cutoff c USING (project_id, anchor_pos) WHERE cut IS NULL OR a.pos < cut),
lasts AS (SELECT DISTINCT project_id, anchor_pos, coalesce(min(pos) FILTER ("end" - s0 >= t), max(pos)) AS last_pos
  FROM inside, (VALUES (18.0::DOUBLE), (28.0::DOUBLE), (40.0::DOUBLE)) v(t) GROUP BY project_id, anchor_pos, t),
win AS (SELECT l.project_id, l.anchor_pos, l.last_pos, min(i.s0) AS "start", max(i."end") FILTER (i.pos = l.last_pos) AS "end",
  string_agg(i.text, ' ' ORDER BY i.pos) AS text, list(i.speaker ORDER BY i.pos) AS labels,
  first(i.text ORDER BY i.pos) AS first_text, last(i.text ORDER BY i.pos) AS last_text
  FROM lasts l JOIN inside i ON i.project_id = l.project_id AND i.anchor_pos = l.anchor_pos AND i.pos <= l.last_pos GROUP BY ALL),
windows_0 AS (SELECT *, "end" - "start" AS duration,
  len(list_filter(labels, lambda x, i: i > 1 AND x <> labels[i - 1])) AS switches, list_distinct(labels) AS u FROM win WHERE "end" - "start" >= 18 * 0.85),
windows_1 AS (SELECT *, list_sort(list_transform(u, lambda x: len(list_filter(labels, lambda y: y = x))), 'DESC') AS n FROM windows_0),
windows AS (SELECT * EXCLUDE (u, n, labels, switches), len(u) AS speaker_count, switches AS speaker_switches,
  CASE WHEN len(u) >= 2 AND n[2] >= 2 AND n[2] / len(labels) >= 0.12 AND switches >= 2
   THEN greatest(0, least(100, 38 + (len(u) - 1) * 15 + least(25.0::DOUBLE, switches / greatest(1.0, duration) * 85))) ELSE 0 END AS dialogue_score FROM windows_1)"""


@query(f"""WITH {WINDOWS} SELECT project_id, anchor_pos, last_pos, {r('"start"', 4)} AS "start", {r('"end"', 4)} AS "end", md5(text) AS text,
 speaker_count, speaker_switches, {r('dialogue_score', 4)} AS dialogue_score FROM windows""")
def candidate_windows(spark, sf):
    return windows(spark, sf).select(
        "project_id", "anchor_pos", "last_pos", round_to(F.col("start"), 4).alias("start"), round_to(F.col("end"), 4).alias("end"),
        F.md5(F.col("text").cast("binary")).alias("text"), "speaker_count", "speaker_switches", round_to(F.col("dialogue_score"), 4).alias("dialogue_score"))


_FULL = "concat_ws(' ', nullif(text, ''), nullif(summary, ''), nullif(hook_text, ''))"
POOL = f"""{WINDOWS}, {S.scores('windows', 'text', 'duration', FIX)},
gated AS (SELECT *, {S.summarize(S.collapse('first_text'), 90)} AS hook_text, {S.summarize(S.collapse('text'), 180)} AS summary,
  CASE WHEN dialogue_score > 0 AND moment_type = 'insight' THEN 'conversation' ELSE moment_type END AS kind FROM scored WHERE base_score >= 32),
g2 AS (SELECT *, {_FULL} AS full_text FROM gated), {S.quality('g2', 'full_text', FIX)},
pool_0 AS (SELECT *, {r('greatest(0.0, base_score - quality_penalty)')} AS final_score, {r('"start"')} AS s2, {r('"end"')} AS e2,
  'moment_' || anchor_pos || '_' || last_pos AS id FROM quality),
pool AS (SELECT * FROM pool_0 WHERE final_score >= 32
  QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY final_score DESC, s2, e2, id) <= 160)"""


@query(f"""WITH {POOL} SELECT project_id, id, s2 AS "start", e2 AS "end", kind AS moment_type, final_score, summary, hook_text,
 array_to_string(list_concat(CASE WHEN duration < 18 THEN ['short context'] ELSE [] END, quality_problems), ',') AS problems FROM pool""")
def heuristic_pool(spark, sf):
    d = wn.heuristic_moments(windows(spark, sf), CLIP, FIX)
    return d.select("project_id", "id", "start", "end", "moment_type", "final_score", "summary", "hook_text",
                    F.array_join("problems", ",").alias("problems"))


def _shifted(spark, sf):
    """Windows with bounds off the sentence grid, as generic intervals."""
    return windows(spark, sf).select(
        "project_id", F.format_string("w_%d_%d", "anchor_pos", "last_pos").alias("id"),
        round2(F.col("start") + 0.31).alias("start"), round2(F.col("end") - 0.42).alias("end"), "text", F.lit("insight").alias("moment_type"))


SHIFTED = f"""{WINDOWS}, iv AS (SELECT project_id, 'w_' || anchor_pos || '_' || last_pos AS id, {r('"start" + 0.31')} AS s, {r('"end" - 0.42')} AS e, text FROM windows)"""


@query(f"""WITH {SHIFTED} SELECT iv.project_id, iv.id, md5(string_agg({S.strip('t.text')}, ' ' ORDER BY t.pos)) AS text FROM iv
 JOIN sentences t ON t.project_id = iv.project_id AND t."end" > s + 0.02::DOUBLE AND t."start" < e - 0.02::DOUBLE GROUP BY ALL""")
def interval_text(spark, sf):
    d = wn.interval_text(_shifted(spark, sf), sentences(spark, sf))
    return d.select("project_id", "id", F.md5(F.col("interval_text").cast("binary")).alias("text"))


@query(f"""WITH {SHIFTED}, c AS (SELECT iv.project_id, iv.id, list(t.speaker ORDER BY t.pos) AS labels, string_agg(t.text, ' ' ORDER BY t.pos) AS text,
   max(t."end") - min(t."start") AS d FROM iv JOIN sentences t ON t.project_id = iv.project_id AND t."end" >= s AND t."start" <= e GROUP BY ALL),
 u AS (SELECT *, list_distinct(labels) AS u, len(list_filter(labels, lambda x, i: i > 1 AND x <> labels[i - 1])) AS sw FROM c),
 n AS (SELECT *, list_sort(list_transform(u, lambda x: len(list_filter(labels, lambda y: y = x))), 'DESC') AS n FROM u)
 SELECT project_id, id, md5({S.strip('text')}) AS text, len(u) AS speaker_count, sw AS speaker_switches,
  {r('''CASE WHEN len(u) >= 2 AND n[2] >= 2 AND n[2] / len(labels) >= 0.12 AND sw >= 2
   THEN greatest(0, least(100, 38 + (len(u) - 1) * 15 + least(25.0::DOUBLE, sw / greatest(1.0, d) * 85))) ELSE 0 END''', 4)} AS dialogue_score FROM n""")
def closed_interval_metrics(spark, sf):
    iv, s = _shifted(spark, sf), sentences(spark, sf)
    d = wn.interval_speaker_metrics(wn.closed_interval_text(iv, s), s)
    return d.select("project_id", "id", F.md5(F.col("interval_text").cast("binary")).alias("text"), "speaker_count",
                    "speaker_switches", round_to(F.col("dialogue_score"), 4).alias("dialogue_score"))


@query(f"""WITH {S.SEGMENTS}, iv AS (SELECT project_id, pos AS id, "start" - 5 AS s, "end" + 5 AS e FROM segments),
 c AS (SELECT iv.project_id, iv.id, any_value(e) - any_value(s) AS d, list(t.speaker ORDER BY t.pos) AS labels FROM iv
   JOIN segments t ON t.project_id = iv.project_id AND t."end" >= s AND t."start" <= e GROUP BY ALL),
 u AS (SELECT *, len(list_distinct(labels)) AS u, len(list_filter(labels, lambda x, i: i > 1 AND x <> labels[i - 1])) AS sw FROM c)
 SELECT project_id, id, u AS speaker_count, sw AS speaker_switches,
  {r('CASE WHEN u >= 2 THEN least(100.0::DOUBLE, 42 + (u - 1) * 18 + least(28.0::DOUBLE, sw / greatest(1.0, d) * 90)) ELSE 0 END')} AS dialogue_score FROM u""")
def stored_clip_speakers(spark, sf):
    from reelspan.operators.intervals import overlap_join

    segs = ad.segments(spark, sf)
    iv = segs.select("project_id", F.col("pos").alias("id"), (F.col("start") - 5).alias("start"), (F.col("end") + 5).alias("end"))
    o = overlap_join(iv, segs.select("project_id", "pos", "start", "end", "speaker"), "project_id", closed=True)
    g = o.groupBy("project_id", "id", "start", "end").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("r_pos", "r_speaker"))), lambda x: x["r_speaker"]).alias("l"))
    m = wn.clip_speaker_metrics(F.col("l"), F.col("end") - F.col("start"))
    return g.select("project_id", "id", m.alias("m")).select("project_id", "id", "m.*")


# -- shot changes ----------------------------------------------------------------

_CUTS = """lines AS (SELECT user_id AS project_id, CAST(round(value * 100) AS BIGINT) AS cs FROM events),
 ok AS (SELECT DISTINCT project_id, cs FROM lines WHERE cs > 8 AND cs < 40000 - 40)"""


def _scene_cuts(spark, sf):
    e = ad.table(spark, sf, "events")
    lines = e.select(F.col("user_id").alias("project_id"),
                     F.concat(F.lit("[Parsed_showinfo] n:"), "event_id", F.lit(" pts_time:"), F.format_string("%.2f", "value"), F.lit(" fmt:yuv420p")).alias("line"))
    durations = e.select(F.col("user_id").alias("project_id")).distinct().withColumn("duration", F.lit(400.0))
    return fl.parse_scene_log(lines, durations)


@query(f"""WITH RECURSIVE {_CUTS}, kept AS (SELECT project_id, min(cs) AS cs FROM ok GROUP BY 1
 UNION ALL SELECT k.project_id, min(o.cs) FROM kept k JOIN ok o ON o.project_id = k.project_id AND o.cs >= k.cs + 25 GROUP BY k.project_id, k.cs)
 SELECT project_id, cs / 100.0::DOUBLE AS ts FROM kept""")
def shot_changes(spark, sf):
    return _scene_cuts(spark, sf)


@query(f"""WITH RECURSIVE {SHIFTED}, {_CUTS}, kept AS (SELECT project_id, min(cs) AS cs FROM ok GROUP BY 1
 UNION ALL SELECT k.project_id, min(o.cs) FROM kept k JOIN ok o ON o.project_id = k.project_id AND o.cs >= k.cs + 25 GROUP BY k.project_id, k.cs)
 SELECT iv.project_id, iv.id, count(k.cs) AS n_cuts FROM iv LEFT JOIN kept k ON k.project_id = iv.project_id AND k.cs / 100.0::DOUBLE BETWEEN s AND e GROUP BY ALL""")
def cuts_in_intervals(spark, sf):
    return wn.add_cut_counts(_shifted(spark, sf), _scene_cuts(spark, sf)).select("project_id", "id", "n_cuts")


# -- promo -------------------------------------------------------------------------

PROMO = S.SENTENCES + f""",
pe_0 AS (SELECT project_id, pos, CAST(round("start" * 100) AS BIGINT) AS s, CAST(round("end" * 100) AS BIGINT) AS e, text, {S.norm('text')} AS nrm FROM sentences),
pe_1 AS (SELECT project_id, pos, s, e, {S.evidence('text', 'nrm', FIX)} AS ev FROM pe_0),
pe_2 AS (SELECT *, coalesce(s - lag(e) OVER w > 280, true) AS gap,
  coalesce(len(ev) = 0 AND len(lead(ev) OVER w) = 0 AND len(lead(ev, 2) OVER w) = 0, false) AS miss3 FROM pe_1 WINDOW w AS (PARTITION BY project_id ORDER BY pos)),
pe AS (SELECT *, sum(gap::INT) OVER (PARTITION BY project_id ORDER BY pos) AS island FROM pe_2),
seed AS (SELECT project_id, pos AS l, pos AS rr FROM pe WHERE list_contains(ev, 'disclosure') OR list_contains(ev, 'cta')
 UNION ALL SELECT * FROM (SELECT a.project_id, a.pos AS l, greatest(min(b.pos) FILTER (list_contains(b.ev, 'brand')), min(b.pos) FILTER (list_contains(b.ev, 'offer')),
    CASE WHEN count(*) FILTER (list_contains(b.ev, 'brand')) > 0 AND count(*) FILTER (list_contains(b.ev, 'offer')) > 0 THEN min(b.pos) FILTER (list_contains(b.ev, 'urgency')) END) AS rr,
    count(*) FILTER (list_contains(b.ev, 'brand')) AS nb, count(*) FILTER (list_contains(b.ev, 'offer')) AS no_, count(*) FILTER (list_contains(b.ev, 'urgency')) AS nu
   FROM pe a JOIN pe b ON b.project_id = a.project_id AND b.island = a.island AND b.pos >= a.pos AND b.e - a.s <= 3000 GROUP BY 1, 2)
   t WHERE nb > 0 AND no_ > 0 AND nu > 0),
seed2 AS (SELECT project_id, COLUMNS(['l', 'rr']) FROM seed),
lft AS (SELECT a.project_id, a.pos, greatest(min(b.pos) FILTER (b.island = a.island), coalesce(1 + max(b.pos) FILTER (b.miss3 AND b.pos <= a.pos - 3), 0),
   min(b.pos) FILTER (b.s >= a.s - 5500)) AS reach FROM pe a JOIN pe b ON b.project_id = a.project_id AND b.pos <= a.pos GROUP BY 1, 2),
rgt AS (SELECT a.project_id, a.pos, least(max(b.pos) FILTER (b.island = a.island), coalesce(min(b.pos) FILTER (b.miss3 AND b.pos > a.pos) + 1, 9999999),
   max(b.pos) FILTER (b.e <= a.e + 1200)) AS reach FROM pe a JOIN pe b ON b.project_id = a.project_id AND b.pos >= a.pos GROUP BY 1, 2),
rng AS (SELECT DISTINCT x.project_id, lft.reach AS lp, rgt.reach AS rp, a.s AS ls, b.e AS re FROM seed2 x
  JOIN lft ON lft.project_id = x.project_id AND lft.pos = x.l JOIN rgt ON rgt.project_id = x.project_id AND rgt.pos = x.rr
  JOIN pe a ON a.project_id = x.project_id AND a.pos = lft.reach JOIN pe b ON b.project_id = x.project_id AND b.pos = rgt.reach),
grp AS (SELECT *, sum(new_) OVER (PARTITION BY project_id ORDER BY lp, rp) AS g FROM (SELECT *, coalesce(ls > max(re) OVER (PARTITION BY project_id ORDER BY lp, rp
   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 300, true)::INT AS new_ FROM rng)),
blk AS (SELECT project_id, g, min(lp) AS left_pos, max(rp) AS right_pos, min(ls) AS cs, max(re) AS ce FROM grp GROUP BY 1, 2),
promo AS (SELECT b.project_id, left_pos, right_pos, cs / 100.0::DOUBLE AS core_start, ce / 100.0::DOUBLE AS core_end, greatest(0, cs - 400) / 100.0::DOUBLE AS padded_start,
  (ce + 300) / 100.0::DOUBLE AS padded_end, (SELECT array_to_string(list_sort(list_distinct(flatten(list(p.ev)))), ',') FROM pe p
   WHERE p.project_id = b.project_id AND p.pos BETWEEN b.left_pos AND b.right_pos) AS evidence FROM blk b)"""
PROMO = PROMO.replace("seed2 AS (SELECT project_id, COLUMNS(['l', 'rr']) FROM seed)", "seed2 AS (SELECT project_id, l, rr FROM seed)").replace(
    "UNION ALL SELECT * FROM (SELECT a.project_id", "UNION ALL SELECT project_id, l, rr FROM (SELECT a.project_id").replace(
    "CASE WHEN count(*) FILTER (list_contains(b.ev, 'brand')) > 0 AND count(*) FILTER (list_contains(b.ev, 'offer')) > 0 THEN min(b.pos) FILTER (list_contains(b.ev, 'urgency')) END)",
    "min(b.pos) FILTER (list_contains(b.ev, 'urgency')))")


@query(f"WITH {PROMO} SELECT * FROM promo")
def promo_blocks(spark, sf):
    d = pr.promotional_blocks(sentences(spark, sf), FIX)
    return d.withColumn("evidence", F.array_join("evidence", ","))


@query(f"""WITH {PROMO}, {WINDOWS.replace(S.SENTENCES + ',', '')}, iv AS (SELECT project_id, 'w_' || anchor_pos || '_' || last_pos AS id, {r('"start" + 0.31')} AS s, {r('"end" - 0.42')} AS e FROM windows),
 o AS (SELECT iv.project_id, iv.id, coalesce(max(greatest(0, least(e, core_end) - greatest(s, core_start))) FILTER (core_start IS NOT NULL), 0) AS sec,
  coalesce(max(greatest(0, least(e, core_end) - greatest(s, core_start)) / greatest(0.001, e - s)) FILTER (core_start IS NOT NULL), 0) AS ratio FROM iv LEFT JOIN promo p ON p.project_id = iv.project_id GROUP BY ALL)
 SELECT project_id, id, {r('sec', 4)} AS promo_seconds, {r('ratio', 4)} AS promo_ratio, sec >= 2 OR ratio >= 0.1 AS promotional FROM o""")
def promo_overlap(spark, sf):
    d = pr.promo_overlap(_shifted(spark, sf), pr.promotional_blocks(sentences(spark, sf), FIX))
    return d.select("project_id", "id", round_to(F.col("promo_seconds"), 4).alias("promo_seconds"),
                    round_to(F.col("promo_ratio"), 4).alias("promo_ratio"), "promotional")


# -- boundaries ----------------------------------------------------------------------

_B = " .,!?:;…"


def _rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[ .,!?:;…]+$', '')"


_DANG = ", ".join(q(w) for w in FIX.dangling_endings)
BOUNDS = f"""{SHIFTED},
f0 AS (SELECT project_id, pos, "start" AS s, "end" AS e, {S.strip('text')} AS t FROM sentences),
f1 AS (SELECT *, lower(t) AS low, {_rstrip('lower(t)')} AS bare FROM f0),
f2 AS (SELECT *, (t = '' OR {S.ends('t', '.!?…')}) AS fin, coalesce(string_split({S.collapse('bare')}, ' ')[-1] IN ({_DANG}), false) AS dang,
  {S.ends('bare', FIX.deictic_endings)} AS dei, {S.starts('low', FIX.followups)} AS fol FROM f1),
f3 AS (SELECT *, lag(e) OVER w AS pe, lag(fin) OVER w AS pfin, lead(s) OVER w AS ns, lead(e) OVER w AS ne, lead(fol) OVER w AS nfol FROM f2 WINDOW w AS (PARTITION BY project_id ORDER BY pos)),
f4 AS (SELECT *, coalesce((fin AND NOT dei AND NOT (nfol AND ns - e <= 1.35)) OR ns - e > CASE WHEN dang THEN 2.4 ELSE 1.35 END, true) AS stops,
  coalesce(pfin OR s - pe > 0.85, true) AS anchor FROM f3),
b0 AS (SELECT iv.*, d.td, (SELECT max(pos) FROM f4 WHERE f4.project_id = iv.project_id AND anchor AND f4.s <= iv.s + 1.0) AS ap,
  (SELECT min(pos) FROM f4 WHERE f4.project_id = iv.project_id AND f4.e >= iv.e - 1.0) AS ep,
  (SELECT min(pos) FROM f4 WHERE f4.project_id = iv.project_id AND f4.e >= iv.e - 0.2) AS np
  FROM iv JOIN (SELECT project_id, max("end") AS td FROM segments GROUP BY 1) d USING (project_id)),
b1 AS (SELECT b0.project_id, b0.id, td, np, a.s AS asx, a.pe AS ape, y.e AS xe, least(b0.e + 0.45, greatest(0, b0.s - 0.35) + 48) AS e_raw FROM b0
  LEFT JOIN f4 a ON a.project_id = b0.project_id AND a.pos = ap LEFT JOIN f4 y ON y.project_id = b0.project_id AND y.pos = ep),
b2 AS (SELECT project_id, id, td, np, CASE WHEN ape > greatest(0, asx - 0.35) THEN least(asx, ape + 0.03) ELSE greatest(0, asx - 0.35) END AS st,
  coalesce(xe + 0.45, e_raw) - 0.45 AS fb FROM b1),
b3 AS (SELECT b2.*, greatest(fb, f.e) + 18 AS deadline FROM b2 LEFT JOIN f4 f ON f.project_id = b2.project_id AND f.pos = np),
b4 AS (SELECT b3.*, (SELECT min(pos) FROM f4 WHERE f4.project_id = b3.project_id AND f4.pos >= np AND (stops OR ne IS NULL OR ne > deadline)) AS lp FROM b3),
b5 AS (SELECT b4.*, greatest(fb, coalesce((SELECT max(e) FROM f4 WHERE f4.project_id = b4.project_id AND f4.pos BETWEEN np AND lp), fb)) AS sp FROM b4),
b6 AS (SELECT b5.*, (SELECT arg_min(s, pos) FROM f4 WHERE f4.project_id = b5.project_id AND f4.s >= sp - 0.02 AND f4.e > sp + 0.02) AS nx FROM b5),
b7 AS (SELECT *, CASE WHEN nx IS NULL OR nx >= sp + 0.45 THEN sp + 0.45 ELSE greatest(sp, nx - 0.02) END AS en FROM b6),
b8 AS (SELECT project_id, id, td, CASE WHEN en - st > 48 THEN greatest(0, en - 48) ELSE st END AS st, en FROM b7),
b9 AS (SELECT *, least(td, st + 18) AS tg FROM b8),
b10 AS (SELECT b9.*, (SELECT min(pos) FROM f4 WHERE f4.project_id = b9.project_id AND f4.e >= tg - 0.2) AS np2 FROM b9),
b11 AS (SELECT b10.*, greatest(tg, f.e) + 6 AS dl2 FROM b10 LEFT JOIN f4 f ON f.project_id = b10.project_id AND f.pos = np2),
b12 AS (SELECT b11.*, (SELECT min(pos) FROM f4 WHERE f4.project_id = b11.project_id AND f4.pos >= np2 AND (stops OR ne IS NULL OR ne > dl2)) AS lp2 FROM b11),
b13 AS (SELECT b12.*, greatest(tg, coalesce((SELECT max(e) FROM f4 WHERE f4.project_id = b12.project_id AND f4.pos BETWEEN np2 AND lp2), tg)) AS sp2 FROM b12),
b14 AS (SELECT b13.*, (SELECT arg_min(s, pos) FROM f4 WHERE f4.project_id = b13.project_id AND f4.s >= sp2 - 0.02 AND f4.e > sp2 + 0.02) AS nx2 FROM b13),
b15 AS (SELECT *, CASE WHEN en - st >= 18 THEN en WHEN nx2 IS NULL OR nx2 >= sp2 + 0.45 THEN sp2 + 0.45 ELSE greatest(sp2, nx2 - 0.02) END AS en2 FROM b14),
b16 AS (SELECT project_id, id, st, greatest(st + 1, least(td, en2)) AS en FROM b15),
bounds AS (SELECT project_id, id, {r('CASE WHEN en - st > 48 THEN greatest(0, en - 48) ELSE st END')} AS clip_start, {r('en')} AS clip_end FROM b16)"""
# plain decimal literals become doubles, as in the other engine
import re as _re

BOUNDS = BOUNDS[: len(SHIFTED)] + _re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w:.])", r"CAST(\1 AS DOUBLE)", BOUNDS[len(SHIFTED):])


@query(f"WITH {BOUNDS} SELECT * FROM bounds")
def clip_boundaries(spark, sf):
    segs = sentences(spark, sf).select("project_id", "pos", "start", "end", "text")
    d = bd.choose_boundaries(_shifted(spark, sf), segs, ad.recording_durations(ad.segments(spark, sf)), CLIP, FIX)
    return d.select("project_id", "id", "clip_start", "clip_end")


@query()
def cliffhanger_boundaries(spark, sf):
    segs = sentences(spark, sf).select("project_id", "pos", "start", "end", "text")
    p = ClipParams(min_score=50.0, ending_strategy="cliffhanger")
    d = bd.choose_boundaries(_shifted(spark, sf), segs, ad.recording_durations(ad.segments(spark, sf)), p, FIX)
    return d.select("project_id", "id", "clip_start", "clip_end")


# -- calibration, pool, selection ------------------------------------------------------


def _moments(spark, sf):
    """Pool columns on top of the raw windows (texts not yet scored)."""
    return _shifted(spark, sf).withColumns({"hook_text": F.lit(""), "payoff_text": F.lit("")})


CAL = f"""{SHIFTED}, cal_in AS (SELECT project_id, id, s, e, {S.collapse('text')} AS text, greatest(1.0, e - s) AS duration FROM iv),
{S.scores('cal_in', 'text', 'duration', FIX, 'cs')}, {S.quality('cs', 'text', FIX, 'cq')}, {S.structural('cq', 'text', FIX, 'ca')},
calibrated AS (SELECT *, {r('greatest(0, least(100, base_raw - quality_penalty - arc_penalty))')} AS final_score,
  list_distinct(list_concat(quality_problems, arc_problems)) AS all_problems FROM (SELECT *, base_score AS base_raw FROM ca))"""


@query(f"""WITH {CAL} SELECT project_id, id, final_score, moment_type, left(coalesce(nullif({S.hook_phrase('text')}, ''), ''), 90) AS hook_text,
 {S.summarize('text', 240)} AS summary, array_to_string(list_concat(quality_problems, arc_problems), ',') AS problems, {r('hook_score')} AS hook_score FROM calibrated""")
def calibrated_moments(spark, sf):
    d = cal.calibrate(_moments(spark, sf), FIX)
    return d.select("project_id", "id", "final_score", "moment_type", "hook_text", "summary", F.array_join("problems", ",").alias("problems"), "hook_score")


def _candidates(spark, sf):
    d = cal.calibrate(_moments(spark, sf), FIX)
    return d.select("project_id", "id", "start", "end", "text", "moment_type", "final_score", "hook_score", "problems")


_TERMS = f"list_distinct(list_filter({S.words(S.norm('text'))}, lambda t: length(t) >= 4 AND t NOT IN ({', '.join(q(w) for w in FIX.stopwords)})))"
_CANDS = "top AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY final_score DESC, s, e, id) AS k FROM calibrated)"


def _inter(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))"


def _sim(a: str, b: str) -> str:
    i = _inter(a, b)
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE {i} / CAST(len({a}) + len({b}) - {i} AS DOUBLE) END)"


def _over(a: str, b: str) -> str:
    return (f"(greatest(0, least({a}.e, {b}.e) - greatest({a}.s, {b}.s)) / greatest(0.001::DOUBLE, least(greatest(0, {a}.e - {a}.s), greatest(0, {b}.e - {b}.s))))")


@query(f"""WITH {CAL}, {_CANDS}, t AS (SELECT project_id, k, id, s, e, {_TERMS} AS terms FROM top)
 SELECT a.project_id, a.id, count(b.id) AS neighbours, max({r(_over('a', 'b'), 4)}) FILTER (b.id IS NOT NULL) AS overlap, max({r(_sim('a.terms', 'b.terms'), 4)}) FILTER (b.id IS NOT NULL) AS similarity,
  min({r('abs((a.s + a.e) / 2 - (b.s + b.e) / 2)')}) AS midpoint_gap, min({r('greatest(0, greatest(a.s, b.s) - least(a.e, b.e))')}) FILTER (b.id IS NOT NULL) AS edge_gap
 FROM t a LEFT JOIN t b ON a.project_id = b.project_id AND a.id <> b.id AND greatest(0, greatest(a.s, b.s) - least(a.e, b.e)) <= 20 GROUP BY a.project_id, a.id""")
def neighbour_pairs(spark, sf):
    d = sl.neighbours(_candidates(spark, sf), FIX)
    return d.select("project_id", "id", "neighbours", round_to(F.col("overlap"), 4).alias("overlap"),
                    round_to(F.col("similarity"), 4).alias("similarity"), round2(F.col("midpoint_gap")).alias("midpoint_gap"),
                    round2(F.col("edge_gap")).alias("edge_gap"))


_ITEM = 'STRUCT(id VARCHAR, s DOUBLE, e DOUBLE, kind VARCHAR, score DOUBLE, terms VARCHAR[])'


def _dup(c: str, e: str) -> str:
    over, sim = _over(c, e), _sim(f"{c}.terms", f"{e}.terms")
    mid = f"abs(({c}.s + {c}.e) / 2 - ({e}.s + {e}.e) / 2)"
    edge = f"greatest(0, greatest({c}.s, {e}.s) - least({c}.e, {e}.e))"

    def pct(x):
        return f"CAST(CAST(round(CAST(round({x} * 100, 9) AS DECIMAL(20,6)), 0) AS INT) AS VARCHAR) || '%"

    return f"""CASE WHEN {over} >= 0.20::DOUBLE THEN 'temporal duplicate of ' || {e}.id || ' (' || {pct(over)} overlap)'
 WHEN {sim} >= 0.48::DOUBLE THEN 'topic duplicate of ' || {e}.id || ' (' || {pct(sim)} term overlap)'
 WHEN {c}.kind = {e}.kind AND {sim} >= 0.22::DOUBLE THEN 'same ' || {c}.kind || ' topic as ' || {e}.id || ' (' || {pct(sim)} term overlap)'
 WHEN {mid} < 35 AND NOT ({c}.score >= 82 AND {e}.score >= 82 AND {sim} < 0.15::DOUBLE)
  THEN 'same source beat as ' || {e}.id || ' (' || CAST(round(CAST({mid} AS DECIMAL(20,6)), 1)::DECIMAL(20,1) AS VARCHAR) || 's apart)'
 WHEN {edge} <= 6 AND {sim} >= 0.25::DOUBLE THEN 'adjacent duplicate of ' || {e}.id
 WHEN {edge} <= 20 AND {c}.kind = {e}.kind THEN 'adjacent ' || {c}.kind || ' beat after ' || {e}.id END"""


_HARD = "list_filter(probs, lambda x: x IN ('ad or CTA language', 'promotional segment', 'teaser without payoff'))[1]"
SELECT = f"""{CAL}, {_CANDS}, {PROMO.replace(S.SENTENCES + ',', '')},
po AS (SELECT c.project_id, c.id, coalesce(bool_or(core_start IS NOT NULL AND (greatest(0, least(c.e, core_end) - greatest(c.s, core_start)) >= 2
   OR greatest(0, least(c.e, core_end) - greatest(c.s, core_start)) / greatest(0.001, c.e - c.s) >= 0.1)), false) AS promotional
   FROM top c LEFT JOIN promo p ON p.project_id = c.project_id GROUP BY ALL),
sel_0 AS (SELECT t.*, CASE WHEN promotional THEN list_append(list_concat(quality_problems, arc_problems), 'promotional segment') ELSE list_concat(quality_problems, arc_problems) END AS probs,
   {_TERMS} AS terms FROM top t JOIN po USING (project_id, id)),
sel_1 AS (SELECT project_id, k, id, s, e, moment_type AS kind, final_score AS score, terms, {_HARD} AS hard,
   CASE WHEN {_HARD} IS NOT NULL THEN {_HARD} WHEN final_score < 50 THEN 'below quality gate'
    WHEN list_contains(probs, 'unfinished ending') AND final_score < 57 THEN 'unfinished ending'
    WHEN list_contains(probs, 'dependent opening') AND {r('hook_score')} < 58 THEN 'dependent opening' END AS gate FROM sel_0),
walk AS (SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS k, CAST([] AS {_ITEM}[]) AS picks, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS reason FROM sel_1
 UNION ALL SELECT project_id, k, CASE WHEN reason IS NULL THEN list_append(picks, CAST(ROW(id, s, e, kind, score, terms) AS {_ITEM})) ELSE picks END, id, score, reason FROM (
  SELECT c.*, w.picks, coalesce(gate, list_filter(list_transform(w.picks, lambda x: {_dup('c', 'x')}), lambda y: y IS NOT NULL)[1],
   CASE WHEN len(list_filter(w.picks, lambda x: x.kind = c.kind)) >= CASE WHEN c.kind = 'metric_reveal' THEN 4 ELSE 3 END THEN c.kind || ' diversity cap' END) AS reason
  FROM walk w JOIN sel_1 c ON c.project_id = w.project_id AND c.k = w.k + 1 WHERE len(w.picks) < 8)),
strict AS (SELECT project_id, k, id, score, reason FROM walk WHERE k > 0),
empty_ AS (SELECT DISTINCT project_id FROM sel_1 WHERE project_id NOT IN (SELECT project_id FROM strict WHERE reason IS NULL)),
fb AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY k) AS j FROM sel_1 WHERE project_id IN (SELECT project_id FROM empty_) AND hard IS NULL AND score >= 40),
walk2 AS (SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS j, CAST([] AS {_ITEM}[]) AS picks, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS reason FROM fb
 UNION ALL SELECT project_id, j, CASE WHEN reason IS NULL THEN list_append(picks, CAST(ROW(id, s, e, kind, score, terms) AS {_ITEM})) ELSE picks END, id, score, reason FROM (
  SELECT c.*, w.picks, coalesce('fallback ' || list_filter(list_transform(w.picks, lambda x: {_dup('c', 'x')}), lambda y: y IS NOT NULL)[1],
   CASE WHEN len(list_filter(w.picks, lambda x: x.kind = c.kind)) >= 2 THEN 'fallback diversity cap' END) AS reason
  FROM walk2 w JOIN fb c ON c.project_id = w.project_id AND c.j = w.j + 1 WHERE len(w.picks) < 3)),
audit AS (SELECT project_id, id, score, 'strict' AS phase, CASE WHEN reason IS NULL THEN 'selected' ELSE 'rejected' END AS decision, reason FROM strict
 UNION ALL SELECT project_id, id, score, 'fallback', CASE WHEN reason IS NULL THEN 'selected' ELSE 'rejected' END, reason FROM walk2 WHERE j > 0)"""


def _audit(spark, sf):
    s = sentences(spark, sf)
    return sl.select_candidates(_candidates(spark, sf), pr.promotional_blocks(s, FIX), CLIP, FIX)


@query(f"""WITH RECURSIVE {SELECT} SELECT a.*, top.s AS start, top.e AS "end",
 CASE WHEN decision = 'selected' THEN row_number() OVER (PARTITION BY a.project_id, phase, decision ORDER BY k) END AS clip_no FROM audit a JOIN top USING (project_id, id)""")
def selection_audit(spark, sf):
    return _audit(spark, sf).select("project_id", "id", "score", "phase", "decision", "reason", "start", "end", "clip_no")


@query(f"""WITH RECURSIVE {SELECT} SELECT regexp_replace(reason, ' (of|as|after) .*$| \\(.*$', '') AS reason_kind, count(*) AS n FROM audit WHERE decision = 'rejected' GROUP BY 1""")
def rejection_profile(spark, sf):
    return sl.reason_profile(_audit(spark, sf))


@query(f"""WITH RECURSIVE {SELECT}, pc AS (SELECT project_id, count(*) AS pool_count FROM top GROUP BY 1),
 d AS (SELECT project_id, count(*) FILTER (decision = 'selected') AS selected_count, count(*) FILTER (decision = 'rejected') AS rejected_count,
   bool_or(phase = 'fallback') AS fallback FROM audit GROUP BY 1)
 SELECT pc.*, selected_count, rejected_count, fallback, (SELECT count(*) FROM promo p WHERE p.project_id = pc.project_id) AS promotional_ranges FROM pc LEFT JOIN d USING (project_id)""")
def selection_summary(spark, sf):
    s = sentences(spark, sf)
    cands, blocks = _candidates(spark, sf), pr.promotional_blocks(s, FIX)
    d = sl.audit_summary(cands, sl.select_candidates(cands, blocks, CLIP, FIX), blocks)
    return d.select("project_id", "pool_count", "selected_count", "rejected_count", "fallback",
                    F.coalesce("promotional_ranges", F.lit(0)).alias("promotional_ranges"))


@query(f"""WITH RECURSIVE {CAL}, nodes AS (SELECT project_id, id, s, e, row_number() OVER (PARTITION BY project_id ORDER BY final_score DESC, s, e, id) AS k FROM calibrated),
 nms AS (SELECT DISTINCT project_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(s DOUBLE, e DOUBLE)[]) AS picks, CAST(NULL AS VARCHAR) AS id, false AS take FROM nodes
 UNION ALL SELECT project_id, k, CASE WHEN take THEN list_append(picks, CAST(ROW(s, e) AS STRUCT(s DOUBLE, e DOUBLE))) ELSE picks END, id, take FROM (
  SELECT n.*, w.picks, len(list_filter(w.picks, lambda x: {_over('n', 'x')} >= 0.55::DOUBLE)) = 0 AS take FROM nms w JOIN nodes n ON n.project_id = w.project_id AND n.k = w.k + 1))
 SELECT project_id, id FROM nms WHERE take""")
def merged_moments(spark, sf):
    return ch.merge_overlapping(_candidates(spark, sf)).select("project_id", "id")


# -- suggestion windows --------------------------------------------------------------------

_P = SuggestionParams(max_window_sec=60.0, overlap_sec=10.0)


@query(f"""WITH RECURSIVE {S.SENTENCES}, lastp AS (SELECT project_id, max("start") AS ls FROM sentences GROUP BY 1),
 st AS (SELECT project_id, min(pos) AS pos, min("start") AS s FROM sentences GROUP BY 1
  UNION ALL SELECT st.project_id, min(b.pos), min(b."start") FROM st JOIN lastp USING (project_id) JOIN sentences b ON b.project_id = st.project_id AND b."start" >= st.s + 50.0::DOUBLE
   WHERE ls >= st.s + 60.0::DOUBLE GROUP BY st.project_id, st.pos, st.s)
 SELECT st.project_id, st.pos AS window_pos, {r('any_value(st.s)', 4)} AS window_start, count(*) AS n_sentences, md5(string_agg(b.text, ' ' ORDER BY b.pos)) AS text
 FROM st JOIN sentences b ON b.project_id = st.project_id AND b.pos >= st.pos AND b."start" < st.s + 60.0::DOUBLE GROUP BY st.project_id, st.pos""")
def prompt_windows(spark, sf):
    d = wn.prompt_windows(sentences(spark, sf), _P)
    lines = F.transform(F.split("transcript", "\n"), lambda l: F.regexp_replace(l, r"^[0-9.]+-[0-9.]+: ", ""))
    return d.select("project_id", "window_pos", round_to(F.col("window_start"), 4).alias("window_start"), "n_sentences",
                    F.md5(F.array_join(lines, " ").cast("binary")).alias("text"))


def _responses(spark, sf):
    """One JSON answer per turn; some damaged, some invalid, some without an end."""
    s = ad.segments(spark, sf)
    k = F.col("pos") + F.col("project_id")
    item = F.concat(
        F.lit('[{"start": '), F.format_string("%.2f", "start"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit(', "end": '), F.format_string("%.2f", F.when(k % 7 == 1, F.col("start")).otherwise(F.col("end"))))),
        F.lit(', "summary": " about turn '), F.col("pos").cast("string"), F.lit(' ", "hook_text": "hook"'), F.when(k % 11 == 5, F.lit("")).otherwise(F.lit("}]")))
    return s.select("project_id", F.col("pos").alias("window_id"), item.alias("response"), "start", "end")


@query(f"""WITH {S.SEGMENTS}, k AS (SELECT *, pos + project_id AS k FROM segments)
 SELECT project_id, 'suggested_' || pos || '_0' AS id, "start", CASE WHEN k % 3 = 0 THEN "start" + 28 ELSE "end" END AS "end", ' about turn ' || pos || ' ' AS summary, 'insight' AS moment_type
 FROM k WHERE k % 11 <> 5 AND NOT (k % 3 <> 0 AND (k % 7 = 1 OR "end" <= "start"))""")
def suggestions(spark, sf):
    return fl.parse_suggestions(_responses(spark, sf)).select("project_id", "id", "start", "end", "summary", "moment_type")


@query(f"""WITH {S.SENTENCES}, k AS (SELECT *, pos + project_id AS k FROM segments),
 g AS (SELECT project_id, 'suggested_' || pos || '_0' AS id, "start" AS s, CASE WHEN k % 3 = 0 THEN "start" + 28 ELSE "end" END AS e, 'about turn ' || pos AS summary
  FROM k WHERE k % 11 <> 5 AND NOT (k % 3 <> 0 AND (k % 7 = 1 OR "end" <= "start")))
 SELECT g.project_id, g.id, g.summary, 66.0::DOUBLE AS final_score, md5({S.strip("coalesce(string_agg(t.text, ' ' ORDER BY t.pos), '')")}) AS text FROM g
 LEFT JOIN sentences t ON t.project_id = g.project_id AND t."end" >= g.s AND t."start" <= g.e GROUP BY ALL""")
def suggested_moments(spark, sf):
    d = cal.suggestion_moments(fl.parse_suggestions(_responses(spark, sf)), sentences(spark, sf))
    return d.select("project_id", "id", "summary", "final_score", F.md5(F.col("text").cast("binary")).alias("text"))


# -- the whole job ------------------------------------------------------------------------

_PARAMS = Params(clips=CLIP, learning=LearningParams(enabled=False))


@query()
def interesting_moments(spark, sf):
    """Pool from windows and suggestions, calibrated, boosted, gated."""
    s = sentences(spark, sf)
    d = cal.find_moments(s, CLIP, FIX, fl.parse_suggestions(_responses(spark, sf)), _scene_cuts(spark, sf))
    return d.select("project_id", "id", "start", "end", "final_score", "moment_type", "visual_energy_score", "dialogue_score")


@query()
def analysis(spark, sf):
    """Transcripts to shortlist in one job."""
    segs = ad.segments(spark, sf)
    a = an.analyze(segs, ad.recording_durations(segs), _PARAMS, FIX)
    return a.selected.select("project_id", "clip_no", "id", "start", "end", "final_score", "moment_type")
