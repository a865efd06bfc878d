"""Caption, cue and edit-plan queries on word streams of clips cut from the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspan.catalog import sql as S
from reelspan.catalog.sql import FIX, q, r
from reelspan.functions.arrays import unfold
from reelspan.functions.text import round2, round_to
from reelspan.lexicon import MONTAGE_PROFILES, MOTION_SCALES
from reelspan.operators import boundary as bd, captions as cp, cues as cu
from reelspan.params import EditParams
from reelspan.session import cut_lineage
from reelspan.sources import adapters as ad

QUERIES, ORACLES = {}, {}
PROFILES = list(MONTAGE_PROFILES)


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def segs(spark, sf):
    return ad.segments(spark, sf, words=True)


def clips_of(segments):
    """One clip per turn, from 0.9 s into the turn to 4 s after it."""
    d = segments.where(F.col("end") > F.col("start")).select(
        "project_id", F.col("pos").alias("id"), round2(F.col("start") + 0.9).alias("start"), round2(F.col("end") + 4.0).alias("end"), "text")
    kinds = F.array(*[F.lit(x) for x in ("insight", "controversial_take", "question", "result")])
    names = F.array(*[F.lit(x) for x in PROFILES])
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: (i * 7.25) - F.col("id") % 5), lambda t: (t > 0) & (F.col("id") % 3 > 0))
    return d.withColumns({
        "duration": round2(F.col("end") - F.col("start")), "moment_type": F.get(kinds, (F.col("id") % 4).cast("int")),
        "profile": F.get(names, ((F.col("id") + F.col("project_id")) % 8).cast("int")), "cuts": cuts,
        "hook_text": F.left("text", F.lit(20)), "suggested_title": F.left("text", F.lit(12)), "summary": F.lit("s"), "suggested_caption": F.lit("c")})


CLIPS = S.SEGMENTS + f""",
clips AS (SELECT project_id, pos AS id, {r('"start" + 0.9')} AS s, {r('"end" + 4.0')} AS e, {r(f'''{r('"end" + 4.0')} - {r('"start" + 0.9')}''')} AS duration, text,
  ['insight','controversial_take','question','result'][CAST(pos % 4 AS INT) + 1] AS kind,
  [{', '.join(q(p) for p in PROFILES)}][CAST((pos + project_id) % 8 AS INT) + 1] AS profile,
  list_filter(list_transform(range(1, 13), lambda i: i * 7.25::DOUBLE - pos % 5), lambda t: t > 0 AND pos % 3 > 0) AS cuts FROM segments WHERE "end" > "start"),
w0 AS (SELECT project_id, pos AS seg, cs, speaker, unnest(list_filter(string_split({S.collapse('text')}, ' '), lambda w: w <> '')) AS word,
  generate_subscripts(list_filter(string_split({S.collapse('text')}, ' '), lambda w: w <> ''), 1) - 1 AS i FROM segments),
words AS (SELECT *, (cs + i * 40) / 100.0::DOUBLE AS ws, (cs + i * 40 + 35) / 100.0::DOUBLE AS we FROM w0)"""


@query(f"""WITH {CLIPS} SELECT c.project_id, c.id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY ws, we)) AS words,
 {r('min(greatest(ws, s))')} AS first, {r('max(least(we, e))')} AS last FROM clips c JOIN segments g ON g.project_id = c.project_id AND g."end" >= s AND g."start" <= e
 JOIN words w ON w.project_id = c.project_id AND w.seg = g.pos AND we > s + 0.02::DOUBLE AND ws < e - 0.02::DOUBLE GROUP BY ALL""")
def clip_words(spark, sf):
    sg = segs(spark, sf)
    d = cp.clip_words(clips_of(sg), sg).where(F.size("words") > 0)
    return d.select("project_id", "id", F.size("words").cast("long").alias("n"),
                    F.md5(F.array_join(F.transform("words", lambda w: w["word"]), " ").cast("binary")).alias("words"),
                    round2(F.array_min(F.transform("words", lambda w: w["start"]))).alias("first"),
                    round2(F.array_max(F.transform("words", lambda w: w["end"]))).alias("last"))


@query(f"""WITH {CLIPS}, p AS (SELECT c.project_id, c.id, g.pos, coalesce((SELECT string_agg(word, ' ' ORDER BY i) FROM words w WHERE w.project_id = c.project_id AND w.seg = g.pos
   AND we > s + 0.02::DOUBLE AND ws < e - 0.02::DOUBLE), {S.strip('g.text')}) AS part FROM clips c JOIN segments g ON g.project_id = c.project_id AND g."end" > s AND g."start" < e),
 t AS (SELECT project_id, id, {S.collapse("string_agg(part, ' ' ORDER BY pos)")} AS t FROM p GROUP BY 1, 2),
 f AS (SELECT *, {S.strip_set(S.first_words(S.collapse(S.first_sentence('t')), 10), ' ,;:-')} AS f, {S.sentences_of('t')} AS ss FROM t)
 SELECT project_id, id, md5(t) AS text, CASE WHEN length(f) <= 76 THEN f ELSE regexp_replace({S.drop_last_word('left(f, 76)')}, '[ ,;:\\-]+$', '') END AS title,
  array_to_string(ss[1:2], ' ') AS caption, CASE WHEN length(t) <= 260 THEN t ELSE {S.drop_last_word('left(t, 257)')} || '...' END AS summary FROM f""")
def refreshed_clips(spark, sf):
    sg = segs(spark, sf)
    d = bd.refresh_clip_context(clips_of(sg), sg)
    return d.where(F.col("suggested_caption") != "c").select(
        "project_id", "id", F.md5(F.col("text").cast("binary")).alias("text"), F.col("suggested_title").alias("title"),
        F.col("suggested_caption").alias("caption"), "summary")


@query()
def caption_cues(spark, sf):
    sg = segs(spark, sf)
    d = cp.caption_cues(clips_of(sg), sg, lex=FIX)
    return d.select("project_id", "clip_id", "idx", round2(F.col("start")).alias("start"), round2(F.col("end")).alias("end"), "text", "speaker")


@query()
def srt_documents(spark, sf):
    sg = segs(spark, sf)
    return cp.srt_documents(cp.caption_cues(clips_of(sg), sg, lex=FIX))


@query()
def caption_quality(spark, sf):
    sg = segs(spark, sf)
    clips = clips_of(sg)
    full = cut_lineage(cp.caption_quality(clips, cp.caption_cues(clips, sg, lex=FIX)))
    local = full.select("project_id", "id", (F.col("tail") + F.col("id") % 4).alias("tail"), (F.col("id") % 5 == 0).alias("synthetic"))
    return full.join(cp.caption_source(full, local), ["project_id", "id"])


def _annotated(spark, sf):
    sg = segs(spark, sf)
    return cu.annotate_words(cu.with_inner_cuts(cu.spoken_words(clips_of(sg), sg)), lex=FIX)


_BARE = f"regexp_replace(lower(word), '[^{S.WORD_CHAR}]', '', 'g')"
CUES = CLIPS + f""",
cw AS (SELECT c.project_id, c.id, c.kind, c.duration, {_BARE} AS norm, word, greatest(0.0::DOUBLE, ws - s) AS st, least(duration, we - s) AS en
  FROM clips c JOIN segments g ON g.project_id = c.project_id AND g."end" >= s AND g."start" <= e JOIN words w ON w.project_id = c.project_id AND w.seg = g.pos AND we >= s AND ws <= e)"""


def _in(x, ws):
    return f"{x} IN ({', '.join(q(w) for w in ws)})"


@query(f"""WITH {CUES}, k AS (SELECT *, CASE WHEN {_in('norm', FIX.question_strong)} THEN 'question' WHEN {_in('norm', FIX.cue_reveal)} THEN 'reveal'
   WHEN {_in('norm', FIX.cue_contrast)} THEN 'contrast' WHEN {S.starts('norm', FIX.cue_stakes)} THEN 'stakes' END AS cue FROM cw WHERE norm <> '')
 SELECT project_id, id, {r('st + 0.06::DOUBLE')} AS ts, cue AS kind, {r('''CASE cue WHEN 'question' THEN 9.4::DOUBLE + CASE WHEN kind IN ('controversial_take','question') THEN 0.4::DOUBLE ELSE 0 END
  WHEN 'reveal' THEN 8.9::DOUBLE + CASE WHEN kind IN ('insight','explanation') THEN 0.4::DOUBLE ELSE 0 END
  WHEN 'contrast' THEN 8.5::DOUBLE + CASE WHEN kind = 'controversial_take' THEN 0.4::DOUBLE ELSE 0 END ELSE 7.9::DOUBLE END''')} AS score FROM k WHERE cue IS NOT NULL""")
def lexical_cues(spark, sf):
    d = unfold(_annotated(spark, sf), "cues", "c")
    return d.select("project_id", "id", round2(F.col("c.ts")).alias("ts"), "c.kind", round2(F.col("c.score")).alias("score"))


_STRIP = "[ ,.!?;:…]+"


@query(f"""WITH {CUES}, l AS (SELECT *, lead(word) OVER w AS nw, lead(norm) OVER w AS nn, lead(st) OVER w AS ns FROM cw WINDOW w AS (PARTITION BY project_id, id ORDER BY st, en))
 SELECT project_id, id, greatest(0.35::DOUBLE, {r('st - 0.04::DOUBLE')}) AS ts, CASE norm WHEN 'for' THEN 9.6::DOUBLE ELSE 9.4::DOUBLE END AS score,
  left(upper(replace(regexp_replace(word, '^{_STRIP}|{_STRIP}$', '', 'g') || CASE WHEN ns - en <= 0.42::DOUBLE AND {S.starts('nn', FIX.fact_units)}
   THEN ' ' || regexp_replace(nw, '^{_STRIP}|{_STRIP}$', '', 'g') ELSE '' END, 'ß', 'ss')), 24) AS label FROM l WHERE norm IN ('for', 'die')""")
def fact_labels(spark, sf):
    d = unfold(_annotated(spark, sf), "facts", "c")
    return d.select("project_id", "id", "c.ts", "c.score", F.col("c.text").alias("label"))


_SPAN = "greatest(1.0::DOUBLE, e - s)"
_INNER = f"list_sort(list_filter(cuts, lambda t: t > 0.08::DOUBLE AND t < span - 0.4::DOUBLE))"
BUDGET = CLIPS + f""", b0 AS (SELECT *, {_SPAN} AS span FROM clips), b1 AS (SELECT * EXCLUDE (cuts), {_INNER} AS cuts FROM b0),
 pr AS (SELECT * FROM (VALUES {', '.join(f"({q(k)}, {v[0]}, {v[1]}::DOUBLE, {v[2]}::DOUBLE)" for k, v in MONTAGE_PROFILES.items())}) t(profile, mb, spb, mg))"""


@query(f"""WITH {BUDGET} SELECT project_id, id, CASE WHEN mb = 0 THEN 0 ELSE CAST(greatest(CASE WHEN coalesce(cuts[1], span) >= greatest(4.8::DOUBLE, mg) THEN 1 ELSE 0 END,
  least(mb, greatest(1, ceil(span / spb)), greatest(1, floor(span / 10 * 3))) - floor((len(cuts) + 1) / 2)) AS INT) END AS budget FROM b1 JOIN pr USING (profile)""")
def beat_budgets(spark, sf):
    d = cu.with_profile(cu.with_inner_cuts(clips_of(ad.segments(spark, sf))))
    return d.select("project_id", "id", cu.beat_budget().alias("budget"))


_PEAK = "CASE profile " + " ".join(f"WHEN {q(k)} THEN {v}::DOUBLE" for k, v in MOTION_SCALES.items()) + " ELSE 1.020::DOUBLE END"


@query(f"""WITH {BUDGET}, sh AS (SELECT project_id, id, span, {_PEAK} AS peak, list_concat([0.0::DOUBLE], cuts, [span]) AS b FROM b1 WHERE profile <> 'clean' AND len(cuts) > 0),
 ex AS (SELECT project_id, id, span, peak, generate_subscripts(b, 1) AS i, b FROM sh), p AS (SELECT *, b[i] AS st, b[i + 1] AS en FROM ex WHERE i < len(b)),
 el AS (SELECT *, row_number() OVER (PARTITION BY project_id, id ORDER BY i) - 1 AS k FROM p WHERE en - st >= 4.2::DOUBLE AND (st >= 0.18::DOUBLE OR en >= 0.7::DOUBLE))
 SELECT project_id, id, {r('st')} AS "start", {r('greatest(st + 0.8::DOUBLE, en - CASE WHEN en >= span - 0.05::DOUBLE THEN 0.22::DOUBLE ELSE 0.04::DOUBLE END)')} AS "end",
  {r('CASE k WHEN 2 THEN least(peak, 1.018::DOUBLE) WHEN 1 THEN 1.008::DOUBLE ELSE 1.0 END', 3)} AS scale_from,
  {r('CASE k WHEN 2 THEN 1.002::DOUBLE WHEN 1 THEN peak ELSE least(peak, 1.022::DOUBLE) END', 3)} AS scale_to,
  'source shot ' || (i - 1) || ': cut-shaped ' || CASE k WHEN 2 THEN 'release' WHEN 1 THEN 'build' ELSE 'push' END AS reason FROM el WHERE k < 3""")
def shot_motions(spark, sf):
    d = cu.with_shot_motion(cu.with_inner_cuts(clips_of(ad.segments(spark, sf))))
    return unfold(d, "motions", "m").select("project_id", "id", "m.*")


def _planned(spark, sf, p=EditParams()):
    sg = segs(spark, sf)
    return cu.plan_cues(clips_of(sg), sg, p, FIX)


@query()
def semantic_accents(spark, sf):
    d = unfold(_planned(spark, sf), "accents", "a", pos="n")
    return d.select("project_id", "id", "n", "a.ts", "a.score", "a.kind", "a.text")


@query()
def montage_beats(spark, sf):
    d = unfold(_planned(spark, sf), "beats", "b", pos="n")
    return d.select("project_id", "id", "budget", "n", "b.ts", "b.duration", "b.score", "b.kind", "b.scale_to")


@query()
def edit_plans(spark, sf):
    d = cu.edit_plan(_planned(spark, sf))
    return d.select("project_id", "clip_id", "profile", "strategy", "natural_cut_count", "generated_effect_count",
                    F.array_join(F.transform("operations", lambda o: o["type"]), ",").alias("operations"))
