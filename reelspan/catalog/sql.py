"""SQL fragments for the DuckDB side of the correctness check."""

from __future__ import annotations

from reelspan.functions.text import TOKEN, WS
from reelspan.lexicon import Lexicon

WORD_CHAR = r"\pL\p{Nd}_\pM"

# A lexicon in the invented languages of the test tables.
FIX = Lexicon(
    disclosure=("therein", "keitver"), cta=("onwh", "quement "), cta_pair=("hean", "retion"),
    offer=("antion", "heit"), urgency=("erble", "elle la"), context=("ning of", "ionel"),
    brand_regex=r"\b[A-Z][a-z]+\s+(?:the|of|and|die)\b",
    generic=("ndthe", "lich die", "aux de"), low_information=("that is", "que la"),
    controversial=("erti", "schu"), how_to=("ing of", "der "), warning=("onor", "por "),
    result=("retion", "ement"), before_after=("anan", "verein"), personal_story=("una ", "mit "),
    design_marker="ouai", meme_markers=("whha", "enst"), humor=("thth", "eau "),
    contrast=(" but ", " und ", " with "), result_words=("ertion", "onre", "eauch"),
    quantity_words=("inble", "keit", "oion"), before_now=(("was", "from"), ("la ", "por ")),
    dependent_openings=("and ", "la ", "er ", "re"), score_teasers=("the wh", "en la"),
    dangling=("the", "of", "la", "der"), arc_teasers=("of the", "zu"), arc_results=("ertion",),
    arc_spoken_quantity=("inble",), arc_counted=("heit", "er"), topic_resets=("onan", "reea", "qui"),
    filler_openings=("the ", "en ", "an"), stopwords=("that", "with", "this", "from"),
    dangling_endings=("the", "of", "la", "a", "er"), curiosity=("that", "que", "ist", "on"),
    post_payoff=("la ", "the ", "an"), deictic_endings=("er", "ing", "eau"), followups=("and ", "die ", "re"),
    caption_orphans=("a", "the", "la", "en"), question_strong=("the",), question_cues=("the", "la"),
    question_fillers=("of",), cue_contrast=("and", "und", "que"), cue_reveal=("that", "est"),
    cue_stakes=("ont", "ver"), quantity_scores=(("for", 9.6), ("die", 9.4)), fact_units=("th", "e"),
    feature_results=("ertion", "result"),
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, {q(WS + '+')}, ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def norm(x: str) -> str:
    return collapse(f"replace(lower({x}), 'ё', 'е')")


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def starts(x: str, words) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {q(w)})" for w in words) + ")"


def ends(x: str, words) -> str:
    return "(" + " OR ".join(f"suffix({x}, {q(w)})" for w in words) + ")"


def n_words(x: str) -> str:
    c = collapse(x)
    return f"(CASE WHEN {c} = '' THEN 0 ELSE len(string_split({c}, ' ')) END)"


def r(x: str, places: int = 2) -> str:
    return f"CAST(round(CAST(round(CAST({x} AS DOUBLE), 6) AS DECIMAL(24,6)), {places}) AS DOUBLE)"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(TOKEN)})"


def sentences_of(x: str) -> str:
    cut = f"regexp_replace({strip(x)}, {q('([.!?…])' + WS + '+')}, '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda p: {strip('p')}), lambda p: p <> '')"


def first_sentence(clean: str) -> str:
    return f"string_split(regexp_replace({clean}, {q('([.!?…])' + WS + '+')}, '\\1' || chr(1)), chr(1))[1]"


def first_words(x: str, n: int) -> str:
    return f"array_to_string(string_split({x}, ' ')[1:{n}], ' ')"


def strip_set(x: str, chars: str) -> str:
    cls = "[" + "".join("\\" + c if c in r"\]^-[" else c for c in chars) + "]"
    return f"regexp_replace({x}, {q(f'^{cls}+|{cls}+$')}, '', 'g')"


def hook_phrase(clean: str) -> str:
    return strip_set(first_words(first_sentence(clean), 12), " ,;:-")


def drop_last_word(x: str) -> str:
    return f"regexp_replace({x}, ' [^ ]*$', '')"


def summarize(clean: str, n: int) -> str:
    return f"CASE WHEN length({clean}) <= {n} THEN {clean} ELSE {drop_last_word(f'rtrim(left({clean}, {n - 1}))')} || '...' END"


HAS_NUMBER = f"(?:^|[^{WORD_CHAR}])\\p{{Nd}}+(?:$|[^{WORD_CHAR}])"


def has_number(x: str) -> str:
    return f"regexp_matches({x}, {q(HAS_NUMBER)})"


def evidence(text: str, nrm: str, lex: Lexicon) -> str:
    """Sorted list of evidence categories."""
    core = lex.brand_regex.replace(r"\b", "", 1)
    core = core[: -len(r"\b")].replace(r"\s", WS)
    brand = f"regexp_matches({text}, {q(f'(?:^|[^{WORD_CHAR}]){core}(?:$|[^{WORD_CHAR}])')})"
    checks = [
        ("brand", brand), ("context", any_of(nrm, lex.context)),
        ("cta", f"({any_of(nrm, lex.cta)} OR (contains({nrm}, {q(lex.cta_pair[0])}) AND contains({nrm}, {q(lex.cta_pair[1])})))"),
        ("disclosure", any_of(nrm, lex.disclosure)), ("offer", any_of(nrm, lex.offer)), ("urgency", any_of(nrm, lex.urgency)),
    ]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in checks) + "], lambda e: e IS NOT NULL)"


def is_commercial(e: str) -> str:
    def has(*n):
        return f"list_has_all({e}, [{', '.join(q(x) for x in n)}])"
    return f"({has('disclosure')} OR {has('cta')} OR {has('offer', 'urgency')} OR {has('brand', 'offer', 'context')})"


def _count(x: str, ws) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {q(w)}) AS INT)" for w in ws) + ")"


def quality(src: str, text: str, lex: Lexicon, out: str = "quality") -> str:
    """CTEs ending in ``out``: src.* plus quality_penalty, quality_problems."""
    return f"""
{out}_1 AS (SELECT *, {norm(text)} AS _n FROM {src}),
{out}_2 AS (SELECT *, {evidence(text, '_n', lex)} AS _e, {_count('_n', lex.generic)} AS _g,
  {_count('_n', lex.low_information)} AS _l, {words('_n')} AS _w FROM {out}_1),
{out}_3 AS (SELECT *, {is_commercial('_e')} AS _ad, len(_w) AS _k,
  (len(_w) >= 12 AND len(list_distinct(_w)) / greatest(1, len(_w)) < 0.45) AS _rep FROM {out}_2),
{out} AS (SELECT * EXCLUDE (_n, _e, _g, _l, _w, _ad, _k, _rep),
  CAST(CASE WHEN _n = '' THEN 35 ELSE least(95,
    CASE WHEN _ad THEN least(70, 28 + len(_e) * 12) ELSE 0 END + CASE WHEN _g > 0 THEN least(60, 34 + _g * 8) ELSE 0 END
    + CASE WHEN _l > 0 THEN least(35, 15 + _l * 8) ELSE 0 END + CASE WHEN _k < 8 THEN 12 ELSE 0 END
    + CASE WHEN _rep THEN 12 ELSE 0 END) END AS DOUBLE) AS quality_penalty,
  CASE WHEN _n = '' THEN ['empty text'] ELSE list_filter([
    CASE WHEN _ad THEN 'ad or CTA language' END, CASE WHEN _g > 0 THEN 'generic clip-analysis text' END,
    CASE WHEN _l > 0 THEN 'low-information intro/outro' END, CASE WHEN _k < 8 THEN 'too little speech' END,
    CASE WHEN _rep THEN 'repetitive speech' END], lambda p: p IS NOT NULL) END AS quality_problems
  FROM {out}_3)"""


def _pairs(x: str, lex: Lexicon) -> str:
    return "(" + " OR ".join(f"(contains({x}, {q(a)}) AND contains({x}, {q(b)}))" for a, b in lex.before_now) + ")"


def concrete(x: str, lex: Lexicon) -> str:
    return (f"({_pairs(x, lex)} OR {any_of(x, lex.arc_results)} OR {any_of(x, lex.arc_spoken_quantity)}"
            f" OR ({any_of(x, lex.arc_counted)} AND {has_number(x)}))")


def structural(src: str, text: str, lex: Lexicon, out: str = "arc") -> str:
    resets = ", ".join(f"CASE WHEN contains(_n, {q(w)}) THEN instr(_n, {q(w)}) - 1 END" for w in lex.topic_resets)
    dang = ", ".join(q(w) for w in lex.dangling)
    return f"""
{out}_1 AS (SELECT *, {collapse(text)} AS _c FROM {src}),
{out}_2 AS (SELECT *, {norm('_c')} AS _n, {hook_phrase('_c')} AS _h FROM {out}_1),
{out}_3 AS (SELECT *, {norm('_h')} AS _f, {words('_n')} AS _w, {concrete('_n', lex)} AS _con,
  coalesce(list_min([{resets}]), -1) AS _r FROM {out}_2),
{out}_4 AS (SELECT *, (contains(_h, '?') OR contains(_h, '!') OR {has_number('_f')}) AS _strong, coalesce(_w[-1], '') AS _last FROM {out}_3),
{out}_5 AS (SELECT *,
  ({starts('_f', lex.dependent_openings)} AND NOT _strong) AS p1, {starts('_f', lex.filler_openings)} AS p2,
  ({any_of('_n', lex.arc_teasers)} AND NOT _con) AS p3, (_r >= 0 AND _r > length(_n) * 0.25) AS p4,
  ({ends('_c', (',', ';', ':', '...', '…'))} OR _last IN ({dang})) AS p5, suffix(_c, '?') AS p6,
  (NOT _con AND len(_w) >= 18 AND NOT contains(_c, '?') AND NOT contains(_c, '!')) AS p7 FROM {out}_4),
{out} AS (SELECT * EXCLUDE (_c, _n, _h, _f, _w, _con, _r, _strong, _last, p1, p2, p3, p4, p5, p6, p7),
  CAST(p1::INT * 14 + p2::INT * 18 + p3::INT * 38 + p4::INT * 26 + p5::INT * 22 + p6::INT * 28 + p7::INT * 9 AS DOUBLE) AS arc_penalty,
  list_filter([CASE WHEN p1 THEN 'dependent opening' END, CASE WHEN p2 THEN 'filler opening' END,
    CASE WHEN p3 THEN 'teaser without payoff' END, CASE WHEN p4 THEN 'mixed topics' END, CASE WHEN p5 THEN 'unfinished ending' END,
    CASE WHEN p6 THEN 'unanswered question' END, CASE WHEN p7 THEN 'weak payoff' END], lambda p: p IS NOT NULL) AS arc_problems
  FROM {out}_5)"""


def quantity(x: str, lex: Lexicon) -> str:
    """Quantity word, or a first number of three or more digits.

    A number starts and ends at word boundaries; trailing blanks, marks and % add no digits.
    """
    sep = WS[1:-1] + ".,"
    number = f"(?:^|[^{WORD_CHAR}])(\\p{{Nd}}(?:[\\p{{Nd}}{sep}]*\\p{{Nd}})?)(?:[^{WORD_CHAR}]|$)"
    run = f"regexp_extract({x}, {q(number)}, 1)"
    return f"({any_of(x, lex.quantity_words)} OR length(regexp_replace({run}, '\\P{{Nd}}', '', 'g')) >= 3)"


def result(x: str, lex: Lexicon) -> str:
    return f"({_pairs(x, lex)} OR {any_of(x, lex.result_words)})"


def moment_type(text: str, low: str, lex: Lexicon) -> str:
    return f"""CASE WHEN contains({low}, {q(lex.design_marker)}) THEN 'before_after'
 WHEN {any_of(low, lex.meme_markers)} THEN 'comedy'
 WHEN {quantity(low, lex)} AND {result(low, lex)} THEN 'metric_reveal'
 WHEN {any_of(low, lex.humor)} THEN 'comedy' WHEN {any_of(low, lex.controversial)} THEN 'controversial_take'
 WHEN contains({text}, '?') THEN 'question_answer' WHEN {any_of(low, lex.before_after)} THEN 'before_after'
 WHEN {any_of(low, lex.how_to)} THEN 'how_to' WHEN {any_of(low, lex.warning)} THEN 'warning'
 WHEN {any_of(low, lex.result)} THEN 'result' WHEN {any_of(low, lex.personal_story)} THEN 'personal_story' ELSE 'insight' END"""


SCORES = ("semantic_interest_score", "hook_score", "clarity_score", "emotion_score", "novelty_score",
          "standalone_score", "retention_score", "speech_density_score", "audio_energy_score", "visual_energy_score")


def scores(src: str, text: str, duration: str, lex: Lexicon, out: str = "scored") -> str:
    """CTEs ending in ``out``: src.* plus the ten scores, base_score and moment_type."""
    dang = ", ".join(q(w) for w in lex.dangling)

    def cl(x, lo=0):
        return f"CAST(greatest({lo}, least(100, {x})) AS DOUBLE)"

    def i(x):
        return f"CAST({x} AS INT)"

    weights = "0.18 0.18 0.12 0.10 0.10 0.12 0.12 0.04 0.02 0.02".split()
    total = " + ".join(f"{s} * CAST({w} AS DOUBLE)" for s, w in zip(SCORES, weights))
    return f"""
{out}_1 AS (SELECT *, {collapse(text)} AS _c FROM {src}),
{out}_2 AS (SELECT *, {norm('_c')} AS _n, {first_words(first_sentence('_c'), 16)} AS _p FROM {out}_1),
{out}_3 AS (SELECT *, {norm('_p')} AS _f, {words('_n')} AS _w FROM {out}_2),
{out}_4 AS (SELECT *, CAST(len(_w) AS DOUBLE) / greatest(CAST({duration} AS DOUBLE), 1.0) AS _rate,
  length(_c) - length(replace(_c, '?', '')) AS _q, length(_c) - length(replace(_c, '!', '')) AS _x,
  {i(any_of('_n', lex.controversial))} AS _conf, {i(any_of('_n', lex.personal_story))} AS _story,
  {i(result('_n', lex))} AS _res, {i(quantity('_n', lex))} AS _qty, {i(any_of('_n', lex.humor))} AS _hum,
  {i(any_of('_n', lex.contrast))} AS _con, {i(starts('_f', lex.dependent_openings))} AS _dep,
  {i(any_of('_n', lex.score_teasers))} AS _tea,
  {i(f"({ends('_c', (',', ';', ':'))} OR coalesce(_w[-1] IN ({dang}), false))")} AS _unf,
  (contains(_p, '?') OR contains(_p, '!') OR {quantity('_f', lex)}) AS _hooked FROM {out}_3),
{out}_5 AS (SELECT *, _q * 11 + _x * 5 + _qty * 14 + _conf * 12 - CASE WHEN _dep = 1 AND NOT _hooked THEN 22 ELSE 0 END - _tea * 18 AS _hk,
  {i('(_res = 1 OR _qty = 1 OR (_con = 1 AND _unf = 0))')} AS _pay FROM {out}_4),
{out}_6 AS (SELECT *,
  {cl('38 + _conf*16 + _story*5 + _res*18 + _qty*12 + _hum*12 + _q*6 - _tea*20')} AS semantic_interest_score,
  {cl('36 + _hk')} AS hook_score,
  {cl(f'CAST(78 - _dep*20 - _tea*20 - _unf*16 AS DOUBLE) - greatest(0.0::DOUBLE, {duration} - 42) * 0.7::DOUBLE')} AS clarity_score,
  {cl('38 + _conf*15 + _story*7 + _hum*16 + _q*5 + _x*8 + _qty*5')} AS emotion_score,
  {cl('40 + _conf*14 + _res*15 + _qty*14 + _hum*14')} AS novelty_score,
  {cl('76 - _dep*24 - _tea*28 - _unf*24 + _pay*14')} AS standalone_score,
  {cl('40 + greatest(0, _hk) * 0.62::DOUBLE + _pay*16 + _con*8 + _hum*12 - _tea*20')} AS retention_score,
  {cl('_rate * 28', 25)} AS speech_density_score,
  {cl('36 + least(28, _x*8) + least(12, _q*4) + least(20.0::DOUBLE, _rate*7)')} AS audio_energy_score,
  45.0::DOUBLE AS visual_energy_score, {moment_type(text, norm(text), lex)} AS moment_type FROM {out}_5),
{out} AS (SELECT * EXCLUDE (_c,_n,_p,_f,_w,_rate,_q,_x,_conf,_story,_res,_qty,_hum,_con,_dep,_tea,_unf,_hooked,_hk,_pay),
  {r(total)} AS base_score FROM {out}_6)"""


# -- table adapters -----------------------------------------------------------

SEGMENTS = f"""
seg_0 AS (SELECT conv_id AS project_id, turn AS pos, role AS speaker, text, 40 * {n_words('text')} AS dur,
  ((conv_id * 7 + turn * 13) % 5) * 100 AS gap FROM conversations),
seg_1 AS (SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cs FROM seg_0),
segments AS (SELECT project_id, pos, speaker, text, cs, cs / 100.0::DOUBLE AS "start", (cs + dur) / 100.0::DOUBLE AS "end" FROM seg_1)"""

SENTENCES = SEGMENTS + f""",
sent_0 AS (SELECT *, {sentences_of('text')} AS parts FROM segments),
sent_1 AS (SELECT *, CAST(coalesce(sum(len(parts)) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base,
  ("end" - "start") / len(parts) AS span FROM sent_0),
sent_2 AS (SELECT project_id, pos AS seg_pos, speaker, base, span, "start" AS s0, "end" AS e0, len(parts) AS k,
  unnest(parts) AS text, generate_subscripts(parts, 1) - 1 AS i FROM sent_1),
sentences AS (SELECT project_id, base + i AS pos, seg_pos, text, speaker,
  CASE WHEN k = 1 THEN s0 ELSE s0 + i * span END AS "start", CASE WHEN k = 1 THEN e0 ELSE s0 + i * span + span END AS "end" FROM sent_2)"""

FEEDBACK = """
feedback AS (SELECT event_id AS id, user_id AS project_id, event_id % 40 AS clip_id,
  CASE WHEN event_id % 7 <> 0 THEN event_id % 40 END AS moment_id,
  CASE event_type WHEN 'purchase' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'rendered' ELSE 'edited' END AS action,
  CASE WHEN event_type = 'signup' THEN CAST(1 + event_id % 5 AS INT) END AS user_rating, ts AS created_at FROM events)"""

METRICS = """
metrics AS (SELECT event_id AS id, user_id AS project_id, event_id % 40 AS clip_id,
  CASE WHEN event_id % 7 <> 0 THEN event_id % 40 END AS moment_id, ['a','b','c'][CAST(event_id % 3 AS INT) + 1] AS platform,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'u' || (event_id % 40) END AS published_url, event_id % 1000 AS views,
  CASE WHEN event_id % 6 <> 0 THEN value END AS retention_percent, value / 4 AS avg_watch_time_sec, ts AS captured_at FROM events)"""

LATEST = f"""{FEEDBACK}, {METRICS},
latest AS (SELECT *, coalesce(moment_id, clip_id) AS candidate_key FROM feedback
  WHERE action IN ('accept','reject') OR user_rating IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY project_id, coalesce(moment_id, clip_id) ORDER BY created_at DESC, id DESC) = 1),
captures AS (SELECT *, coalesce(moment_id, clip_id) AS candidate_key,
  coalesce(nullif(published_url, ''), CAST(clip_id AS VARCHAR)) AS publication FROM metrics
  QUALIFY row_number() OVER (PARTITION BY project_id, coalesce(moment_id, clip_id), platform,
    coalesce(nullif(published_url, ''), CAST(clip_id AS VARCHAR)) ORDER BY captured_at DESC, id DESC) = 1),
averages AS (SELECT project_id, candidate_key, count(*) AS metric_count, avg(retention_percent) AS retention_percent,
  avg(avg_watch_time_sec) AS avg_watch_time_sec, avg(views) AS views FROM captures GROUP BY ALL)"""

MOMENTS = """
moments AS (SELECT doc_id AS id, source AS project_id, doc_id * 10.0::DOUBLE AS "start", 20.0::DOUBLE + doc_id % 9 AS duration, text,
  left(text, 60) AS summary, left(text, 20) AS hook_text,
  ['insight','controversial_take','how_to','personal_story','result'][CAST(doc_id % 5 AS INT) + 1] AS moment_type,
  """ + ", ".join(f"CAST((doc_id * {k + 3}) % 101 AS DOUBLE) AS {s}" for k, s in enumerate(SCORES)) + """,
  CAST(doc_id % 4 AS INT) AS speaker_count, CAST(doc_id % 6 AS INT) AS speaker_switches,
  CAST((doc_id * 5) % 101 AS DOUBLE) AS dialogue_score, CAST((doc_id * 7) % 101 AS DOUBLE) AS base_score,
  CAST((doc_id * 7) % 101 AS DOUBLE) AS final_score FROM documents)"""

CLIPS = """
clip_0 AS (SELECT user_id AS project_id, event_id % 40 AS id, min(ts) AS created_at, max(value) AS v, count(*) AS k FROM events GROUP BY ALL),
clips AS (SELECT project_id, id, (id * 7) % 40 AS moment_id, k % 2 = 0 AS selected, v > 100 AS rendered, created_at FROM clip_0)"""
