"""Text-rule queries over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspan.catalog import sql as S
from reelspan.catalog.sql import FIX, q, r
from reelspan.functions import scoring as sc, text as tx
from reelspan.lexicon import BASE_HASHTAGS, DEFAULT
from reelspan.operators import promo as pr, segment as sg
from reelspan.operators.features import NUMERIC, with_features
from reelspan.sources import adapters as ad

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def docs(spark, sf):
    return ad.texts(spark, sf, "documents").select("doc_id", "text")


# One wrong decoding of every document (UTF-8 bytes read as Latin-1) must be undone exactly
# where the marker score says so; candidates are rebuilt byte by byte in SQL.
_MARKS = " + ".join(
    f"3 * ((length({{x}}) - length(replace({{x}}, {q(m)}, ''))) // length({q(m)}))" for m in DEFAULT.mojibake_markers
) + " + 20 * (length({x}) - length(replace({x}, chr(65533), '')))"
_CP = "".join(c for _, c in tx._CP1251)
_L1 = tx._CP1251_AS_LATIN1


def _bytes_as_utf8(x: str) -> str:
    hexes = f"array_to_string(list_transform(string_split({x}, ''), lambda ch: printf('%02X', ord(ch))), '')"
    return f"CASE WHEN {x} = '' THEN '' ELSE try(decode(unhex({hexes}))) END"


# Text without any marker scores 0 and stays as it is, so only marked text needs its candidates.
_MOJI_STEPS = f"""m AS (SELECT doc_id, text, {_MARKS.format(x='text')} AS st FROM documents),
 c AS (SELECT doc_id, text, st, CASE WHEN st > 0 AND NOT regexp_matches(translate(text, {q(_CP)}, ''), '[^\\x00-\\x7F]')
   THEN {_bytes_as_utf8(f"translate(text, {q(_CP)}, {q(_L1)})")} END AS a,
   CASE WHEN st > 0 AND NOT regexp_matches(text, '[^\\x00-\\x{{FF}}]') THEN {_bytes_as_utf8('text')} END AS b FROM m),
 s AS (SELECT doc_id, text, a, b, st, {_MARKS.format(x='a')} AS sa, {_MARKS.format(x='b')} AS sb FROM c),
 mended AS (SELECT doc_id, text, st, CASE WHEN a IS NOT NULL AND sa < st AND (b IS NULL OR sa <= sb) THEN a
   WHEN b IS NOT NULL AND sb < st THEN b ELSE text END AS repaired FROM s)"""
_MOJI = f"WITH {_MOJI_STEPS} SELECT doc_id, md5(repaired) AS repaired, st AS score FROM mended"


def mended(rel: str, key: str) -> str:
    """CTEs that end in mended(key, text, repaired) over the texts of another relation."""
    return _MOJI_STEPS.replace("doc_id", key).replace("FROM documents", f"FROM {rel}")


@query(_MOJI)
def mojibake_repair(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.md5(tx.repair_mojibake(F.col("text")).cast("binary")).alias("repaired"), tx.mojibake_score(F.col("text")).alias("score"))


@query()
def mojibake_round_trip(spark, sf):
    """Documents damaged by reading UTF-8 as Latin-1, then repaired; same rows as documents."""
    d = docs(spark, sf).withColumn("damaged", F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"))
    d = d.withColumn("repaired", tx.repair_mojibake(F.col("damaged")))
    return d.select("doc_id", (F.col("repaired") == F.col("text")).alias("restored"),
                    (tx.mojibake_score(F.col("repaired")) <= tx.mojibake_score(F.col("damaged"))).alias("not_worse"))


@query(f"SELECT doc_id, md5({S.norm('text')}) AS normalized, {S.n_words('text')} AS n_words FROM documents")
def normalized_text(spark, sf):
    return docs(spark, sf).select(
        "doc_id", F.md5(tx.normalize_clean(F.col("text")).cast("binary")).alias("normalized"), tx.n_words(F.col("text")).alias("n_words"))


@query(f"""WITH n AS (SELECT doc_id, text, {S.norm('text')} AS nrm FROM documents),
 e AS (SELECT doc_id, {S.evidence('text', 'nrm', FIX)} AS e FROM n)
 SELECT doc_id, array_to_string(e, ',') AS evidence, {S.is_commercial('e')} AS commercial FROM e""")
def commercial_evidence(spark, sf):
    d = pr.with_evidence(docs(spark, sf), FIX)
    return d.select("doc_id", F.array_join("evidence", ",").alias("evidence"), tx.is_commercial(F.col("evidence")).alias("commercial"))


@query(f"""WITH {S.quality('documents', 'text', FIX)} SELECT doc_id, quality_penalty,
 array_to_string(quality_problems, ',') AS problems FROM quality""")
def quality_penalty(spark, sf):
    d = sc.with_quality_penalty(docs(spark, sf), "text", FIX)
    return d.select("doc_id", "quality_penalty", F.array_join("quality_problems", ",").alias("problems"))


@query(f"""WITH {S.MOMENTS}, m AS (SELECT *, concat_ws(' ', nullif(text, ''), nullif(summary, ''), nullif(hook_text, '')) AS ft,
   CASE WHEN id % 3 = 0 THEN ['too little speech'] ELSE ['short context'] END AS problems FROM moments),
 {S.quality('m', 'ft', FIX)}, a AS (SELECT *, id % 3 <> 0 AND quality_penalty > 0 AS app FROM quality)
 SELECT id, CASE WHEN app THEN {r('greatest(0.0, final_score - quality_penalty)')} ELSE final_score END AS final_score,
  array_to_string(CASE WHEN app THEN list_concat(problems, quality_problems) ELSE problems END, ',') AS problems,
  CASE WHEN app THEN 'r Quality penalty: -' || CAST(quality_penalty AS INT) || ' for ' || array_to_string(quality_problems, ', ') || '.' ELSE 'r' END AS reason FROM a""")
def applied_quality_penalty(spark, sf):
    m = ad.moments(spark, sf).withColumns({
        "problems": F.array(F.when(F.col("id") % 3 == 0, "too little speech").otherwise("short context")),
        "personal_score": F.col("final_score"), "reason": F.lit("r")})
    d = sc.apply_quality_penalty(m, FIX)
    return d.select("id", "final_score", F.array_join("problems", ",").alias("problems"), "reason")


@query(f"""WITH {S.MOMENTS}, m AS (SELECT *, concat_ws(' ', nullif(text, ''), nullif(summary, ''), nullif(hook_text, '')) AS ft FROM moments),
 {S.quality('m', 'ft', FIX)}, a AS (SELECT id, project_id, {r('greatest(0.0, final_score - quality_penalty)')} AS final_score, quality_problems FROM quality)
 SELECT project_id, id, final_score FROM a WHERE final_score >= 20 AND NOT list_contains(quality_problems, 'ad or CTA language')
 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY final_score DESC, id) <= 8""")
def filtered_quality_moments(spark, sf):
    m = ad.moments(spark, sf).withColumns({
        "problems": F.array().cast("array<string>"), "personal_score": F.col("final_score"), "reason": F.lit("r")})
    return sc.filter_quality(m, 20, 8, FIX).select("project_id", "id", "final_score")


@query(f"""WITH {S.structural('documents', 'text', FIX)} SELECT doc_id, arc_penalty, array_to_string(arc_problems, ',') AS problems FROM arc""")
def structural_penalty(spark, sf):
    d = sc.with_structural_penalty(docs(spark, sf), "text", FIX)
    return d.select("doc_id", "arc_penalty", F.array_join("arc_problems", ",").alias("problems"))


@query(f"""WITH n AS (SELECT doc_id, {S.norm('text')} AS n FROM documents)
 SELECT doc_id, {S.concrete('n', FIX)} AS payoff, {S.quantity('n', FIX)} AS quantity, {S.result('n', FIX)} AS result, {S.has_number('n')} AS number FROM n""")
def text_predicates(spark, sf):
    d = docs(spark, sf).withColumn("n", tx.normalize_clean(F.col("text")))
    n = F.col("n")
    return d.select("doc_id", tx.has_concrete_payoff(n, FIX).alias("payoff"), tx.has_quantity(n, FIX).alias("quantity"),
                    tx.has_result(n, FIX).alias("result"), tx.has_number(n).alias("number"))


_FIRST10 = S.strip_set(S.first_words(S.collapse(S.first_sentence('text')), 10), " ,;:-")


@query(f"""WITH c AS (SELECT doc_id, text, {S.collapse('text')} AS c, {S.sentences_of(S.collapse('text'))} AS p, {_FIRST10} AS f FROM documents)
 SELECT doc_id, {S.first_words(S.first_sentence('c'), 16)} AS first16, {S.hook_phrase('c')} AS hook, coalesce(p[-1], '') AS last_phrase,
  {S.summarize('c', 180)} AS summary, CASE WHEN length(f) <= 76 THEN f
   ELSE regexp_replace({S.drop_last_word('left(f, 76)')}, '[ ,;:\\-]+$', '') END AS complete FROM c""")
def phrases(spark, sf):
    d = docs(spark, sf).withColumn("c", tx.collapse(F.col("text")))
    c = F.col("c")
    return d.select("doc_id", tx.first_phrase(c).alias("first16"), tx.hook_phrase(c).alias("hook"), tx.last_phrase(c).alias("last_phrase"),
                    tx.summarize(c).alias("summary"), tx.first_complete_phrase(F.col("text")).alias("complete"))


_SC = ", ".join(f"{r(s, 4)} AS {s}" for s in S.SCORES)


@query(f"""WITH d AS (SELECT doc_id, text, 10.0::DOUBLE + doc_id % 50 AS duration FROM documents), {S.scores('d', 'text', 'duration', FIX)}
 SELECT doc_id, {_SC}, base_score, moment_type FROM scored""")
def text_scores(spark, sf):
    d = docs(spark, sf).withColumn("duration", F.lit(10.0) + F.col("doc_id") % 50)
    d = sc.with_text_scores(d, "text", "duration", FIX).withColumn("base_score", sc.base_score())
    d = sc.with_moment_type(d, "text", FIX)
    return d.select("doc_id", *[tx.round_to(F.col(n), 4).alias(n) for n in sc.SCORE_NAMES], "base_score", "moment_type")


@query(f"""SELECT doc_id, {r('greatest(0, least(100, (doc_id * 7) % 101 * (1 - 0.35::DOUBLE) + (doc_id * 11) % 101 * 0.35::DOUBLE))')} AS score FROM documents""")
def combined_score(spark, sf):
    i = F.col("doc_id")
    return docs(spark, sf).select("doc_id", sc.combine_personal_score((i * 7) % 101, (i * 11) % 101).alias("score"))


_STOP = ", ".join(q(w) for w in FIX.stopwords)


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter({S.words(S.norm('text'))}, lambda t: length(t) >= 4 AND t NOT IN ({_STOP}))) AS t FROM documents)
 SELECT doc_id, len(t) AS n_terms, md5(array_to_string(list_sort(t), ' ')) AS terms FROM w""")
def text_terms(spark, sf):
    d = docs(spark, sf).withColumn("t", tx.terms(tx.normalize_clean(F.col("text")), FIX))
    return d.select("doc_id", F.size("t").alias("n_terms"), F.md5(F.array_join(F.sort_array("t"), " ").cast("binary")).alias("terms"))


@query(f"""SELECT doc_id, left(sha1(printf('%.1f|%.1f|', doc_id * 10.0::DOUBLE, doc_id * 10.0::DOUBLE + 25) || left({S.collapse('lower(text)')}, 320)), 8) AS fp FROM documents""")
def content_fingerprint(spark, sf):
    i = F.col("doc_id") * 10.0
    return docs(spark, sf).select("doc_id", tx.candidate_fingerprint(i, i + 25, F.col("text")).alias("fp"))


_KW = f"""list_filter(list_transform(string_split({S.collapse('text')}, ' '), lambda w: lower({S.strip_set('w', chr(46) + ',!?;:()[]' + chr(34) + chr(39))})), lambda w: length(w) > 5)[1:5]"""
_TAGS = f"""list_filter(list_transform({_KW}, lambda w: '#' || regexp_replace(w, '[^A-Za-zА-Яа-я0-9_]', '', 'g')), lambda t: length(t) > 1)"""


@query(f"""WITH t AS (SELECT doc_id, list_concat(['#shorts','#tiktok','#reels'], {_TAGS}) AS t FROM documents),
 u AS (SELECT doc_id, list_filter(t, lambda x, i: list_position(t, x) = i) AS t FROM t)
 SELECT d.doc_id, 'TITLE:' || chr(10) || left(text, 40) || chr(10) || chr(10) || 'DESCRIPTION:' || chr(10) || left(text, 90) || chr(10) || chr(10)
  || 'HASHTAGS:' || chr(10) || array_to_string(u.t, ' ') || chr(10) AS copy FROM documents d JOIN u USING (doc_id)""")
def post_copy(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select("doc_id", tx.post_copy(F.left(t, F.lit(40)), F.left(t, F.lit(90)), t, BASE_HASHTAGS).alias("copy"))


@query(f"""WITH p AS (SELECT doc_id, {S.sentences_of('text')} AS p FROM documents)
 SELECT doc_id, unnest(p) AS sentence, generate_subscripts(p, 1) - 1 AS sentence_pos FROM p""")
def plain_sentences(spark, sf):
    return sg.split_plain_text(docs(spark, sf))


@query(f"""WITH {S.MOMENTS}, m AS (SELECT *, concat_ws(' ', text, summary, hook_text) AS ft FROM moments), {S.quality('m', 'ft', FIX)}
 SELECT id, moment_type, duration, base_score, hook_score, CAST({S.n_words('text')} AS DOUBLE) AS word_count,
  {r(f"{S.n_words('text')} / greatest(duration, 1)", 4)} AS words_per_second, quality_penalty,
  CAST(hook_text <> '' AS INT)::DOUBLE AS starts_with_hook, CAST(moment_type = 'controversial_take' AS INT)::DOUBLE AS has_conflict,
  CAST(moment_type = 'personal_story' AS INT)::DOUBLE AS has_story, CAST({S.any_of('lower(ft)', FIX.feature_results)} AS INT)::DOUBLE AS has_result,
  CAST(list_contains(quality_problems, 'ad or CTA language') AS INT)::DOUBLE AS is_ad_like,
  CAST(list_contains(quality_problems, 'generic clip-analysis text') AS INT)::DOUBLE AS is_generic_clip_text,
  CAST(list_contains(quality_problems, 'low-information intro/outro') AS INT)::DOUBLE AS is_low_information FROM quality""")
def clip_features(spark, sf):
    d = with_features(ad.moments(spark, sf), FIX)
    names = ["duration", "base_score", "hook_score", "word_count", "quality_penalty", *NUMERIC[-7:]]
    return d.select("id", "features.moment_type", *[f"features.{n}" for n in names],
                    tx.round_to(F.col("features.words_per_second"), 4).alias("words_per_second"))
