"""Preference-model queries on labelled documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspan.catalog import sql as S
from reelspan.catalog.sql import FIX, r
from reelspan.functions.text import round_to
from reelspan.operators import learning as ln
from reelspan.operators.features import NUMERIC, labeled_rows, parse_snapshot
from reelspan.session import cut_lineage
from reelspan.sources import adapters as ad

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


def _b(x: str) -> str:
    return f"CAST(CAST({x} AS INT) AS DOUBLE)"


_NUM = {
    "word_count": f"CAST({S.n_words('text')} AS DOUBLE)", "words_per_second": f"{S.n_words('text')} / greatest(duration, 1)",
    "starts_with_hook": _b("hook_text <> ''"), "has_conflict": _b("moment_type = 'controversial_take'"),
    "has_story": _b("moment_type = 'personal_story'"), "has_result": _b(S.any_of("lower(ft)", FIX.feature_results)),
    "is_ad_like": _b("list_contains(quality_problems, 'ad or CTA language')"),
    "is_generic_clip_text": _b("list_contains(quality_problems, 'generic clip-analysis text')"),
    "is_low_information": _b("list_contains(quality_problems, 'low-information intro/outro')"),
}
FEATURES = f"""{S.MOMENTS}, fm AS (SELECT m.*, l.quality AS label, concat_ws(' ', text, summary, hook_text) AS ft FROM moments m JOIN labels l ON l.doc_id = m.id),
{S.quality('fm', 'ft', FIX)},
feats AS (SELECT id, project_id, label, moment_type, base_score AS _base, {', '.join(f"CAST({_NUM.get(n, n)} AS DOUBLE) AS f_{n}" for n in NUMERIC)},
  CASE WHEN id % 3 <> 0 THEN CAST(id % 120 AS DOUBLE) END AS retention_percent FROM quality),
long AS (SELECT id, label, name[3:] AS name, value FROM (UNPIVOT feats ON {', '.join('f_' + n for n in NUMERIC)} INTO NAME name VALUE value)),
tot AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM feats),
num AS (SELECT name, (avg(value) FILTER (label = 1) + avg(value) FILTER (label = 0)) / 2 AS centre,
  greatest(-1, least(1, (avg(value) FILTER (label = 1) - avg(value) FILTER (label = 0)) / stddev_pop(value))) * (least(any_value(p), any_value(n)) / (least(any_value(p), any_value(n)) + 4)) * 0.15::DOUBLE AS strength
  FROM long, tot GROUP BY name HAVING stddev_pop(value) > 1e-12),
kinds AS (SELECT moment_type, (count(*) FILTER (label = 1) / greatest(any_value(p), 1) - count(*) FILTER (label = 0) / greatest(any_value(n), 1)) * 6 * count(*) / (count(*) + 4) AS adjustment
  FROM feats, tot GROUP BY 1)"""


def rows(spark, sf):
    """Labelled rows; read by several passes, so cut once."""
    return cut_lineage(ad.training_rows(spark, sf, FIX))


@query(f"WITH {FEATURES} SELECT name, {r('centre', 4)} AS centre, {r('strength', 4)} AS strength FROM num")
def numeric_preferences(spark, sf):
    d = ln.numeric_preferences(rows(spark, sf))
    return d.select("name", round_to(F.col("centre"), 4).alias("centre"), round_to(F.col("strength"), 4).alias("strength"))


@query(f"""WITH {FEATURES}, a AS (SELECT l.id, sum(CASE WHEN value > centre + 1e-9 THEN strength WHEN value < centre - 1e-9 THEN -strength ELSE 0 END) AS s FROM long l JOIN num USING (name) GROUP BY 1)
 SELECT f.id, {r('greatest(-12, least(12, s + coalesce(adjustment, 0)))', 3)} AS adjustment FROM feats f JOIN a USING (id) LEFT JOIN kinds k ON k.moment_type = f.moment_type""")
def online_adjustment(spark, sf):
    d = rows(spark, sf)
    numeric = [tuple(x) for x in ln.numeric_preferences(d).collect()]  # at most 25 rows
    out = ln.with_online_adjustment(d, ln.type_preferences(d), numeric)
    return out.select("id", round_to(F.col("adjustment"), 3).alias("adjustment"))


@query("""WITH s AS (SELECT doc_id AS id, doc_id % 8 AS k FROM documents)
 SELECT id, k IN (0, 7) AS valid FROM s""")
def snapshot_validity(spark, sf):
    """Eight kinds of stored snapshots; only the whole one and the one with missing keys are usable."""
    kinds = [  # FIXED VALUES: damaged forms that must never be replaced
        '{"moment_type":"insight","base_score":50.0,"word_count":12}', "broken JSON", "[]", '{"moment_type":null}',
        '{"moment_type":"insight","duration":"broken"}', '{"moment_type":"insight","base_score":NaN}',
        '{"moment_type":"insight","base_score":101}', '{"moment_type":"insight"}',
    ]
    d = ad.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    js = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("id") % 8).cast("int"))
    return d.select("id", parse_snapshot(js).isNotNull().alias("valid"))


@query(f"""WITH {FEATURES}, d AS (SELECT *, CASE WHEN id % 4 = 0 THEN 'broken' WHEN id % 4 = 1 THEN 'snap' END AS fj FROM feats)
 SELECT id, label, CASE WHEN fj = 'snap' THEN 'snapshot_type' ELSE moment_type END AS moment_type, CASE WHEN fj = 'snap' THEN 22.0::DOUBLE ELSE _base END AS base_score,
  CASE WHEN retention_percent <= 100 THEN retention_percent END AS retention_percent FROM d WHERE fj IS NULL OR fj = 'snap'""")
def labeled_training_rows(spark, sf):
    """Immutable snapshots win, damaged ones drop the row, rows without one use the moment."""
    m = ad.moments(spark, sf).join(ad.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality"), "id")
    i = F.col("id")
    meta = {
        "action": F.when(F.col("quality") == 1, "accept").otherwise("reject"), "user_rating": F.lit(None).cast("int"),
        "features_json": F.when(i % 4 == 0, "broken").when(i % 4 == 1, '{"moment_type":"snapshot_type","base_score":22}'),
        "retention_percent": F.when(i % 3 != 0, (i % 120).cast("double")), "avg_watch_time_sec": F.lit(1.0), "views": F.lit(1),
    }
    d = m.select("id", *[c.alias(n) for n, c in meta.items()], *[F.col(c).alias(f"m_{c}") for c in m.columns if c != "quality"])
    return labeled_rows(d, FIX).select("id", "label", "features.moment_type", "features.base_score", "retention_percent")


FOLDS = FEATURES + """, pr AS (SELECT project_id, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM feats GROUP BY 1),
facts AS (SELECT least(5, count(*) FILTER (p > 0), count(*) FILTER (n > 0)) AS k, count(*) FILTER (p > 0 AND n > 0) AS shared FROM pr),
dealt AS (SELECT project_id, CASE WHEN p > 0 AND n > 0 THEN 0 WHEN p > 0 THEN 1 ELSE 2 END AS kind, length(bin(p + n)) AS size FROM pr),
turns AS (SELECT project_id, row_number() OVER (PARTITION BY kind ORDER BY size DESC, md5(CAST(project_id AS VARCHAR)), project_id) - 1 + CASE WHEN kind = 0 THEN 0 ELSE shared END AS turn, k FROM dealt, facts),
folds AS (SELECT project_id, CAST(turn % k AS INT) AS fold FROM turns WHERE k >= 2)"""
_OTHERS = """, own AS (SELECT *, count(*) OVER () AS n_all, count(*) FILTER (label = 1) OVER () AS p_all, count(*) OVER (PARTITION BY fold) AS n_f, count(*) FILTER (label = 1) OVER (PARTITION BY fold) AS p_f,
  count(*) OVER (PARTITION BY moment_type) AS n_t, count(*) FILTER (label = 1) OVER (PARTITION BY moment_type) AS p_t,
  count(*) OVER (PARTITION BY fold, moment_type) AS n_ft, count(*) FILTER (label = 1) OVER (PARTITION BY fold, moment_type) AS p_ft FROM feats JOIN folds USING (project_id)),
s0 AS (SELECT label AS y, (p_all - p_f) / (n_all - n_f)::DOUBLE AS b, p_t - p_ft AS tp, n_t - n_ft AS tn FROM own), s AS (SELECT y, b, (tp + 4 * b) / (tn + 4) AS p FROM s0),
auc AS (SELECT (SELECT sum(CASE WHEN a.p > c.p THEN 1.0 WHEN a.p = c.p THEN 0.5 ELSE 0 END) / count(*) FROM (SELECT p FROM s WHERE y = 1) a, (SELECT p FROM s WHERE y = 0) c) AS auc)"""


@query(f"""WITH {FOLDS}{_OTHERS}, m AS (SELECT count(*) AS validation_rows, {r('(avg(CAST(p >= 0.5 AS INT)) FILTER (y = 1) + avg(CAST(p < 0.5 AS INT)) FILTER (y = 0)) / 2', 4)} AS balanced_accuracy,
  avg((p - y) * (p - y)) AS brier, avg((b - y) * (b - y)) AS base, -avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END) AS loss FROM s)
 SELECT validation_rows, balanced_accuracy, {r('brier', 4)} AS brier_score, {r('base', 4)} AS baseline_brier_score, {r('loss', 4)} AS log_loss, {r('auc', 4)} AS roc_auc,
  brier < base - 1e-6 AND auc > 0.5 AS passed, CASE WHEN brier < base - 1e-6 AND auc > 0.5 THEN 'passed' ELSE 'below_baseline' END AS status FROM m, auc""")
def validation_metrics(spark, sf):
    """Each row scored by the accept rate of its moment type in the other folds, judged by the rule for models."""
    d = rows(spark, sf)
    folds, _ = ln.fold_map(d)
    m = ln.validation_metrics(cut_lineage(ln.out_of_fold_rates(d, folds)))
    return m.select("validation_rows", "balanced_accuracy", *[round_to(F.col(c), 4).alias(c) for c in ("brier_score", "baseline_brier_score", "log_loss")],
                    "roc_auc", "passed", "status")


@query(f"WITH {FOLDS} SELECT project_id, fold FROM folds")
def validation_folds(spark, sf):
    """Projects per fold; none is split, every training part sees both labels."""
    split = ln.fold_map(rows(spark, sf))
    return split[0] if split else spark.createDataFrame([], "project_id string, fold int")


@query(f"""WITH {FOLDS}, f AS (SELECT fold, count(*) AS validation_rows, count(DISTINCT project_id) AS validation_projects FROM feats JOIN folds USING (project_id) GROUP BY 1)
 SELECT fold, CAST(sum(validation_rows) OVER () - validation_rows AS BIGINT) AS training_rows, validation_rows,
  CAST(sum(validation_projects) OVER () - validation_projects AS BIGINT) AS training_projects, validation_projects FROM f""")
def fold_report(spark, sf):
    d = rows(spark, sf)
    return ln.fold_report(d, *ln.fold_map(d))


@query(f"""WITH {FOLDS} SELECT CAST(i AS INT) AS fold, project_id, CASE WHEN i = fold THEN 'validation' ELSE 'training' END AS part
 FROM folds, facts, unnest(range(k)) AS u(i)""")
def fold_membership(spark, sf):
    """Who trains and who is held out in each fold."""
    return ln.fold_membership(*ln.fold_map(rows(spark, sf)))


@query()
def model_validation(spark, sf):
    """The preference model itself, fitted on the other folds, by the same metrics."""
    d = rows(spark, sf)
    folds, k = ln.fold_map(d)
    return ln.validation_metrics(ln.out_of_fold_model(d, cut_lineage(folds), k))


@query()
def model_scores(spark, sf):
    """Fit on all labelled rows, score the same rows."""
    d = ln.with_sample_weights(rows(spark, sf))
    return ln.predict(ln.fit_model(d), d).select("id", "label", F.round("model_probability", 3).alias("probability"))


@query()
def personal_ranking(spark, sf):
    """Stored moments re-ranked by the online profile."""
    m = ad.moments(spark, sf).withColumns({"reason": F.lit("base"), "personal_score": F.col("base_score")})
    d = ln.personal_ranking(m, rows(spark, sf), None, lex=FIX)
    return d.select("id", "base_score", "personal_score", "final_score", "reason")
