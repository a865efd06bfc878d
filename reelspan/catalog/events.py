"""Event-log queries: decisions, captures, training input, dashboard, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspan.catalog.sql import CLIPS, FEEDBACK, FIX, LATEST, METRICS, MOMENTS, quality, r
from reelspan.functions.text import round2, round_to
from reelspan.operators import events as ev, learning as ln, store as st
from reelspan.sources import adapters as ad

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


@query(f"WITH {LATEST} SELECT project_id, candidate_key, id, action, user_rating FROM latest")
def latest_decisions(spark, sf):
    return ev.latest_decisions(ad.feedback(spark, sf)).select("project_id", "candidate_key", "id", "action", "user_rating")


@query(f"WITH {LATEST} SELECT project_id, candidate_key, platform, publication, id, views FROM captures")
def latest_captures(spark, sf):
    return ev.latest_captures(ad.publish_metrics(spark, sf)).select(
        "project_id", "candidate_key", "platform", "publication", "id", "views")


@query(f"""WITH {LATEST} SELECT project_id, candidate_key, metric_count, {r('retention_percent', 4)} AS retention_percent,
 {r('avg_watch_time_sec', 4)} AS avg_watch_time_sec, {r('views', 4)} AS views FROM averages""")
def candidate_metrics(spark, sf):
    d = ev.candidate_metrics(ev.latest_captures(ad.publish_metrics(spark, sf)))
    return d.select("project_id", "candidate_key", "metric_count", *[round_to(F.col(n), 4).alias(n) for n in ev.METRIC_NAMES])


TRAINING = f"""{LATEST}, {MOMENTS},
joined AS (SELECT l.*, m.id AS m_id, m.moment_type, m.base_score, coalesce(a.metric_count, 0) AS metric_count,
  a.retention_percent, a.avg_watch_time_sec, a.views,
  CASE WHEN action = 'accept' THEN 1 WHEN action = 'reject' THEN 0 WHEN user_rating IN (4,5) THEN 1 WHEN user_rating IN (1,2) THEN 0 END AS label
  FROM latest l LEFT JOIN moments m ON m.id = l.moment_id
  LEFT JOIN averages a ON a.project_id = l.project_id AND a.candidate_key = l.candidate_key),
labelled AS (SELECT *, CASE WHEN retention_percent BETWEEN 0 AND 100 THEN retention_percent END AS kept FROM joined WHERE label IS NOT NULL)"""


def _joined(spark, sf):
    return ev.decisions_with_metrics(ad.feedback(spark, sf), ad.moments(spark, sf), ad.publish_metrics(spark, sf))


def _labelled(spark, sf):
    d = _joined(spark, sf).withColumn("label", ev.label()).where("label IS NOT NULL")
    return d.withColumn("features", F.struct(F.coalesce("m_moment_type", F.lit("none")).alias("moment_type")))


@query(f"""WITH {TRAINING} SELECT project_id, candidate_key, id, action, label, m_id, moment_type AS m_moment_type,
 base_score AS m_base_score, metric_count, {r('retention_percent', 4)} AS retention_percent, {r('views', 4)} AS views FROM joined""")
def training_input(spark, sf):
    return _joined(spark, sf).withColumn("label", ev.label()).select(
        "project_id", "candidate_key", "id", "action", "label", "m_id", "m_moment_type", "m_base_score", "metric_count",
        round_to(F.col("retention_percent"), 4).alias("retention_percent"), round_to(F.col("views"), 4).alias("views"))


@query(f"""WITH {FEEDBACK}, {MOMENTS}, d AS (SELECT moment_id, action FROM feedback WHERE action IN ('accept','reject')
 QUALIFY row_number() OVER (PARTITION BY coalesce(moment_id, clip_id) ORDER BY created_at DESC, id DESC) = 1)
 SELECT count(*) FILTER (action = 'accept') AS accepted_count, count(*) FILTER (action = 'reject') AS rejected_count,
 {r("coalesce(avg(CASE WHEN action = 'accept' THEN final_score END), 0)", 4)} AS average_score_accepted
 FROM d LEFT JOIN moments m ON m.id = d.moment_id""")
def dashboard_decisions(spark, sf):
    d = ev.dashboard_decisions(ad.feedback(spark, sf), ad.moments(spark, sf))
    return d.withColumn("average_score_accepted", round_to(F.col("average_score_accepted"), 4))


@query(f"WITH {MOMENTS} SELECT moment_type, count(*) AS n FROM moments GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_moment_types(spark, sf):
    return ev.top_moment_types(ad.moments(spark, sf))


@query(f"""WITH {FEEDBACK} SELECT count(DISTINCT coalesce(moment_id, clip_id)) AS feedback_count FROM feedback
 WHERE action IN ('accept','reject') OR user_rating IS NOT NULL""")
def feedback_count(spark, sf):
    return ev.feedback_count(ad.feedback(spark, sf))


@query(f"""WITH {METRICS}, ok AS (SELECT CASE WHEN retention_percent BETWEEN 0 AND 100 THEN retention_percent END AS kept,
  avg_watch_time_sec, views FROM metrics)
 SELECT count(kept) AS samples_with_retention, {r('avg(kept)')} AS average_retention_percent,
 {r('median(kept)')} AS median_retention_percent, {r('avg(avg_watch_time_sec)')} AS average_watch_time_sec,
 {r('avg(views)')} AS average_views FROM ok""")
def retention_summary(spark, sf):
    return ln.retention_summary(ad.publish_metrics(spark, sf))


@query(f"""WITH {TRAINING}, c AS (SELECT count(*) AS training_rows, count(*) FILTER (label = 1) AS positive_count,
  count(*) FILTER (label = 0) AS negative_count, count(DISTINCT project_id) AS project_count FROM labelled)
 SELECT *, 3 AS minimum_per_class, least(positive_count, negative_count) >= 3
   AND greatest(positive_count, negative_count) <= least(positive_count, negative_count) * 3 AS balanced,
   training_rows >= 12 AND least(positive_count, negative_count) >= 3
   AND greatest(positive_count, negative_count) <= least(positive_count, negative_count) * 3 AS training_ready FROM c""")
def training_readiness(spark, sf):
    return ln.training_readiness(_labelled(spark, sf))


@query(f"""WITH {TRAINING} SELECT coalesce(moment_type, 'none') AS moment_type, count(*) FILTER (label = 1) AS positives,
 count(*) FILTER (label = 0) AS negatives FROM labelled GROUP BY 1
 HAVING positives >= 2 AND positives > negatives""")
def preferred_types(spark, sf):
    return ln.preferred_types(_labelled(spark, sf))


@query(f"""WITH {TRAINING}, e AS (SELECT count(kept) >= 8 AS on_ FROM labelled)
 SELECT project_id, candidate_key, {r('''CASE WHEN (SELECT on_ FROM e) AND kept IS NOT NULL
 THEN 0.75 + (CASE WHEN label = 1 THEN kept / 100 ELSE 1 - kept / 100 END) * 0.75 ELSE 1.0 END''', 4)} AS weight FROM labelled""")
def sample_weights(spark, sf):
    d = ln.with_sample_weights(_labelled(spark, sf))
    return d.select("project_id", "candidate_key", round_to(F.col("weight"), 4).alias("weight"))


@query(f"""WITH {TRAINING}, t AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM labelled),
 g AS (SELECT coalesce(moment_type, 'none') AS moment_type, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS tn FROM labelled GROUP BY 1)
 SELECT moment_type, {r('(tp / greatest(p, 1) - tn / greatest(n, 1)) * 6 * (tp + tn) / (tp + tn + 4)', 5)} AS adjustment FROM g, t""")
def type_preferences(spark, sf):
    d = ln.type_preferences(_labelled(spark, sf))
    return d.select("moment_type", round_to(F.col("adjustment"), 5).alias("adjustment"))


_FP = """SELECT count(*) AS n, """ + ", ".join(
    f"sum(CAST(('0x' || substr(h, {15 * i + 1}, 15)) AS UBIGINT)) AS h{i}" for i in range(4)) + " FROM hashed"


@query(f"""WITH {TRAINING}, hashed AS (SELECT sha256(concat_ws('|', project_id, candidate_key, label,
   coalesce(CAST(CAST(round(kept * 10000) AS BIGINT) AS VARCHAR), '-'))) AS h FROM labelled), s AS ({_FP})
 SELECT sha256(concat_ws('|', 'settings', n, h0, h1, h2, h3)) AS fingerprint FROM s""")
def training_fingerprint(spark, sf):
    d = _labelled(spark, sf).select(F.concat_ws(
        "|", "project_id", "candidate_key", "label",
        F.coalesce(F.round(ev.metric_value("retention_percent") * 10000).cast("long").cast("string"), F.lit("-"))).alias("p"))
    return ln.digest(d, "p", "settings")


@query(f"""WITH {FEEDBACK}, {MOMENTS}, {CLIPS},
 hits AS (SELECT c.project_id, c.id AS clip, f.id, f.action, f.created_at FROM clips c JOIN feedback f
   ON f.project_id = c.project_id AND (f.clip_id = c.id OR f.moment_id = c.moment_id)),
 g AS (SELECT project_id, clip, arg_max(action, (created_at, id)) AS latest_feedback_action,
   arg_max(action, (created_at, id)) FILTER (action IN ('accept','reject')) AS review_action,
   bool_or(action = 'edited') AS boundaries_edited FROM hits GROUP BY ALL)
 SELECT c.project_id, c.id, c.moment_id, m.final_score, m.moment_type,
   CASE WHEN c.id % 3 = 0 THEN 'banger' ELSE 'balanced' END AS edit_profile,
   latest_feedback_action, review_action, coalesce(boundaries_edited, false) AS boundaries_edited
 FROM clips c JOIN moments m ON m.id = c.moment_id LEFT JOIN g ON g.project_id = c.project_id AND g.clip = c.id""")
def list_clips(spark, sf):
    clips = ad.clips(spark, sf)
    plans = clips.where("id % 3 = 0").select(F.col("id").alias("clip_id"), F.lit("banger").alias("profile")).distinct()
    d = ev.list_clips(clips, ad.moments(spark, sf), plans, ad.feedback(spark, sf))
    return d.select("project_id", "id", "moment_id", "final_score", "moment_type", "edit_profile",
                    "latest_feedback_action", "review_action", "boundaries_edited")


@query(f"""WITH {CLIPS}, p AS (SELECT DISTINCT user_id AS project_id FROM events)
 SELECT p.project_id, bool_or(c.id IS NOT NULL) AS has_clips, coalesce(bool_or(rendered), false) AS has_rendered
 FROM p LEFT JOIN clips c USING (project_id) GROUP BY 1""")
def clip_flags(spark, sf):
    projects = ad.table(spark, sf, "events").select(F.col("user_id").alias("project_id")).distinct()
    return ev.clip_flags(projects, ad.clips(spark, sf))


def _activity_tables(spark, sf):
    e = ad.table(spark, sf, "events").withColumn("project_id", F.col("user_id"))
    projects = e.groupBy("project_id").agg(F.min("ts").alias("created_at"))
    videos = e.where("event_type = 'click'").select(
        "project_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("uploaded_at"),
        F.col("value").alias("duration"))
    transcripts = e.where("event_type = 'signup'").select("project_id", F.col("ts").alias("created_at"))
    return projects, videos, transcripts


@query(f"""WITH {FEEDBACK}, p AS (SELECT user_id AS project_id, min(ts) AS created_at FROM events GROUP BY 1),
 v AS (SELECT user_id AS project_id, CASE WHEN event_id % 5 <> 0 THEN ts END AS up FROM events WHERE event_type = 'click'
   QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
 x AS (SELECT p.project_id, p.created_at, CASE WHEN v.project_id IS NOT NULL THEN coalesce(v.up, p.created_at) END AS uploaded_at,
  (SELECT max(ts) FROM events e WHERE e.user_id = p.project_id AND event_type = 'signup') AS analyzed_at,
  (SELECT max(created_at) FROM feedback f WHERE f.project_id = p.project_id AND action = 'rendered') AS rendered_at,
  (SELECT max(created_at) FROM feedback f WHERE f.project_id = p.project_id) AS feedback_at FROM p LEFT JOIN v USING (project_id))
 SELECT *, greatest(created_at, uploaded_at, analyzed_at, rendered_at, feedback_at) AS last_activity_at FROM x""")
def project_activity(spark, sf):
    projects, videos, transcripts = _activity_tables(spark, sf)
    return ev.project_activity(projects, videos, transcripts, ad.feedback(spark, sf))


@query("""SELECT user_id AS project_id, event_id AS seq, value AS duration FROM events WHERE event_type = 'click'
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def newest_video(spark, sf):
    return ev.newest_video(_activity_tables(spark, sf)[1]).select("project_id", "seq", "duration")


@query(f"WITH {CLIPS} SELECT project_id, id FROM clips WHERE selected")
def selected_clips(spark, sf):
    return ev.select_clips(ad.clips(spark, sf)).select("project_id", "id")


@query(f"""WITH {CLIPS}, {FEEDBACK}, ids AS (SELECT DISTINCT clip_id AS id FROM feedback WHERE action = 'accept')
 SELECT project_id, id FROM clips WHERE id IN (SELECT id FROM ids)""")
def requested_clips(spark, sf):
    ids = ad.feedback(spark, sf).where("action = 'accept'").select(F.col("clip_id").alias("id"))
    return ev.select_clips(ad.clips(spark, sf), ids).select("project_id", "id")


# -- rules and stores -----------------------------------------------------------


def _requests(spark, sf):
    """Feedback with ratings on every third row, so that some break a rule."""
    f = ad.feedback(spark, sf)
    return f.withColumn("user_rating", F.when(F.col("id") % 3 == 0, (F.col("id") % 8).cast("int")).otherwise(F.col("user_rating")))


@query(f"""WITH {FEEDBACK}, q AS (SELECT id, action, CASE WHEN id % 3 = 0 THEN CAST(id % 8 AS INT) ELSE user_rating END AS r FROM feedback)
 SELECT id, array_to_string(list_filter([CASE WHEN r < 1 OR r > 5 THEN 'rating range' END,
  CASE WHEN action = 'accept' AND r <= 2 THEN 'accept needs rating >= 3' END,
  CASE WHEN action = 'reject' AND r >= 4 THEN 'reject needs rating <= 3' END], lambda v: v IS NOT NULL), '; ') AS violations FROM q""")
def feedback_rules(spark, sf):
    d = _requests(spark, sf).withColumn("v", ev.feedback_violations())
    return d.select("id", F.array_join("v", "; ").alias("violations"))


@query(f"""WITH {METRICS} SELECT id, array_to_string(list_filter([
  CASE WHEN retention_percent > 100 THEN 'retention_percent' END], lambda v: v IS NOT NULL), '; ') AS violations FROM metrics""")
def metric_rules(spark, sf):
    m = ad.publish_metrics(spark, sf).withColumns({c: F.lit(0) for c in ("likes", "comments", "shares", "saves")})
    return m.select("id", F.array_join(ev.metric_violations(), "; ").alias("violations"))


@query(f"""WITH {FEEDBACK}, q AS (SELECT id, action, moment_id, CASE WHEN id % 3 = 0 THEN CAST(id % 8 AS INT) ELSE user_rating END AS r FROM feedback),
 ok AS (SELECT * FROM q WHERE NOT (coalesce(r < 1 OR r > 5, false) OR coalesce(action = 'accept' AND r <= 2, false) OR coalesce(action = 'reject' AND r >= 4, false))),
 m AS (SELECT doc_id AS id, text, left(text, 60) AS s, left(text, 20) AS h FROM documents), {quality("(SELECT *, text || ' ' || s || ' ' || h AS full_text FROM m)", 'full_text', FIX)}
 SELECT ok.id, ok.action, quality_penalty AS penalty, quality.id IS NOT NULL AS has_snapshot FROM ok LEFT JOIN quality ON quality.id = ok.moment_id""")
def feedback_append(spark, sf):
    # the stored moments carry no project of the event table, so both sides get one
    m = ad.moments(spark, sf).withColumn("project_id", F.lit(0))
    rows, _ = st.feedback_rows(_requests(spark, sf).withColumn("project_id", F.lit(0)), m, FIX)
    return rows.select(
        "id", "action", F.get_json_object("features_json", "$.quality_penalty").cast("double").alias("penalty"),
        F.col("features_json").isNotNull().alias("has_snapshot"))


def _one_project_clips(spark, sf):
    return ad.clips(spark, sf).groupBy("id").agg(F.min("project_id").alias("project_id"), F.min("moment_id").alias("moment_id"))


_C1 = f"{CLIPS}, c1 AS (SELECT id, min(project_id) AS project_id, min(moment_id) AS moment_id FROM clips GROUP BY 1)"


@query(f"""WITH {METRICS}, {_C1}, c2 AS (SELECT * FROM c1 WHERE id % 4 <> 1),
 m AS (SELECT id, clip_id, CASE WHEN id % 5 <> 0 THEN project_id END AS p, moment_id FROM metrics)
 SELECT m.id, coalesce(p, c2.project_id) AS project_id, coalesce(m.moment_id, c2.moment_id) AS moment_id
 FROM m LEFT JOIN c2 ON c2.id = m.clip_id WHERE c2.id IS NOT NULL OR (p IS NOT NULL AND m.moment_id IS NOT NULL)""")
def metric_append(spark, sf):
    m = ad.publish_metrics(spark, sf).withColumn("project_id", F.when(F.col("id") % 5 != 0, F.col("project_id")))
    rows, _ = st.metric_rows(m, _one_project_clips(spark, sf).where("id % 4 <> 1"))
    return rows.select("id", "project_id", "moment_id")


@query(f"""WITH {METRICS}, {_C1}, c2 AS (SELECT * FROM c1 WHERE id % 4 <> 1),
 m AS (SELECT id, clip_id, CASE WHEN id % 5 <> 0 THEN project_id END AS p, moment_id FROM metrics)
 SELECT m.id, coalesce(p, c2.project_id) AS project_id, coalesce(m.moment_id, c2.moment_id) AS moment_id
 FROM m LEFT JOIN c2 ON c2.id = m.clip_id WHERE coalesce(p, c2.project_id) IS NOT NULL""")
def metrics_rebuild(spark, sf):
    m = ad.publish_metrics(spark, sf).withColumn("project_id", F.when(F.col("id") % 5 != 0, F.col("project_id")))
    return st.rebuild_metrics(m, _one_project_clips(spark, sf).where("id % 4 <> 1")).select("id", "project_id", "moment_id")


@query("""WITH old AS (SELECT user_id AS p, event_id % 40 AS id, count(*) AS n FROM events GROUP BY ALL),
 refs AS (SELECT DISTINCT user_id AS p, event_id % 40 AS id FROM events WHERE event_id % 7 <> 0 AND event_type = 'purchase'),
 fresh AS (SELECT p, id + 20 AS id, n + 1000 AS n FROM old WHERE p % 2 = 0 AND id % 3 = 0)
 SELECT p AS project_id, id, n FROM old WHERE p NOT IN (SELECT p FROM fresh)
 UNION ALL SELECT p, id, n FROM old WHERE p IN (SELECT p FROM fresh) AND (p, id) IN (SELECT (p, id) FROM refs) AND (p, id) NOT IN (SELECT (p, id) FROM fresh)
 UNION ALL SELECT p, id, n FROM fresh""")
def replace_generation(spark, sf):
    old = ad.table(spark, sf, "events").groupBy(F.col("user_id").alias("project_id"), (F.col("event_id") % 40).alias("id")).agg(F.count("*").alias("n"))
    fresh = old.where("project_id % 2 = 0 AND id % 3 = 0").select("project_id", (F.col("id") + 20).alias("id"), (F.col("n") + 1000).alias("n"))
    refs = ad.feedback(spark, sf).where("action = 'accept'")
    return st.replace_generation(old, fresh, refs)


@query("""WITH x AS (SELECT user_id AS project_id, event_id % 40 AS id, event_id AS v, value, ts FROM events)
 SELECT project_id, id, max(v) AS v, arg_max(value, v) AS value, min(ts) AS created_at FROM x GROUP BY 1, 2""")
def clip_upsert(spark, sf):
    x = ad.table(spark, sf, "events").select(
        F.col("user_id").alias("project_id"), (F.col("event_id") % 40).alias("id"), F.col("event_id").alias("v"), "value",
        F.col("ts").alias("created_at"))
    return st.upsert(x.where("v % 2 = 0"), x.where("v % 2 = 1"), ["project_id", "id"], "v", keep_first=("created_at",))


@query("""WITH t AS (SELECT user_id AS project_id, event_id, value FROM events WHERE event_type = 'signup'),
 fresh AS (SELECT project_id, event_id + 1000000 AS event_id, value FROM t WHERE event_id % 10 = 0)
 SELECT * FROM t WHERE project_id NOT IN (SELECT project_id FROM fresh) UNION ALL SELECT * FROM fresh""")
def transcript_replace(spark, sf):
    t = ad.table(spark, sf, "events").where("event_type = 'signup'").select(F.col("user_id").alias("project_id"), "event_id", "value")
    fresh = t.where("event_id % 10 = 0").withColumn("event_id", F.col("event_id") + 1000000)
    return st.replace_per_project(t, fresh)


@query(f"""WITH {FEEDBACK}, s AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'snap' || id END AS fj FROM feedback),
 filled AS (SELECT s.id, coalesce(s.fj, (SELECT d.fj FROM s d WHERE d.project_id = s.project_id AND d.fj IS NOT NULL
   AND (d.moment_id = s.moment_id OR d.clip_id = s.clip_id) ORDER BY d.created_at DESC, d.id DESC LIMIT 1)) AS features_json FROM s)
 SELECT * FROM filled""")
def snapshot_backfill(spark, sf):
    f = ad.feedback(spark, sf).withColumn("features_json", F.when(F.col("id") % 9 == 0, F.concat(F.lit("snap"), "id")))
    none = ad.moments(spark, sf).withColumn("id", -1 - F.col("id"))  # no moment of its own: only donors fill
    return st.backfill_snapshots(f, none, FIX).select("id", "features_json")


@query(f"""WITH {FEEDBACK}, meta AS (SELECT DISTINCT user_id AS project_id, event_id % 40 AS clip_id,
   CASE WHEN event_id % 2 = 0 THEN event_id % 40 ELSE 39 - event_id % 40 END AS moment_id FROM events)
 SELECT f.id, f.action IN ('accept','reject') AND m.clip_id IS NOT NULL AS filled FROM feedback f
 LEFT JOIN meta m ON m.project_id = f.project_id AND m.clip_id = f.clip_id AND m.moment_id = f.moment_id""")
def metadata_backfill(spark, sf):
    f = ad.feedback(spark, sf).withColumn("features_json", F.lit(None).cast("string"))
    e = F.col("event_id") % 40
    meta = ad.table(spark, sf, "events").select(
        F.col("user_id").alias("project_id"), e.alias("clip_id"),
        F.when(F.col("event_id") % 2 == 0, e).otherwise(39 - e).alias("moment_id"),
        F.lit("insight").alias("moment_type"), F.lit("some words").alias("text")).distinct()
    d = st.backfill_from_metadata(f, meta, FIX)
    return d.select("id", F.col("features_json").isNotNull().alias("filled"))


@query(f"""WITH {TRAINING}, k AS (SELECT list_sort(coalesce(list(moment_type), [])) AS pt FROM (
   SELECT coalesce(moment_type, 'none') AS moment_type FROM labelled GROUP BY 1
   HAVING count(*) FILTER (label = 1) >= 2 AND count(*) FILTER (label = 1) > count(*) FILTER (label = 0)))
 SELECT (SELECT count(DISTINCT coalesce(moment_id, clip_id)) FROM feedback WHERE action IN ('accept','reject') OR user_rating IS NOT NULL) AS feedback_count,
  count(*) AS training_rows, count(*) FILTER (label = 1) AS positive_count, count(DISTINCT project_id) AS project_count,
  {r('avg(kept)')} AS average_retention_percent, array_to_string((SELECT pt FROM k), ',') AS preferred_types FROM labelled""")
def ranker_summary(spark, sf):
    from reelspan.plans.training import ranker_summary as summary

    d = summary(ad.feedback(spark, sf), _labelled(spark, sf))
    return d.select("feedback_count", "training_rows", "positive_count", "project_count", "average_retention_percent",
                    F.array_join("preferred_types", ",").alias("preferred_types"))
