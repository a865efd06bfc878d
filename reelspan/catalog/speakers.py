"""Speaker queries over the embedding table and the conversation timeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from reelspan.catalog import sql as S
from reelspan.catalog.moments import SHIFTED, _shifted
from reelspan.catalog.sql import r
from reelspan.functions.text import round_to
from reelspan.operators import speakers as sp
from reelspan.sources import adapters as ad

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


EMB = """e0 AS (SELECT vec_id // 50 AS project_id, vec_id % 50 AS pos, CAST(embedding AS DOUBLE[]) AS v, 0.4::DOUBLE + (vec_id % 5) * 0.4::DOUBLE AS duration,
  CAST(1 + vec_id % 4 AS INT) AS n_words, 'S' || (1 + label % 3) AS truth FROM embeddings),
items AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e0),
dims AS (SELECT project_id, truth, i, avg(x) AS x FROM (SELECT project_id, truth, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM items) GROUP BY ALL),
c0 AS (SELECT project_id, truth AS speaker, list(x ORDER BY i) AS m FROM dims GROUP BY ALL),
cents AS (SELECT project_id, speaker, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS centroid FROM c0)"""


def _labelled(spark, sf):
    items = ad.embeddings(spark, sf)
    return items, items.select("project_id", "pos", F.col("truth").alias("speaker"))


@query(f"WITH {EMB} SELECT project_id, speaker, unnest(list_transform(centroid, lambda x: {r('x', 5)})) AS x, generate_subscripts(centroid, 1) - 1 AS i FROM cents")
def speaker_centroids(spark, sf):
    items, labels = _labelled(spark, sf)
    d = sp.centroids(items, labels).select("project_id", "speaker", F.posexplode("centroid").alias("i", "x"))
    return d.select("project_id", "speaker", "i", round_to(F.col("x"), 5).alias("x"))


@query(f"""WITH {EMB}, d AS (SELECT i.project_id, i.truth AS speaker, 1 - list_dot_product(u, centroid) AS d FROM items i JOIN cents c ON c.project_id = i.project_id AND c.speaker = i.truth)
 SELECT project_id, speaker, {r('least(0.82, greatest(0.319, quantile_cont(d, 0.95) + 0.08))', 4)} AS "limit" FROM d GROUP BY ALL""")
def assignment_limits(spark, sf):
    items, labels = _labelled(spark, sf)
    d = sp.assignment_limits(items, labels, sp.centroids(items, labels))
    return d.select("project_id", "speaker", round_to(F.col("limit"), 4).alias("limit"))


@query(f"""WITH {EMB}, r AS (SELECT i.project_id, i.pos, list(1 - list_dot_product(u, centroid) ORDER BY 1 - list_dot_product(u, centroid), speaker) AS d,
   list(speaker ORDER BY 1 - list_dot_product(u, centroid), speaker) AS s FROM items i JOIN cents c ON c.project_id = i.project_id GROUP BY ALL)
 SELECT project_id, pos, s[1] AS nearest, {r('d[1]', 4)} AS distance, {r('coalesce(d[2] - d[1], 1)', 4)} AS margin FROM r""")
def nearest_speaker(spark, sf):
    items, labels = _labelled(spark, sf)
    d = sp.nearest_speaker(items, sp.centroids(items, labels))
    return d.select("project_id", "pos", "nearest", round_to(F.col("distance"), 4).alias("distance"), round_to(F.col("margin"), 4).alias("margin"))


@query(f"""WITH {EMB}, n AS (SELECT project_id, count(*) FILTER (duration >= 1.0 AND n_words >= 2) AS a FROM items GROUP BY 1)
 SELECT project_id, pos FROM items JOIN n USING (project_id) WHERE (duration >= 1.0 AND n_words >= 2) OR a < 2""")
def anchor_items(spark, sf):
    return sp.anchors(ad.embeddings(spark, sf)).select("project_id", "pos")


@query(f"""WITH {EMB}, f AS (SELECT project_id, truth, min(pos) AS f FROM items GROUP BY ALL), n AS (SELECT *, 'S' || row_number() OVER (PARTITION BY project_id ORDER BY f) AS speaker FROM f)
 SELECT i.project_id, pos, speaker FROM items i JOIN n ON n.project_id = i.project_id AND n.truth = i.truth""")
def first_seen_labels(spark, sf):
    d = ad.embeddings(spark, sf).select("project_id", "pos", F.col("truth").alias("cluster"))
    return sp.label_by_first_seen(d)


@query()
def voice_clusters(spark, sf):
    """Anchors clustered and named per recording; short turns by nearest voice."""
    items = ad.embeddings(spark, sf)
    base = sp.anchors(items)
    labels = sp.label_by_first_seen(sp.cluster_recordings(base))
    cents = sp.centroids(base, labels)
    return sp.assign_short_turns(items, labels, cents, sp.assignment_limits(base, labels, cents))


_GAPS = S.SENTENCES + """,
g0 AS (SELECT project_id, pos, "start", "end", CASE WHEN (project_id * 31 + pos * 17) % 4 < 2 THEN 'S' || ((project_id + pos // 9) % 2) END AS label, (pos % 5) <> 3 AS fillable FROM sentences),
g1 AS (SELECT *, max(CASE WHEN label IS NOT NULL THEN pos END) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pp,
  min(CASE WHEN label IS NOT NULL THEN pos END) OVER (PARTITION BY project_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS np FROM g0),
g2 AS (SELECT g1.*, p.label AS pl, p."end" AS pe, n.label AS nl, n."start" AS ns FROM g1 LEFT JOIN g0 p ON p.project_id = g1.project_id AND p.pos = pp LEFT JOIN g0 n ON n.project_id = g1.project_id AND n.pos = np),
g3 AS (SELECT *, coalesce(label IS NULL AND fillable AND pl = nl AND greatest(0, "start" - pe) <= 0.75::DOUBLE AND greatest(0, ns - "end") <= 0.75::DOUBLE, false) AS near FROM g2)"""


@query(f"""WITH {_GAPS} SELECT project_id, pos, CASE WHEN label IS NULL AND fillable AND bool_or(near) OVER (PARTITION BY project_id, pp ORDER BY pos) THEN pl ELSE label END AS speaker FROM g3""")
def filled_gaps(spark, sf):
    from reelspan.catalog.moments import sentences

    hit = (F.col("project_id") * 31 + F.col("pos") * 17) % 4 < 2
    label = F.when(hit, F.concat(F.lit("S"), (F.col("project_id") + F.floor(F.col("pos") / 9)) % 2))
    d = sentences(spark, sf).select("project_id", "pos", "start", "end", label.alias("speaker"), (F.col("pos") % 5 != 3).alias("fillable"))
    return sp.fill_gaps(d).select("project_id", "pos", "speaker")


@query(f"""WITH {SHIFTED}, o AS (SELECT iv.project_id, iv.id, g.speaker, round(sum(least(e, g."end") - greatest(s, g."start")), 6) AS sec, min(g.pos) AS f FROM iv
   JOIN segments g ON g.project_id = iv.project_id AND g."end" > s AND g."start" < e GROUP BY ALL),
 b AS (SELECT project_id, id, arg_max(speaker, (sec, -f)) AS sp FROM o GROUP BY ALL),
 n AS (SELECT iv.project_id, iv.id, arg_min(g.speaker, (least(abs((s + e) / 2 - g."start"), abs((s + e) / 2 - g."end")), g.pos)) AS sp FROM iv
   JOIN segments g ON g.project_id = iv.project_id AND least(abs((s + e) / 2 - g."start"), abs((s + e) / 2 - g."end")) <= 0.35::DOUBLE GROUP BY ALL)
 SELECT iv.project_id, iv.id, coalesce(b.sp, n.sp) AS speaker FROM iv LEFT JOIN b USING (project_id, id) LEFT JOIN n ON n.project_id = iv.project_id AND n.id = iv.id""")
def inherited_speakers(spark, sf):
    items = _shifted(spark, sf).select("project_id", "id", "start", "end")
    return sp.inherit_speakers(items, ad.segments(spark, sf)).select("project_id", "id", "speaker")


_SPARSE = S.SEGMENTS + """, sp AS (SELECT *, CASE WHEN (project_id + pos) % 3 <> 0 THEN speaker END AS lab FROM segments)"""


def _sparse(spark, sf):
    keep = (F.col("project_id") + F.col("pos")) % 3 != 0
    return ad.segments(spark, sf, words=True).withColumn("speaker", F.when(keep, F.col("speaker")))


@query(f"WITH {_SPARSE} SELECT project_id, lab AS speaker, count(*) AS n FROM sp WHERE lab <> '' GROUP BY ALL")
def speaker_counts(spark, sf):
    return sp.speaker_counts(_sparse(spark, sf))


@query(f"""WITH {_SPARSE}, c AS (SELECT project_id, {r('avg(CAST(lab IS NOT NULL AS INT))', 4)} AS speaker_coverage, bool_or(lab IS NOT NULL) AS ready FROM sp GROUP BY 1),
 t AS (SELECT project_id, string_agg(lab || ':' || n, ', ' ORDER BY lab) AS s FROM (SELECT project_id, lab, count(*) AS n FROM sp WHERE lab IS NOT NULL GROUP BY ALL) GROUP BY 1)
 SELECT c.project_id, speaker_coverage, ready, coalesce('speakers=' || s, 'speakers=none') AS summary FROM c LEFT JOIN t USING (project_id)""")
def speaker_report(spark, sf):
    segs = _sparse(spark, sf)
    cov = sp.speaker_coverage(segs)
    text = sp.speaker_summary(sp.speaker_counts(segs), cov).withColumn("summary", F.regexp_replace("summary", "; coverage=.*$", ""))
    return cov.join(text, "project_id").select("project_id", "speaker_coverage", sp.labels_ready(cov).alias("ready"), "summary")


@query(f"""WITH {_SPARSE} SELECT project_id, pos, {S.n_words('text')} AS n, CASE WHEN {S.n_words('text')} > 0 THEN lab END AS speaker FROM sp""")
def spread_labels(spark, sf):
    d = sp.spread_labels(_sparse(spark, sf))
    return d.select("project_id", "pos", F.size("words").alias("n"), F.get("words", F.lit(0))["speaker"].alias("speaker"))
