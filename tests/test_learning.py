"""Training rows, validation, registry, ranking, stores, streams, plan shapes."""

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from reelspan.lexicon import MODEL_REASON, ONLINE_REASON
from reelspan.operators import features as ft, learning as ln
from reelspan.params import ClipParams, LearningParams
from reelspan.plans import training as tr
from reelspan.sources import files as fl, sinks

SF = "/root/testdata/sf0.001"


def rows(spark, project="project_%d"):
    data = [(project % p if "%d" in project else project, f"m{p}{y}", f"c{p}{y}", y, 10.0 + p * 1000, y * 5.0, None) for p in range(6) for y in (0, 1)]
    d = spark.createDataFrame(data, "project_id string, moment_id string, clip_id string, label int, wc double, sw double, retention_percent double")
    f = F.struct(F.lit("insight").alias("moment_type"), *[
        {"word_count": F.col("wc"), "speaker_switches": F.col("sw")}.get(n, F.lit(0.0)).alias(n) for n in ft.NUMERIC])
    return d.withColumns({"features": f, "avg_watch_time_sec": F.lit(1.0), "views": F.lit(1)}).drop("wc", "sw")


def test_evaluation_beats_the_prior_on_held_out_projects(spark):
    d = rows(spark)
    r = ln.evaluate(d, LearningParams(min_metrics=8))
    assert r["passed"] and r["folds"] == 5 and r["roc_auc"] == 1.0 and r["validation_rows"] == 12
    folds, k = ln.fold_map(d)
    assert folds.count() == 6 and folds.select("fold").distinct().count() == k


def test_confounded_or_unknown_projects_are_not_validated(spark):
    d = rows(spark).withColumn("project_id", F.concat(F.lit("class_"), "label"))
    assert ln.evaluate(d)["status"] == "insufficient_projects"
    d = rows(spark).withColumn("project_id", F.when(F.col("moment_id") != "m00", F.col("project_id")))
    assert not ln.evaluate(d)["passed"]


def test_train_skip_and_deactivate(spark, tmp_path):
    base = str(tmp_path / "registry")
    d = rows(spark)
    first = tr.train(spark, base, lambda: d)
    assert first["trained"] and first["active"] and tr.active_model(spark, base) is not None
    again = tr.train(spark, base, lambda: d)
    assert not again["trained"] and again["outcome"] == "unchanged"
    few = tr.train(spark, base, lambda: d.where("label = 1"))
    assert not few["trained"] and tr.active_model(spark, base) is None
    assert spark.read.parquet(f"{base}/model_examples").count() == 12


def test_fingerprint_ignores_order_but_not_values(spark):
    d = rows(spark)
    a = ln.training_fingerprint(d).first()[0]
    assert a == ln.training_fingerprint(d.orderBy(F.desc("moment_id")).repartition(3)).first()[0]
    changed = d.withColumn("label", F.when(F.col("moment_id") == "m00", 1).otherwise(F.col("label")))
    assert a != ln.training_fingerprint(changed).first()[0]


def test_missing_retention_differs_from_zero(spark):
    d = rows(spark).withColumn("retention_percent", F.when(F.col("moment_id") == "m01", 0.0).when(F.col("label") == 1, 80.0))
    w = {r.moment_id: r.weight for r in ln.with_sample_weights(d, 2).collect()}
    assert w["m00"] == 1.0 and w["m01"] == 0.75 and abs(w["m11"] - 1.35) < 1e-9
    assert ln.retention_summary(d).first().samples_with_retention == 6


def moments(spark):
    return spark.createDataFrame([("a", "insight", 60.0, 5.0), ("b", "insight", 60.0, 0.0)], "id string, moment_type string, base_score double, speaker_switches double").withColumns({
        "text": F.lit("one two three four five six seven eight nine ten"), "summary": F.lit(""), "hook_text": F.lit(""), "duration": F.lit(20.0), "reason": F.lit("Base."),
        "personal_score": F.lit(0.0), "final_score": F.lit(0.0)})


def test_personal_ranking_is_idempotent(spark):
    d = rows(spark)
    once = ln.personal_ranking(moments(spark), d, None)
    twice = ln.personal_ranking(once, d, None)
    a, b = [{r.id: (r.final_score, r.reason) for r in x.collect()} for x in (once, twice)]
    assert a == b and a["a"][0] > a["b"][0] and a["a"][1].count(ONLINE_REASON) == 1
    model = ln.fit_model(ln.with_sample_weights(d))
    m = {r.id: r for r in ln.personal_ranking(twice, d, model).collect()}
    assert m["a"].reason.count(MODEL_REASON) == 1 and ONLINE_REASON not in m["a"].reason and m["a"].final_score > m["b"].final_score
    off = ln.personal_ranking(twice, d, model, LearningParams(enabled=False)).first()
    assert off.final_score == 60.0 and off.reason == "Base."


def test_damaged_snapshots(spark):
    bad = ["broken JSON", "[]", '{"moment_type":null}', '{"moment_type":"insight","duration":"broken"}', '{"moment_type":"insight","base_score":NaN}',
           '{"moment_type":"insight","word_count":Infinity}', '{"moment_type":"insight","base_score":101}']
    good = '{"moment_type":"snapshot_type","base_score":22,"speaker_count":2,"speaker_switches":4,"dialogue_score":75}'
    d = spark.createDataFrame([(x,) for x in [*bad, good]], "j string").select(ft.parse_snapshot(F.col("j")).alias("f"))
    assert [r.f is not None for r in d.collect()] == [False] * 7 + [True]


def test_transcript_files_are_read_and_repaired(spark, tmp_path):
    broken = "Привет".encode("utf-8").decode("latin1")
    doc = '{"project_id":"p","duration":3.0,"text":"x","segments":[{"id":1,"start":0.0,"end":1.0,"text":"%s","words":[{"word":"%s","start":0.0,"end":1.0}]}]}' % (broken, broken)
    (tmp_path / "a.json").write_text(doc, encoding="utf-8")
    t = fl.read_transcripts(spark, str(tmp_path))
    r = t.first()
    assert r.text_changed and r.text == "Привет"
    seg = fl.transcript_segments(t)
    assert fl.transcript_words(seg).first().word == "Привет"


def test_scene_log(spark):
    lines = spark.createDataFrame([("p", f"n:{i} pts_time:{t} x") for i, t in enumerate(("0.36", "6.64", "6.72", "12.80", "14.90"))], "project_id string, line string")
    d = spark.createDataFrame([("p", 15.13)], "project_id string, duration double")
    assert sorted(r.ts for r in fl.parse_scene_log(lines, d).collect()) == [0.36, 6.64, 12.8]


def test_one_bad_suggestion_rejects_its_response(spark):
    data = [(1, '[{"start": 5, "end": 9, "hook_text": "h"}, {"start": 7}]'), (2, '[{"start": 5, "end": 9}, {"start": 7, "end": 6}]'), (3, "no json"), (4, '{"start": 1}'), (5, "[]")]
    d = spark.createDataFrame([("p", i, r) for i, r in data], "project_id string, window_id int, response string")
    assert sorted((r.start, r.end, r.moment_type) for r in fl.parse_suggestions(d).collect()) == [(5.0, 9.0, "insight"), (7.0, 35.0, "insight")]


def test_replace_projects_rewrites_only_touched_buckets(spark, tmp_path):
    path = str(tmp_path / "moments")
    old = sinks.with_bucket(spark.createDataFrame([("p1", "a", "x"), ("p1", "b", "x"), ("p2", "c", "x")], "project_id string, id string, text string"), 4)
    old.write.partitionBy("bucket").parquet(path)
    new = spark.createDataFrame([("p1", "n", "y")], "project_id string, id string, text string")
    fb = spark.createDataFrame([("p1", "b")], "project_id string, moment_id string")
    for i in range(2):  # a repeated run changes nothing
        sinks.replace_projects(spark, path, str(tmp_path / f"staging{i}"), new, fb, 4)
        assert sorted((r.project_id, r.id) for r in spark.read.parquet(path).collect()) == [("p1", "b"), ("p1", "n"), ("p2", "c")]


@pytest.mark.parametrize("name", ["latest_decisions", "list_clips", "candidate_windows", "interval_text", "promo_overlap", "clip_boundaries", "neighbour_pairs", "inherited_speakers",
                                  "type_preferences", "ranker_summary", "personal_ranking", "project_activity", "selection_summary"])
def test_plans_have_no_nested_loops_and_no_python(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan


def test_top_k_trims_before_the_shuffle(spark):
    plan = entry.queries()["latest_decisions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_flagship_entry(spark):
    assert entry.entry(spark).count() > 0
