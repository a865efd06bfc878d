"""Work that is done once: text facts of a scoring pass, terms of neighbours, words of cues, columns of folds."""

from pyspark.sql import functions as F

from reelspan.operators import calibrate as cal, captions as cp, learning as ln, select as sl


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def moments(spark):
    rows = [("p", f"m{i}", 10.0 * i, 10.0 * i + 15, f"Теперь  результат {i}.\nSome words of moment {i} here. ", "insight", 60.0) for i in range(4)]
    return spark.createDataFrame(rows, "project_id string, id string, start double, end double, text string, moment_type string, final_score double")


def test_a_scoring_pass_takes_tokens_once(spark):
    d = cal.calibrate(moments(spark).withColumns({"hook_text": F.lit(""), "payoff_text": F.lit("")}))
    assert plan(d).count("regexp_extract_all(") == 1
    got = d.orderBy("id").first()
    assert got.text == "Теперь результат 0. Some words of moment 0 here." and got.hook_text == "Теперь результат 0."
    assert not [c for c in d.columns if c.startswith("_")]


def test_neighbours_keep_terms_once(spark):
    d = sl.neighbours(moments(spark))
    assert "regexp_extract_all(" not in plan(d)
    assert [r.neighbours for r in d.orderBy("id").collect()] == [3, 3, 3, 3]


def test_cues_look_words_up(spark):
    words = [(f"word{i},", i * 0.4, i * 0.4 + 0.35, 0.9, None) for i in range(40)]
    segments = spark.createDataFrame(
        [("p", 0, 0.0, 16.0, " ".join(w[0] for w in words), "a", words)],
        "project_id string, pos long, start double, end double, text string, speaker string, words array<struct<word:string,start:double,end:double,probability:double,speaker:string>>")
    clips = spark.createDataFrame([("p", 1, 0.0, 16.0)], "project_id string, id long, start double, end double")
    d = cp.caption_cues(clips, segments)
    assert "slice(_w#" not in plan(d)
    cues = d.orderBy("idx").collect()
    assert " ".join(c.text for c in cues) == " ".join(w[0] for w in words)
    assert all(len(c.text) <= 56 and len(c.words) <= 8 for c in cues)


def test_folds_leave_texts_behind(spark, monkeypatch):
    """A column the model does not ask for is neither joined nor kept: this one cannot even be read."""
    rows = spark.createDataFrame(
        [(f"p{i % 4}", i % 2, ("insight",), 50.0) for i in range(16)],
        "project_id string, label int, features struct<moment_type:string>, retention_percent double").withColumn("text", F.raise_error(F.lit("read")).cast("string"))
    folds = spark.createDataFrame([(f"p{i}", i % 2) for i in range(4)], "project_id string, fold int")
    monkeypatch.setattr(ln, "fit_model", lambda d: None)
    monkeypatch.setattr(ln, "predict", lambda model, d: d.withColumn("model_probability", F.lit(0.5)))
    got = ln.out_of_fold_model(rows, folds, 2)
    assert got.columns == ["project_id", "label", "fold", "baseline", "model_probability"] and got.count() == 16
