"""Preference model: training-set reports, online profile, grouped validation, scoring."""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from reelspan.functions import scoring as sc, text as tx
from reelspan.lexicon import DEFAULT, MODEL_REASON, MODEL_SPEC, ONLINE_REASON, Lexicon
from reelspan.operators import events as ev
from reelspan.operators.features import NUMERIC, with_features
from reelspan.operators.quantiles import exact_quantiles
from reelspan.operators.scan import running
from reelspan.params import LearningParams
from reelspan.session import cut_lineage


def retention_summary(rows: DataFrame) -> DataFrame:
    """Counts and means over observed values, and the exact median of the retention values."""
    r = F.col("retention_percent")
    d = rows.select(*[ev.metric_value(n).alias(n) for n in ev.METRIC_NAMES])
    middle = exact_quantiles(d, [], "retention_percent", {"m": 0.5}).agg(F.max("m")).scalar()

    def mean(n: str) -> Column:
        return F.coalesce(tx.round2(F.avg(n)), F.lit(0.0))

    return d.agg(
        F.count(r).alias("samples_with_retention"), mean("retention_percent").alias("average_retention_percent"),
        mean("avg_watch_time_sec").alias("average_watch_time_sec"), mean("views").alias("average_views"),
    ).select("samples_with_retention", "average_retention_percent", F.coalesce(tx.round2(middle), F.lit(0.0)).alias("median_retention_percent"),
             "average_watch_time_sec", "average_views")


def training_readiness(rows: DataFrame, min_feedback: int = 12) -> DataFrame:
    per_class = max(2, math.ceil(min_feedback / 4))
    d = rows.agg(
        F.count("*").alias("training_rows"), F.count_if(F.col("label") == 1).alias("positive_count"),
        F.count_if(F.col("label") == 0).alias("negative_count"), F.countDistinct("project_id").alias("project_count"),
    )
    low, high = F.least("positive_count", "negative_count"), F.greatest("positive_count", "negative_count")
    return d.withColumns({
        "minimum_per_class": F.lit(per_class), "balanced": (low >= per_class) & (high <= low * 3),
    }).withColumn("training_ready", (F.col("training_rows") >= min_feedback) & F.col("balanced"))


def with_sample_weights(rows: DataFrame, min_metrics: int = 8) -> DataFrame:
    """Weight by agreement of label and retention, once enough retention values exist."""
    d = rows.withColumn("_r", ev.metric_value("retention_percent"))
    enough = d.agg((F.count("_r") >= min_metrics).alias("e")).scalar()
    share = F.col("_r") / 100
    agreement = F.when(F.col("label") == 1, share).otherwise(1 - share)
    return d.withColumn(
        "weight", F.when(enough & F.col("_r").isNotNull(), 0.75 + agreement * 0.75).otherwise(1.0)
    ).drop("_r")


def training_fingerprint(rows: DataFrame, p: LearningParams = LearningParams()) -> DataFrame:
    """Order-independent digest of rows and settings.

    Every row gets a SHA-256; its four 60-bit pieces are summed separately over
    all rows. Sums combine map-side, so no task ever sees the sorted rows.
    """
    payload = F.to_json(
        F.struct(
            F.col("project_id"), ev.candidate_key().alias("candidate_id"), F.col("label"), F.col("features"),
            ev.metric_value("retention_percent").alias("retention_percent"),
        ),
        {"ignoreNullFields": "false"},
    )
    return digest(rows.select(payload.alias("payload")), "payload", settings_text(p))


def settings_text(p: LearningParams) -> str:
    return f"{MODEL_SPEC}|{p.min_feedback}|{p.min_metrics}|{p.save_training_rows}"


def digest(df: DataFrame, payload: str, settings: str) -> DataFrame:
    h = F.sha2(F.col(payload), 256)
    pieces = [
        F.sum(F.conv(F.substring(h, 15 * i + 1, 15), 16, 10).cast("decimal(20,0)")).alias(f"h{i}") for i in range(4)
    ]
    d = df.agg(F.count("*").alias("n"), *pieces)
    parts = [F.col("n").cast("string")] + [F.coalesce(F.col(f"h{i}").cast("string"), F.lit("0")) for i in range(4)]
    return d.select(F.sha2(F.concat_ws("|", F.lit(settings), *parts), 256).alias("fingerprint"))


def preferred_types(rows: DataFrame) -> DataFrame:
    g = rows.groupBy(F.col("features.moment_type").alias("moment_type")).agg(
        F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives")
    )
    return g.where((F.col("positives") >= 2) & (F.col("positives") > F.col("negatives")))


def type_preferences(rows: DataFrame) -> DataFrame:
    """(moment_type, adjustment): 6 x difference of class shares x support / (support + 4)."""
    pos, neg = F.col("label") == 1, F.col("label") == 0
    totals = rows.agg(F.struct(F.count_if(pos).alias("p"), F.count_if(neg).alias("n"))).scalar()
    d = rows.groupBy(F.col("features.moment_type").alias("moment_type")).agg(
        F.count_if(pos).alias("tp"), F.count_if(neg).alias("tn"), totals.alias("t")
    ).select("*", "t.*")
    support = F.col("tp") + F.col("tn")
    diff = F.col("tp") / F.greatest("p", F.lit(1)) - F.col("tn") / F.greatest("n", F.lit(1))
    return d.select("moment_type", (diff * 6 * support / (support + 4)).alias("adjustment"))


def numeric_preferences(rows: DataFrame) -> DataFrame:
    """(name, centre, strength) of the features that vary; one aggregation, no unpivot of the rows."""
    pos, neg = F.col("label") == 1, F.col("label") == 0
    aggs = [F.count_if(pos).alias("p"), F.count_if(neg).alias("n")]
    for f in NUMERIC:
        x = F.col(f"features.{f}")
        aggs += [F.struct(
            F.avg(F.when(pos, x)).alias("mp"), F.avg(F.when(neg, x)).alias("mn"),
            F.stddev_pop(F.when(pos | neg, x)).alias("sd"),
        ).alias(f)]
    one = rows.agg(*aggs)
    entries = F.array(*[F.struct(F.lit(f).alias("name"), F.col(f).alias("s")) for f in NUMERIC])
    d = one.select("p", "n", F.explode(entries).alias("e")).where((F.col("p") > 0) & (F.col("n") > 0) & (F.col("e.s.sd") > 1e-12))
    support = F.least("p", "n")
    diff = tx.clamp((F.col("e.s.mp") - F.col("e.s.mn")) / F.col("e.s.sd"), -1.0, 1.0)
    return d.select(
        "e.name", ((F.col("e.s.mp") + F.col("e.s.mn")) / 2).alias("centre"),
        (diff * (support / (support + 4)) * 0.15).alias("strength"),
    )


def with_online_adjustment(moments: DataFrame, types: DataFrame, numeric: list) -> DataFrame:
    """``adjustment`` in [-12, 12] from ``features``. ``numeric``: the <= 25 profile rows."""
    parts = F.lit(0.0)
    for name, centre, strength in numeric:
        x = F.col(f"features.{name}")
        # the last bits of a mean depend on the order of its sum
        parts = parts + F.when(x > centre + 1e-9, F.lit(strength)).when(x < centre - 1e-9, F.lit(-strength)).otherwise(0.0)
    d = moments.withColumn("_kind", F.col("features.moment_type")).join(
        types.select(F.col("moment_type").alias("_kind"), F.col("adjustment").alias("_type_adj")), "_kind", "left"
    )
    total = F.coalesce("_type_adj", F.lit(0.0)) + parts
    return d.withColumn("adjustment", tx.clamp(total, -12.0, 12.0)).drop("_kind", "_type_adj")


# -- model --------------------------------------------------------------------


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_type": F.col("features.moment_type"), **{f"_{n}": F.col(f"features.{n}") for n in NUMERIC}})


def fit_model(rows: DataFrame) -> PipelineModel:
    """One-hot type + 25 numbers, scaled without centring, L2 logistic regression.

    The regularisation equals an unscaled penalty with C = 1 on the weighted
    loss: 1 / sum of weights, times (n-1)/n because Spark scales by the sample
    deviation where the published model uses the population deviation.
    """
    d = _flat(rows)
    n, total = d.agg(F.count("*"), F.sum("weight")).first()
    reg = (n - 1) / (n * total) if n > 1 else 1.0
    stages = [
        StringIndexer(inputCol="_type", outputCol="_type_i", handleInvalid="keep"),
        OneHotEncoder(inputCol="_type_i", outputCol="_type_v", dropLast=True),
        VectorAssembler(inputCols=["_type_v", *[f"_{f}" for f in NUMERIC]], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=False, withStd=True),
        LogisticRegression(
            featuresCol="_x", labelCol="label", weightCol="weight", regParam=reg, elasticNetParam=0.0,
            standardization=False, maxIter=1000, probabilityCol="probability",
        ),
    ]
    return Pipeline(stages=stages).fit(d)


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Add ``model_probability``; null where the model's output is not a distribution."""
    keep = [c for c in rows.columns]
    p = vector_to_array("probability")
    d = model.transform(_flat(rows)).withColumn("_p", p)
    fine = (
        (F.size("_p") == 2) & F.forall("_p", lambda x: ~F.isnan(x) & (x >= 0) & (x <= 1))
        & (F.abs(F.aggregate("_p", F.lit(0.0), lambda a, x: a + x) - 1) < 1e-5)
    )
    return d.select(*keep, F.when(fine, F.get("_p", F.lit(1))).alias("model_probability"))


def fold_map(rows: DataFrame, most: int = 5) -> tuple[DataFrame, int] | None:
    """(project_id, fold) with projects undivided and both classes in every training part; None if there is no such split
    or a row has no project.

    Projects are dealt out in turn: those with both classes first, after them, from the same next fold on, those with
    positives only and those with negatives only; of each kind the larger ones (by powers of two of their rows) first,
    equals by a hash of their name. With k folds, and at least k projects that have a class, the projects of a class hold
    successive turns: each fold gets one, and no fold all. Of each kind and size the folds' shares differ by one project.
    Turns are counted in two levels, per block of hashes and over the blocks, whose number is bounded.
    """
    groups = rows.groupBy("project_id").agg(
        F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n")
    )
    nulls, with_p, with_n, both = groups.agg(
        F.count_if(F.col("project_id").isNull()), F.count_if(F.col("p") > 0), F.count_if(F.col("n") > 0),
        F.count_if((F.col("p") > 0) & (F.col("n") > 0)),
    ).first()
    k = min(most, with_p, with_n)
    if nulls or k < 2:
        return None
    kind = F.when((F.col("p") > 0) & (F.col("n") > 0), 0).when(F.col("p") > 0, 1).otherwise(2)
    name = F.md5(F.col("project_id").cast("string").cast("binary"))
    d = groups.select("project_id", kind.alias("kind"), (-F.length(F.bin(F.col("p") + F.col("n")))).alias("size"), name.alias("name"))
    block = ((F.col("size") + 64) * 256 + F.conv(F.left("name", F.lit(2)), 16, 10).cast("int"))
    d = running(d, ["kind"], ["size", "name", "project_id"], block, {"turn": ("sum", F.lit(1))})
    turn = F.col("turn") + F.when(F.col("kind") == 0, 0).otherwise(both)
    return d.select("project_id", (turn % k).cast("int").alias("fold")), k


def fold_membership(folds: DataFrame, k: int) -> DataFrame:
    """(fold, project_id, part): every project once per fold, in its training or its validation part."""
    d = folds.select("project_id", F.col("fold").alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("fold"))
    return d.select("fold", "project_id", F.when(F.col("fold") == F.col("_own"), "validation").otherwise("training").alias("part"))


def fold_report(rows: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """Per fold the rows and projects of its training and validation part; a fold's rows are counted once."""
    own = rows.join(folds, "project_id").groupBy("fold").agg(
        F.count("*").alias("validation_rows"), F.countDistinct("project_id").alias("validation_projects"))
    rows_, projects = own.agg(F.sum("validation_rows")).scalar(), own.agg(F.sum("validation_projects")).scalar()
    return own.select("fold", (rows_ - F.col("validation_rows")).alias("training_rows"), "validation_rows",
                      (projects - F.col("validation_projects")).alias("training_projects"), "validation_projects")


def out_of_fold_rates(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """``rows`` with fold, baseline (share of positives) and model_probability (that share per moment type, drawn to the
    baseline by four rows), all from the other folds: one count per fold and type, less a fold's own."""
    d = rows.join(folds, "project_id").withColumn("_type", F.col("features.moment_type"))
    own = d.groupBy("fold", "_type").agg(F.count_if(F.col("label") == 1).alias("p"), F.count("*").alias("n"))

    def others(keys: list[str]) -> DataFrame:
        """Counts of the other folds per fold and ``keys``."""
        every = own.groupBy(*keys).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
        mine = own.groupBy("fold", *keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        return mine.join(every, keys) if keys else mine.join(F.broadcast(every), how="cross")  # one row

    base = others([]).select("fold", ((F.col("_p") - F.col("p")) / (F.col("_n") - F.col("n"))).alias("baseline"))
    kinds = others(["_type"]).join(base, "fold")
    rate = (F.col("_p") - F.col("p") + 4 * F.col("baseline")) / (F.col("_n") - F.col("n") + 4)
    kinds = kinds.select("fold", "_type", "baseline", rate.alias("model_probability"))
    return d.join(kinds, ["fold", "_type"]).drop("_type")


def out_of_fold_model(rows: DataFrame, folds: DataFrame, k: int, p: LearningParams = LearningParams()) -> DataFrame:
    """project_id, label, fold, baseline and model_probability of every row, by the model of the other folds."""
    # only what the model asks for goes through the join and is kept: a project's rows may meet in one task
    d = rows.select("project_id", "label", "features", "retention_percent").join(folds, "project_id").cache()
    try:
        scored = None
        for fold in range(k):
            train, test = d.where(F.col("fold") != fold), d.where(F.col("fold") == fold)
            train = with_sample_weights(train, p.min_metrics)
            prior = train.agg(F.avg("label")).first()[0]
            part = predict(fit_model(train), test).withColumn("baseline", F.lit(float(prior)))
            part = part.select("project_id", "label", "fold", "baseline", "model_probability")
            scored = part if scored is None else scored.unionByName(part)
        return cut_lineage(scored)
    finally:
        d.unpersist()


def evaluate(rows: DataFrame, p: LearningParams = LearningParams()) -> dict:
    """Out-of-fold metrics over held-out projects, the activation rule, and each fold's counts."""
    split = fold_map(rows)
    if split is None:
        return {"status": "insufficient_projects", "passed": False, "folds": 0}
    folds, k = cut_lineage(split[0]), split[1]
    m = validation_metrics(out_of_fold_model(rows, folds, k, p)).first().asDict()
    reports = [{**r.asDict(), "fold": r.fold + 1} for r in fold_report(rows, folds, k).orderBy("fold").collect()]  # at most 5 rows
    return {**m, "method": "stratified_group_kfold", "folds": k, "fold_reports": reports}


def roc_auc(scored: DataFrame, label: str = "label", score: str = "model_probability") -> DataFrame:
    """One row, roc_auc: the share of (positive, negative) pairs the score puts in order, equal scores counting half; null
    without both classes.

    A rank sum over counts per score: negatives below each score come from running counts in two levels, within blocks
    of scores in [0, 1] and over the blocks. Rows without a score take no part.
    """
    c = scored.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    c = running(c.withColumn("_all", F.lit(0)), ["_all"], ["s"], F.floor(F.col("s") * 65_536), {"below": ("sum", F.col("n"))})
    pairs = F.sum("p").cast("double") * F.sum("n")
    return c.agg((F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)) / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def metric_columns() -> list[Column]:
    """Aggregates over (label, model_probability, baseline)."""
    y, p = F.col("label"), F.col("model_probability")
    safe = tx.clamp(p, 2.220446049250313e-16, 1 - 2.220446049250313e-16)
    hit = (p >= 0.5).cast("int") == y
    recall = (F.avg(F.when(y == 1, hit.cast("double"))) + F.avg(F.when(y == 0, hit.cast("double")))) / 2
    return [
        F.count("*").alias("validation_rows"), tx.round_to(recall, 4).alias("balanced_accuracy"),
        F.avg((p - y) * (p - y)).alias("brier_score"),
        F.avg((F.col("baseline") - y) * (F.col("baseline") - y)).alias("baseline_brier_score"),
        (-F.avg(F.when(y == 1, F.log(safe)).otherwise(F.log(1 - safe)))).alias("log_loss"),
    ]


def validation_metrics(scored: DataFrame) -> DataFrame:
    """One row of metrics over (label, model_probability, baseline), with the rule: better than the baseline, and in order."""
    auc = roc_auc(scored).scalar()
    m = scored.agg(*metric_columns()).withColumn("roc_auc", auc)
    passed = (F.col("brier_score") < F.col("baseline_brier_score") - 1e-6) & (F.col("roc_auc") > 0.5)
    m = m.withColumn("passed", F.coalesce(passed, F.lit(False))).withColumn("status", F.when(F.col("passed"), "passed").otherwise("below_baseline"))
    return m.withColumns({"roc_auc": tx.round_to(F.col("roc_auc"), 4), **{c: F.round(c, 6) for c in ("brier_score", "baseline_brier_score", "log_loss")}})


def personal_ranking(
    moments: DataFrame, training_rows: DataFrame | None, model: PipelineModel | None,
    p: LearningParams = LearningParams(), lex: Lexicon = DEFAULT,
) -> DataFrame:
    """Blend base score and learned score; idempotent in the reason text."""
    reason = F.trim(F.replace(F.replace("reason", F.lit(MODEL_REASON), F.lit("")), F.lit(ONLINE_REASON), F.lit("")))
    d = moments.withColumns({
        "reason": reason, "personal_score": F.col("base_score"), "final_score": F.col("base_score"),
    })
    if not p.enabled:
        return d
    d = tx.settle(with_features(d, lex, "features"), "features")
    blank = F.lit(None).cast("double")
    d = predict(model, d) if model is not None else d.withColumn("model_probability", blank)
    if training_rows is not None:
        numeric = [tuple(r) for r in numeric_preferences(training_rows).collect()]  # at most 25 rows
        d = with_online_adjustment(d, type_preferences(training_rows), numeric)
    else:
        d = d.withColumn("adjustment", F.lit(0.0))
    online = tx.clamp(F.col("base_score") + F.col("adjustment"), 0.0, 100.0)
    by_model = F.col("model_probability").isNotNull()
    usable = F.col("features").isNotNull()
    d = d.withColumn("_learned", F.when(usable, F.when(by_model, F.col("model_probability") * 100).otherwise(online)))
    note = F.when(usable & by_model, MODEL_REASON).when(usable & (F.col("_learned") != F.col("base_score")), ONLINE_REASON)
    return d.withColumns({
        "reason": F.trim(F.concat_ws(" ", "reason", note)),
        "personal_score": F.coalesce(tx.round2(F.col("_learned")), F.col("base_score")),
        "final_score": F.coalesce(
            sc.combine_personal_score(F.col("base_score"), F.col("_learned"), p.personal_score_weight), F.col("base_score")
        ),
    }).drop("features", "model_probability", "adjustment", "_learned")
