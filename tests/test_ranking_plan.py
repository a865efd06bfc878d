"""The features a personal ranking reads are pinned before its join (F2): Catalyst's constraints over them filled the driver."""

from pyspark.sql import functions as F

from reelspan.operators import features as ft, learning as ln


def test_features_are_pinned_below_the_join(spark):
    m = spark.createDataFrame([("a", "insight", 60.0, 5.0), ("b", "", 50.0, 0.0), (None, "how_to", 40.0, None)],
                              "id string, moment_type string, base_score double, speaker_switches double").withColumns({
        "text": F.lit("one two three four five six seven eight nine ten"), "reason": F.lit("Base."), **{c: F.lit(0.0) for c in ("personal_score", "final_score")}})
    d = spark.createDataFrame([(y, 1000.0 * y) for y in (0, 1, 0, 1)], "label int, wc double")
    d = d.withColumn("features", F.struct(F.lit("insight").alias("moment_type"), *[(F.col("wc") if n == "word_count" else F.lit(0.0)).alias(n) for n in ft.NUMERIC]))
    out = ln.personal_ranking(m, d, None)

    def joins(p):
        if p.nodeName() == "Join":
            yield p
        for i in range(p.children().size()):
            yield from joins(p.children().apply(i))

    (join,) = joins(out._jdf.queryExecution().optimizedPlan())
    assert "Generate explode" in join.left().toString()
    # ten words lie below the centre of 500: 0.15 x support 2 / 6 less
    got = {r.id: (r.personal_score, r.final_score) for r in out.collect()}
    assert got == {"a": (59.95, 59.98), "b": (49.95, 49.98), None: (39.95, 39.98)}
