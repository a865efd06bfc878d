"""Texts of windows are taken apart once on the way to moments (F3, F4)."""

from pyspark.sql import functions as F

from reelspan.functions import scoring as sc, text as tx
from reelspan.operators import calibrate as cal
from reelspan.params import ClipParams


def test_windows_are_taken_apart_once(spark, monkeypatch):
    texts, plain = [], sc.with_text_facts
    monkeypatch.setattr(sc, "with_text_facts", lambda df, text="text": texts.append(text) or plain(df, text))
    s = spark.createDataFrame(
        [("p", i, 6.0 * i, 6.0 * i + 5, f"Результат  {i * 111}, слово{i} термин{i} рекорд{i} дело{i}!", "a", ["a"], 0) for i in range(12)],
        "project_id string, pos long, start double, end double, text string, speaker string, speakers array<string>, speaker_switches int")
    d = cal.find_moments(s, ClipParams(min_score=50.0))
    assert texts == ["text"]
    judged = d.orderBy("id").collect()
    assert judged and not [c for c in d.columns if c.startswith("_")]
    again = cal.calibrate(d).orderBy("id").collect()  # from the texts themselves
    for a, b in zip(judged, again):
        assert a.text == b.text and (a.hook_score, a.problems, a.hook_text, a.payoff_text) == (b.hook_score, b.problems, b.hook_text, b.payoff_text)


def test_joined_facts_equal_those_of_the_whole(spark):
    rows = [("Рост  ещё 5%.\n", " ", "Hook ΑΣ"), ("", "", ""), (None, "sum mary", None), ("a b", None, "\t"), ("x", "y", "z")]
    d = sc.with_text_facts(spark.createDataFrame(rows, "text string, summary string, hook_text string"))
    whole = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("text", "summary", "hook_text")])
    d = sc.with_text_facts(sc._joined_facts(d, "j", ("text", "summary", "hook_text")).withColumn("w", whole), "w")
    for r in d.select(*[sc.fact(x, n) for x in ("j", "w") for n in ("low", "words")]).collect():
        assert (r[0], r[1]) == (r[2], r[3])


def test_last_phrase_is_the_last_sentence(spark):
    rows = ["One. Two!  Three", "One.", "  One. ", "", None, "a . . b", "x.y z", "Да…\nНет?  Ну", "...", ". a", "a.  ", "a,\nb"]
    d = spark.createDataFrame([(x,) for x in rows], "t string")
    for r in d.select("t", tx.last_phrase(F.col("t")).alias("a"), tx.split_sentences(F.col("t")).alias("s")).collect():
        assert r.a == (r.s[-1] if r.s else ""), r
