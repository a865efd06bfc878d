"""Handmade scenarios with known outcomes, in the default (Russian) lexicon."""

import math
import random

import pytest
from pyspark.sql import functions as F

from reelspan.functions import scoring as sc, text as tx
from reelspan.lexicon import DEFAULT
from reelspan.operators import boundary as bd, calibrate as cal, captions as cp, chain as ch, cues as cu, promo as pr
from reelspan.operators import segment as sg, select as sl, speakers as sp, windows as wn
from reelspan.params import ClipParams, EditParams, SuggestionParams

SENT = "project_id string, pos long, start double, end double, text string, speaker string, speakers array<string>, speaker_switches int"
WORD = "array<struct<word:string,start:double,end:double,probability:double,speaker:string>>"
SEG = f"project_id string, pos long, start double, end double, text string, speaker string, words {WORD}"


def sentences(spark, rows):
    return spark.createDataFrame(
        [("p", i, float(s), float(e), t, sp_, [sp_] if sp_ else [], 0) for i, (s, e, t, *x) in enumerate(rows) for sp_ in [x[0] if x else None]], SENT)


def one(df):
    return df.first().asDict()


# -- text ---------------------------------------------------------------------


def test_mojibake_is_undone_and_clean_text_untouched(spark):
    clean = ["Привет, мир", "я говорю сейчас", "plain", "", "Ñandú"]
    bad = [c.encode("utf-8").decode("cp1251", errors="ignore") if c in clean[:2] else c for c in clean]
    bad[0] = "Привет".encode("utf-8").decode("latin1")
    df = spark.createDataFrame([(b,) for b in bad], "t string").select(tx.repair_mojibake(F.col("t")).alias("r"))
    assert [r.r for r in df.collect()] == ["Привет", "я говорю сейчас", "plain", "", "Ñandú"]


def penalty(spark, text):
    return one(sc.with_quality_penalty(spark.createDataFrame([(text,)], "text string")))


def test_quality_penalties(spark):
    ad = penalty(spark, "Реклама: промокод, скидка и ссылка в описании.")
    assert ad["quality_penalty"] >= 40 and "ad or CTA language" in ad["quality_problems"]
    generic = penalty(spark, "В этом фрагменте есть важная мысль, которую можно превратить в короткий клип.")
    assert generic["quality_penalty"] >= 40 and "generic clip-analysis text" in generic["quality_problems"]
    sponsor = penalty(spark, "Самый редкий легендарный дроп в новом обновлении. Получи шанс разделить призовой фонд и успей до 20 июля.")
    assert sponsor["quality_penalty"] >= 52 and "ad or CTA language" in sponsor["quality_problems"]
    game = penalty(spark, "В новом обновлении PUBG Mobile появился редкий легендарный дроп.")
    assert "ad or CTA language" not in game["quality_problems"]
    assert penalty(spark, "  ")["quality_problems"] == ["empty text"]


def test_structural_penalty(spark):
    d = spark.createDataFrame([("Как так совпало? Мы пока только готовим ответ?",)], "text string")
    r = one(sc.with_structural_penalty(d))
    assert r["arc_penalty"] >= 40 and {"filler opening", "unanswered question"} <= set(r["arc_problems"])


def test_score_formulas(spark):
    d = spark.range(1).select(*[F.lit(100.0).alias(n) for n in sc.SCORE_NAMES])
    assert d.select(sc.base_score()).first()[0] == 100
    assert spark.range(1).select(sc.combine_personal_score(F.lit(80), F.lit(100), 0.35)).first()[0] == 87


def moment_rows(spark, rows):
    """(id, start, end, text, score)"""
    d = spark.createDataFrame([("p", i, float(s), float(e), t, float(x)) for i, s, e, t, x in rows],
                              "project_id string, id string, start double, end double, text string, final_score double")
    return d.withColumns({
        "moment_type": F.lit("insight"), "hook_score": F.lit(0.0), "problems": F.array().cast("array<string>"),
        "hook_text": F.lit(""), "payoff_text": F.lit("")})


def test_calibration_separates_metric_reveal_from_filler(spark):
    d = moment_rows(spark, [
        ("strong", 0, 24, "Было 30 тысяч пользователей. Теперь их семьсот тысяч. Это новый рекорд.", 82),
        ("weak", 30, 54, "В общем, мы немного походили по офису и потом пошли дальше.", 82)])
    r = {x.id: x for x in cal.calibrate(d).collect()}
    assert r["strong"].final_score >= r["weak"].final_score + 20 and r["strong"].moment_type == "metric_reveal"


# -- promo and selection ---------------------------------------------------------


AD = [
    (144.76, 175.41, "Команда спорит и пытается найти монстра."), (179.46, 180.26, "Знаешь, что это?"),
    (180.44, 183.46, "Это новая суперэмбовая штука. Грозовой вершитель."),
    (183.62, 187.72, "Редкий дроп в новом обновлении PUBG Mobile Metro Royal."),
    (187.72, 193.88, "Он выпадает у одного из ста тысяч игроков, и шанс уменьшается."),
    (193.98, 204.28, "Сражайся с боссами, чтобы получить оружие и буст к скорости."),
    (204.38, 211.88, "Главное: получи возможность разделить призовой фонд."),
    (211.88, 215.68, "В размере миллиона рублей с другими обладателями."),
    (215.78, 221.50, "В событии участвует известный автор, и он ждать не будет."),
    (221.60, 224.46, "Скачивай PUBG Mobile и начинай охоту."),
    (224.66, 227.58, "Успей до 20 июля, потом эта штука исчезнет."),
]


def test_promo_ranges(spark):
    far = sentences(spark, [(100, 104, "Программа обучает работе с роботами."), (145, 149, "Ссылка на программу находится в описании.")])
    assert [(b.core_start, b.core_end) for b in pr.promotional_blocks(far).collect()] == [(145.0, 149.0)]
    blocks = pr.promotional_blocks(sentences(spark, AD)).collect()
    assert any(b.core_start <= 179.46 and b.core_end >= 227.58 for b in blocks)


def test_promo_tail_rejects_candidate_but_clean_clip_survives(spark):
    d = moment_rows(spark, [("infected", 144.76, 187.72, "Чистый текст кандидата", 88), ("clean", 144.76, 175.0, AD[0][2], 90)])
    audit = sl.select_candidates(d, pr.promotional_blocks(sentences(spark, AD)), ClipParams(target_count=2, min_score=60)).collect()
    by = {a.id: a for a in audit}
    assert by["clean"].decision == "selected" and by["infected"].reason == "promotional segment"


def test_selection_rejects_duplicates_and_falls_back(spark):
    none = pr.promotional_blocks(sentences(spark, [(80, 84, "Ссылка на курс в описании.")]))
    d = moment_rows(spark, [
        ("ad_moment", 75, 85, "Курс дает актуальные знания.", 95), ("duplicate", 218, 240, "Тот же результат с дополнительными словами.", 85),
        ("best", 200, 224, "Сильный результат: было десять тысяч, стало сто тысяч.", 90)])
    by = {a.id: a for a in sl.select_candidates(d, none, ClipParams(target_count=4, min_score=60)).collect()}
    assert by["best"].decision == "selected" and by["ad_moment"].reason == "promotional segment" and "duplicate" in by["duplicate"].reason
    d = moment_rows(spark, [("duplicate", 25, 45, "Тот же цельный рассказ с понятным выводом.", 64), ("first", 10, 32, "Один цельный рассказ с понятным выводом.", 65)])
    audit = sl.select_candidates(d, none, ClipParams(target_count=3)).collect()
    assert [a.id for a in audit if a.decision == "selected"] == ["first"]
    assert any(a.phase == "fallback" and a.id == "duplicate" and "duplicate" in a.reason for a in audit)
    picked = sl.selected_rows(d, sl.select_candidates(d, none, ClipParams(target_count=3))).first()
    assert "below strict quality gate" in picked.problems


def test_suggestion_without_a_sensible_end(spark):
    s = sentences(spark, [(0, 4, "Первая мысль."), (5, 9, "Вторая мысль."), (70, 80, "Третья мысль.")])
    answers = spark.createDataFrame([(s.first().project_id, 0, '[{"start": 5.0, "end": 1e12}]'), (s.first().project_id, 1, '[{"start": 1e12, "end": 2e12}]')],
                                    "project_id string, window_id int, response string")
    from reelspan.sources import files as fl
    got = {r.id: r for r in cal.suggestion_moments(fl.parse_suggestions(answers), s).collect()}
    assert got["suggested_0_0"].end == 80 and got["suggested_0_0"].text == "Вторая мысль. Третья мысль."
    assert got["suggested_1_0"].text == ""


def test_selection_walks_past_any_number_of_bad_candidates(spark):
    none = pr.promotional_blocks(sentences(spark, [(80, 84, "Ссылка на курс в описании.")]))
    word = lambda i: "".join(chr(1072 + int(c)) * 2 for c in str(100_000 + i))
    rows = [(f"c{i:03d}", 1000 + 100 * i, 1030 + 100 * i, f"{word(i)} {word(7 * i + 500)} {word(11 * i + 9000)}.", 95 - i / 100) for i in range(200)]
    d = moment_rows(spark, rows).withColumn("problems", F.when(F.col("id") < "c165", F.array(F.lit("teaser without payoff"))).otherwise(F.col("problems")))
    audit = sl.select_candidates(d, none, ClipParams(target_count=3, min_score=60)).collect()
    picks = sorted((a.clip_no, a.id, a.start, a.end) for a in audit if a.decision == "selected")
    assert picks == [(k + 1, f"c{165 + k}", 1000 + 100 * (165 + k), 1030 + 100 * (165 + k)) for k in range(3)]
    assert sum(a.decision == "rejected" for a in audit) == 165


# -- analysis ------------------------------------------------------------------------


def test_moments_skip_advertising(spark):
    texts = ["Почему это важная ошибка для автора?", "Я однажды сделал так и потерял результат.", "Теперь нужно делать иначе и вот понятный вывод.",
             "Реклама: используй промокод и переходи по ссылке в описании.",
             "В этом фрагменте есть важная мысль, которую можно превратить в короткий клип.",
             "Поэтому зритель может досмотреть до конца, если сразу дать конфликт и payoff."]
    found = cal.find_moments(sentences(spark, [(12 * i, 12 * i + 12, t) for i, t in enumerate(texts)])).collect()
    assert found and max(m.final_score for m in found) > 50
    assert not any("промокод" in m.text.lower() or "можно превратить" in m.text.lower() for m in found)


def test_dialogue_is_boosted_once(spark):
    rows = [(0, 12, "What happened here?", "S1"), (12, 24, "I think the monster changed the rule.", "S2"),
            (24, 36, "Why would that be possible?", "S1"), (36, 48, "Because the evidence is different now.", "S2")]
    found = cal.find_moments(sentences(spark, rows), ClipParams(min_score=35)).orderBy(F.desc("final_score")).first()
    assert found.speaker_count >= 2 and found.dialogue_score > 0 and found.reason.count("Dialogue signal") == 1


def test_prompt_windows_and_closed_interval_text(spark):
    s = sentences(spark, [(i * 10, i * 10 + 10, f"sentence {i}") for i in range(25)])
    w = wn.prompt_windows(s, SuggestionParams(60, 10)).orderBy("window_pos").collect()
    assert [x.window_start for x in w] == [0.0, 50.0, 100.0, 150.0, 200.0]
    assert any("180.00-190.00: sentence 18" in x.transcript for x in w)
    m = spark.createDataFrame([("p", "m", 180.0, 190.0)], "project_id string, id string, start double, end double")
    assert wn.closed_interval_text(m, s).first().interval_text == "sentence 17 sentence 18 sentence 19"


def test_segmentation_with_words_and_speakers(spark):
    words = [("One", 0.0, 0.4, None, "A"), ("two.", 0.5, 0.9, None, "A"), ("Three", 1.0, 1.4, None, "A"), ("four.", 1.5, 1.9, None, "B")]
    d = spark.createDataFrame([("p", 0, 0.0, 2.0, "One two. Three four.", None, words), ("p", 1, 2.0, 3.0, "Single", "C", [])], SEG)
    r = sg.segment_sentences(d).orderBy("pos").collect()
    assert [(x.start, x.end, x.text) for x in r] == [(0.0, 0.9, "One two."), (1.0, 1.9, "Three four."), (2.0, 3.0, "Single")]
    assert r[0].speaker == "A" and r[1].speaker is None and r[1].speakers == ["A", "B"] and r[1].speaker_switches == 1 and r[2].speakers == ["C"]


def test_greedy_spacing_equals_sequential_loop(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for key in range(6):
        times = sorted({rng.randrange(0, 400) for _ in range(rng.randrange(1, 90))})
        last = None
        for pos, t in enumerate(times):
            rows.append((key, pos, t))
            if last is None or t - last >= 25:
                want.add((key, t))
                last = t
    d = spark.createDataFrame(rows, "k int, pos long, t long")
    got = {(r.k, r.t) for r in ch.greedy_spacing(d, "k", "t", 25, "pos", chunk=100).collect()}
    assert got == want


# -- boundaries --------------------------------------------------------------------------


def bounds(spark, segs, moment, duration, **p):
    s = spark.createDataFrame([("p", i, float(a), float(b), t) for i, (a, b, t) in enumerate(segs)], "project_id string, pos long, start double, end double, text string")
    m = spark.createDataFrame([("p", "m", float(moment[0]), float(moment[1]))], "project_id string, id string, start double, end double")
    d = spark.createDataFrame([("p", float(duration))], "project_id string, transcript_duration double")
    r = bd.choose_boundaries(m, s, d, ClipParams(**p)).first()
    return r.clip_start, r.clip_end


CLIFF = dict(ending_strategy="cliffhanger")


def test_boundaries(spark):
    a, b = bounds(spark, [(10, 20, "hook sentence"), (20, 35, "payoff sentence")], (12, 34), 100)
    assert a <= 10 and b >= 35 and b - a <= 48
    _, b = bounds(spark, [(10, 20, "first part without punctuation"), (20.2, 30, "the actual payoff.")], (12, 19), 100)
    assert b >= 30
    a, b = bounds(spark, [(1, 12, "setup without punctuation"), (12.1, 28, "payoff finishes here.")], (2, 10), 100, max_duration_sec=20)
    assert b >= 28 and round(b - a, 2) <= 20
    a, _ = bounds(spark, [(0, 1.0, "Предыдущая фраза."), (1.2, 4.0, "Новый сильный заход."), (4.2, 20.0, "Продолжение мысли.")], (0.9, 18.0), 30)
    assert 1.0 < a < 1.2
    _, b = bounds(spark, [(0, 8, "Какой результат мы получили?"), (8.1, 10, "Вот тут."), (10.1, 13, "Было тридцать тысяч."),
                          (13.1, 16, "Было месяц назад, теперь семьсот тысяч.")], (0, 10), 40)
    assert b >= 16
    _, b = bounds(spark, [(0, 20.0, "Законченная сильная мысль."), (20.1, 24.0, "Совсем новая тема начинается здесь.")], (0, 19.8), 30)
    assert 20.0 <= b < 20.1


def test_minimum_length_across_silence(spark):
    """The walk for the minimum length goes on behind a long silence, however far the next speech lies."""
    for at in (30, 100, 1000):
        a, b = bounds(spark, [(0, 5, "A complete thought."), (at, at + 2, "and then we"), (at + 2.2, at + 4, "found it.")], (0, 5), at + 50)
        assert (a, b) == (max(0, round(at + 4.45 - 48, 2)), at + 4.45)
    # the target lies in an utterance that ends far off
    _, b = bounds(spark, [(0, 5, "A complete thought."), (6, 90, "one long line without an end"), (90.2, 92, "and its end.")], (0, 5), 200)
    assert b == 92.45


def test_cliffhanger_boundaries(spark):
    _, b = bounds(spark, [(0, 7, "setup"), (7.1, 14, "почему эта задача вообще пугает"), (14.1, 32, "а теперь полный ответ и объяснение.")], (1, 31), 80,
                  cliffhanger_min_duration_sec=10, cliffhanger_preferred_duration_sec=14, cliffhanger_max_duration_sec=18, **CLIFF)
    assert 14 <= b < 20
    _, b = bounds(spark, [(0, 8, "Начало мысли без финала"), (8.1, 14.15, "Ничего особенно не поменяется."), (14.3, 15.0, "Тысячи лет,"),
                          (15.1, 18.0, "сотни лет этим областям.")], (0.2, 17.5), 40,
                  cliffhanger_min_duration_sec=14, cliffhanger_preferred_duration_sec=16, cliffhanger_max_duration_sec=20, **CLIFF)
    assert 14.15 <= b < 14.5
    _, b = bounds(spark, [(0, 4, "Сильный факт в начале."), (4.2, 15, "Аргумент развивается и становится понятным."), (15.1, 16, "И поэтому"),
                          (17, 19, "мы получаем законченный вывод."), (19.2, 21, "Но дальше есть контртезис.")], (0.2, 16), 30,
                  cliffhanger_min_duration_sec=12, cliffhanger_preferred_duration_sec=19, cliffhanger_max_duration_sec=24, **CLIFF)
    assert 21.0 <= b <= 21.2


# -- captions ----------------------------------------------------------------------------


def cues(spark, segs, lo, hi, max_words=4):
    s = spark.createDataFrame([("p", i, float(a), float(b), t, spk, [(w, float(x), float(y), None, k) for w, x, y, k in ws]) for i, (a, b, t, spk, ws) in enumerate(segs)], SEG)
    c = spark.createDataFrame([("p", "c", float(lo), float(hi), float(hi - lo))], "project_id string, id string, start double, end double, duration double")
    return cp.caption_cues(c, s, max_words).orderBy("idx").collect()


def test_caption_chunks(spark):
    ws = [("first", 0.0, 0.3, None), ("idea,", 0.31, 0.7, None), ("second", 1.12, 1.5, None), ("part", 1.51, 1.8, None), ("500", 1.81, 2.05, None), ("years.", 2.06, 2.5, None)]
    assert [c.text for c in cues(spark, [(0, 4, "first idea, second part 500 years.", None, ws)], 0, 4)] == ["first idea,", "second part 500 years."]
    r = cues(spark, [(1, 3, "one two three four", "S2", [("one", 1.0, 1.2, "S2")])], 0, 5)
    assert [(c.text, c.speaker) for c in r] == [("one two three four", "S2")]
    r = cues(spark, [(1, 3, "раньше сейчас", None, [("раньше", 0.9, 1.1, None), ("сейчас", 1.2, 1.8, None)])], 1.0, 3.0, 3)
    assert [c.text for c in r] == ["раньше сейчас"] and len(r[0].words) == 2


def chunks_by_hand(words, cap):
    """Independent statement of the chunking rules on (text, start, end, speaker) tuples."""
    orphan = lambda w: "".join(c for c in w[0].lower() if c.isalnum() or c == "_") in DEFAULT.caption_orphans
    length = lambda ws: len(" ".join(w[0] for w in ws))
    out, cur, voice = [], [], words[0][3]
    for i, w in enumerate(words):
        if cur and w[3] != voice:
            out.append(cur)
            cur, voice = [], w[3]
        if cur and (len(cur) >= cap or length(cur + [w]) > 52):
            keep = [cur.pop()] if len(cur) > 1 and orphan(cur[-1]) else []
            out.append(cur)
            cur, voice = keep, w[3]
        cur = cur + [w]
        after = words[i + 1] if i + 1 < len(words) else None
        pause = max(0.0, after[1] - w[2]) if after else 0.0
        dots = w[0].endswith(("...", "…"))
        hard = (w[0].endswith((".", "!", "?", ";", ":")) and not dots) or pause >= 0.38
        soft = w[0].endswith(",") or dots or pause >= 0.20
        span = max(0.0, w[2] - cur[0][1])
        if (hard or len(cur) >= cap or span >= 2.5 or (span >= 1.15 and soft)) and not orphan(w):
            out.append(cur)
            cur, voice = [], after[3] if after else None
    if cur:
        out.append(cur)
    merged = []
    for c in out:
        secs = lambda x: max(0.0, x[-1][2] - x[0][1])
        if merged and merged[-1][-1][3] == c[0][3] and len(merged[-1]) + len(c) <= cap + 1 and length(merged[-1] + c) <= 56 and min(secs(c), secs(merged[-1])) < 0.62:
            merged[-1] = merged[-1] + c
        else:
            merged.append(c)
    return [" ".join(w[0] for w in c) for c in merged]


def test_caption_chunks_against_plain_python(spark):
    rng = random.Random(11)
    vocab = ["а", "и", "слово", "длинноеслово", "конец.", "запятая,", "пауза…", "в", "что-то", "ещё!", "не", "мысль;"]
    rows, want = [], {}
    for k in range(40):
        t, ws = 0.0, []
        for _ in range(rng.randrange(1, 45)):
            d = rng.choice([12, 20, 35, 60, 110]) / 100
            ws.append((rng.choice(vocab), round(t, 2), round(t + d, 2), rng.choice(["S1", "S1", "S1", "S2"])))
            t = round(t + d + rng.choice([0, 5, 21, 40]) / 100, 2)
        rows.append((f"p{k}", 0, 0.0, t + 1, " ".join(w[0] for w in ws), None, [(w, s, e, None, v) for w, s, e, v in ws]))
        want[f"p{k}"] = chunks_by_hand(ws, 7)
    segs = spark.createDataFrame(rows, SEG)
    clips = segs.select("project_id", F.lit("c").alias("id"), "start", "end", (F.col("end") - F.col("start")).alias("duration"))
    got = {}
    for r in cp.caption_cues(clips, segs, 3).orderBy("project_id", "idx").collect():
        got.setdefault(r.project_id, []).append(r.text)
    assert got == want


def test_caption_quality(spark):
    clips = spark.createDataFrame([("p", "gap", 0.0, 22.8, 22.8), ("p", "ok", 0.0, 22.8, 22.8), ("p", "early", 0.0, 22.8, 22.8), ("p", "none", 0.0, 5.0, 5.0)],
                                  "project_id string, id string, start double, end double, duration double")
    rows = [("gap", 0.0, 5.0, "opening subtitle words are present here"), ("gap", 11.0, 20.5, "closing subtitle words are also present here"),
            ("ok", 0.2, 8.0, "dense opening words keep the complete subtitle track populated"), ("ok", 8.3, 14.0, "the middle remains present and properly timed"),
            ("ok", 14.2, 20.5, "the final sentence also reaches the end cleanly"), ("early", 0.0, 6.4, "early only")]
    c = spark.createDataFrame([("p", i, s, e, t, []) for i, s, e, t in rows], f"project_id string, clip_id string, start double, end double, text string, words {WORD}")
    r = {x.id: x for x in cp.caption_quality(clips, c).collect()}
    assert r["gap"].largest_gap == 6.0 and r["gap"].needs_pass and not r["ok"].needs_pass and r["early"].needs_pass and r["none"].needs_pass
    assert r["early"].tail == 6.4


# -- cues -------------------------------------------------------------------------------------


BASE = [(100.20, 102.0, "Сначала важный тезис.", [("Сначала", 100.20, 100.55), ("важный", 100.56, 100.90), ("тезис.", 100.91, 101.30)]),
        (108.0, 110.0, "Но затем поворот.", [("Но", 108.0, 108.18), ("затем", 108.19, 108.55), ("поворот.", 108.56, 109.10)]),
        (117.0, 119.0, "Поэтому вот вывод.", [("Поэтому", 117.0, 117.40), ("вот", 117.41, 117.60), ("вывод.", 117.61, 118.10)])]


def plan(spark, segs, cuts=(), end=130.0, profile="banger", prob=None, p=EditParams()):
    s = spark.createDataFrame([("p", i, a, b, t, None, [(w, x, y, (prob or {}).get(w), None) for w, x, y in ws]) for i, (a, b, t, ws) in enumerate(segs)], SEG)
    c = spark.createDataFrame([("p", "c", 100.0, float(end), float(end - 100), "controversial_take", profile, [float(x) for x in cuts], "Сначала важный тезис", "Важный тезис", "text")],
                              "project_id string, id string, start double, end double, duration double, moment_type string, profile string, cuts array<double>, hook_text string, suggested_title string, text string")
    return cu.edit_plan(cu.plan_cues(c, s, p), p).first()


def ops(row, kind):
    return [o for o in row.operations if o.type == kind]


def test_beats_follow_word_times(spark):
    z = ops(plan(spark, BASE), "punch_zoom")
    assert any(0.25 <= o.start <= 0.5 for o in z) and any(16.9 <= o.start <= 17.2 for o in z) and all("score=" in o.reason for o in z)
    silent = ops(plan(spark, [(900.0, 901.0, "far", [("far", 900.0, 900.5)])]), "punch_zoom")
    assert len(silent) == 1 and silent[0].reason.startswith("hook: transcript timing unavailable")


def test_shot_motion_replaces_beats(spark):
    r = plan(spark, BASE, [6.6, 12.8, 15.8], end=118.0)
    m = ops(r, "shot_motion")
    assert not ops(r, "punch_zoom") and len(m) == 2 and m[0].start == 0 and m[0].end == 6.56


def test_timed_fact(spark):
    segs = BASE[:1] + [(102.4, 103.3, "500 лет.", [("500", 102.4, 102.75), ("лет.", 102.76, 103.3)])] + BASE[1:]
    r = plan(spark, segs, [6.6, 12.8, 15.8], end=118.0)
    e = ops(r, "evidence_stamp")
    assert len(e) == 1 and e[0].text == "500 ЛЕТ" and e[0].start == 2.36 and not ops(r, "audio_accent")
    assert r.strategy == "semantic_tension_v1" and r.natural_cut_count == 3 and r.generated_effect_count == 3


def test_questions(spark):
    r = plan(spark, BASE[:2] + [(112.0, 113.0, "Почему?", [("Почему?", 112.0, 113.0)])] + BASE[2:], [8.05, 20.0])
    a, z = ops(r, "audio_accent"), ops(r, "punch_zoom")
    assert len(a) == 1 and a[0].text == "question" and a[0].start == 12.06 and len(z) == 1 and z[0].start == 12.06 and 1.03 <= z[0].scale_to <= 1.045
    filler = [(112 + i * 1.2, 113 + i * 1.2, t, [(t, 112 + i * 1.2, 113 + i * 1.2)]) for i, t in enumerate(("Да?", "Что?", "Наверное?"))]
    assert not ops(plan(spark, BASE[:2] + filler + BASE[2:], [8.05, 20.0]), "audio_accent")
    ws = [("В", 112.0, 112.2), ("плане", 112.2, 112.6), ("какие", 112.6, 113.0), ("рофлы?", 113.0, 114.0)]
    a = ops(plan(spark, BASE[:2] + [(112.0, 114.0, "В плане какие рофлы?", ws)] + BASE[2:], [8.05, 20.0], prob={"какие": 0.95}), "audio_accent")
    assert len(a) == 1 and a[0].start == 12.66 and "какие рофлы" in a[0].reason.lower()


def test_clean_and_disabled_profiles(spark):
    r = plan(spark, BASE, [8.0, 16.0], profile="clean")
    assert r.strategy == "clean_native_v1" and r.generated_effect_count == 0
    off = plan(spark, BASE, profile="banger", p=EditParams(enabled=False))
    assert [o.type for o in off.operations] == ["trim"]


# -- clip text and speakers -------------------------------------------------------------------


def test_refreshed_context(spark):
    ws = [("old", 9.0, 9.3), ("fragment.", 9.3, 9.8), ("Actual", 10.1, 10.5), ("hook", 10.5, 10.8), ("starts", 10.8, 11.2), ("here.", 11.2, 11.6)]
    s = spark.createDataFrame([("p", 0, 9.0, 12.0, "old fragment. Actual hook starts here.", None, [(w, a, b, None, None) for w, a, b in ws]),
                               ("p", 1, 12.3, 14.0, "Second complete sentence.", None, []),
                               ("q", 0, 0.0, 1.0, "что-то новое", None, [("что", 0.0, 0.3, None, None), ("-то", 0.3, 0.5, None, None), ("новое", 0.5, 1.0, None, None)])], SEG)
    c = spark.createDataFrame([("p", "c", 10.0, 15.0), ("q", "c", 0.0, 2.0)], "project_id string, id string, start double, end double").withColumns(
        {n: F.lit("stale") for n in ("text", "hook_text", "suggested_title", "suggested_caption", "summary")})
    r = {x.project_id: x for x in bd.refresh_clip_context(c, s).collect()}
    assert r["p"].text == "Actual hook starts here. Second complete sentence." and r["p"].suggested_title == "Actual hook starts here."
    assert r["q"].text == "что-то новое"


def test_clustering_ignores_an_outlier(spark):
    step = [i * 0.16 / 11 - 0.08 for i in range(12)]
    rows = [("p", i, [1.0, o]) for i, o in enumerate(step)] + [("p", 12 + i, [o, 1.0]) for i, o in enumerate(step)] + [("p", 24, [-1.0, 0.0])]
    items = spark.createDataFrame([(p, i, v, 2.0, 3) for p, i, v in rows], "project_id string, pos long, embedding array<double>, duration double, n_words int")
    sizes = [r["count"] for r in sp.label_by_first_seen(sp.cluster_recordings(items)).groupBy("speaker").count().collect()]
    assert len(sizes) == 2 and min(sizes) >= 12


def test_short_turn_takes_nearest_voice(spark):
    rows = [("p", 0, [1.0, 0.0], 1.2, 3), ("p", 1, [0.0, 1.0], 0.3, 2), ("p", 2, [0.0, 1.0], 1.2, 3), ("p", 3, [1.0, 0.0], 1.3, 3)]
    items = spark.createDataFrame(rows, "project_id string, pos long, embedding array<double>, duration double, n_words int")
    base = sp.anchors(items)
    labels = spark.createDataFrame([("p", 0, "S1"), ("p", 2, "S2"), ("p", 3, "S1")], "project_id string, pos long, speaker string")
    cents = sp.centroids(base, labels)
    got = {r.pos: r.speaker for r in sp.assign_short_turns(items, labels, cents, sp.assignment_limits(base, labels, cents)).collect()}
    assert got == {0: "S1", 1: "S2", 2: "S2", 3: "S1"}


def test_inherited_speakers(spark):
    ref = spark.createDataFrame([("p", 0, 10.0, 11.0, "S1"), ("p", 1, 11.0, 12.0, "S2")], "project_id string, pos long, start double, end double, speaker string")
    local = spark.createDataFrame([("p", "c", 0, 0.0, 2.0, 10.0, [("first", 0.1, 0.8, None, None), ("second", 1.1, 1.8, None, None)])],
                                  f"project_id string, id string, pos long, start double, end double, offset double, words {WORD}")
    r = sp.inherit_transcript(local, ref).first()
    assert [w.speaker for w in r.words] == ["S1", "S2"]


def test_gap_fill_cascades(spark):
    rows = [(0, 0.0, 1.0, "A", True), (1, 1.2, 1.4, None, True), (2, 1.5, 1.7, None, True), (3, 2.0, 3.0, "A", True), (4, 3.1, 3.2, None, False), (5, 3.3, 4.0, "A", True),
            (6, 4.1, 9.0, None, True), (7, 9.1, 10.0, "B", True)]
    d = spark.createDataFrame([("p", *r) for r in rows], "project_id string, pos long, start double, end double, speaker string, fillable boolean")
    got = [r.speaker for r in sp.fill_gaps(d).orderBy("pos").collect()]
    assert got == ["A", "A", "A", "A", None, "A", None, "B"]
