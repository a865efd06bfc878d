"""Word lists. All tuples below are FIXED VALUES: results depend on them
literally (substring matches on lower-cased text in which "ё" became "е").
Another language is another ``Lexicon`` instance, no code change.
"""

from __future__ import annotations

from dataclasses import dataclass

DEPENDENT_OPENINGS = (
    "и ", "а ", "но ", "это ", "вот ", "так вот", "как раз", "поэтому", "кстати", "короче", "теперь",
    "там ", "тут ", "на то", "после этого", "в общем", "вы можете подумать", "мы подготовили",
    "супер ответственный", "о, и, кстати", "как раз кубик",
)
DANGLING_WORDS = ("а", "и", "или", "но", "если", "когда", "потому", "поэтому", "что", "чтобы", "короче")


@dataclass(frozen=True)
class Lexicon:
    # promotional language
    disclosure: tuple[str, ...] = ("реклама", "спонсор", "партнер", "интеграция", "sponsor")
    cta: tuple[str, ...] = (
        "промокод", "ссылка в описании", "переходи по ссылке", "подпиш", "promo code", "subscribe",
        "скачивай ", "установи ", "регистрируйся", "зарегистрируйся", "попробуй бесплатно", "boosty",
        "бусти", "donate", "донат",
    )
    cta_pair: tuple[str, str] = ("ссыл", "в описани")
    offer: tuple[str, ...] = ("скидк", "кэшбэк", "призовой фонд", "миллион рублей", "бесплатн", "discount")
    urgency: tuple[str, ...] = (
        "успей до ", "только до ", "ограниченн", "пропадает с каждым", "потом эта штука исчезнет",
    )
    context: tuple[str, ...] = (
        "в новом обновлении", "редкий легендарный дроп", "шанс получить", "одного из ста", "сражайся с ",
        "буст к скорости", "получи возможность", "в событии участвует", "событии также участвует",
        "начинай охоту",
    )
    brand_regex: str = r"\b[A-Z][A-Za-z0-9]+(?:\s+[A-Z][A-Za-z0-9]+)+\b"
    # weak text
    generic: tuple[str, ...] = (
        "в этом фрагменте есть", "можно превратить в короткий клип",
        "подходит для короткого вертикального ролика", "потенциально интересный момент", "сильный hook",
        "автор объясняет проблему простыми словами", "короткого клипа",
    )
    low_information: tuple[str, ...] = (
        "подписывайтесь на канал", "ставьте лайки", "приятного просмотра", "всем привет", "начинаем",
    )
    # moment types
    controversial: tuple[str, ...] = (
        "ошибка", "миф", "неправильно", "спор", "проблема", "никогда", "херня",
    )
    how_to: tuple[str, ...] = ("как ", "шаг", "сделать", "нужно", "способ")
    warning: tuple[str, ...] = ("важно", "нельзя", "опасно", "риск", "осторожно")
    result: tuple[str, ...] = (
        "результат", "получилось", "итог", "вывод", "стало", "теперь", "обогнал", "место",
    )
    before_after: tuple[str, ...] = ("раньше", "теперь", "было", "стало", "до ", "после", "вместо")
    personal_story: tuple[str, ...] = ("я ", "мне", "мой", "моя", "история", "однажды")
    design_marker: str = "дизайн"
    meme_markers: tuple[str, ...] = ("культ", "мем")
    humor: tuple[str, ...] = (
        "шучу", "прикол", "но нет", "если бы", "смешн", "ха-ха", "ахаха", "ебать", "культ", "мем",
    )
    contrast: tuple[str, ...] = (" но ", " однако ", " зато ", " вместо ")
    result_words: tuple[str, ...] = (
        "результат", "получилось", "оказалось", "выяснилось", "итог", "обогнал", "заработал", "принес",
        "вырос", "место", "рекорд", "приобрел", "приобрёл",
    )
    quantity_words: tuple[str, ...] = (
        "миллион", "тысяч", "сотен", "процент", "рубл", "пользовател", "подписчик", "мест",
    )
    before_now: tuple[tuple[str, str], ...] = (("было", "теперь"), ("раньше", "сейчас"))
    dependent_openings: tuple[str, ...] = DEPENDENT_OPENINGS
    score_teasers: tuple[str, ...] = (
        "обязательно вернемся", "обязательно вернёмся", "дальше в ролике", "сначала про", "пока кубик",
        "кубик приземлился", "расскажу чуть позже",
    )
    dangling: tuple[str, ...] = DANGLING_WORDS
    # structure of a content arc
    arc_teasers: tuple[str, ...] = (
        "обязательно вернемся", "обязательно вернёмся", "дальше в ролике", "сначала про",
        "расскажу чуть позже", "пока кубик", "кубик уже",
    )
    arc_results: tuple[str, ...] = (
        "получилось", "оказалось", "выяснилось", "результат", "обогнал", "заработал", "место",
    )
    arc_spoken_quantity: tuple[str, ...] = ("миллион", "тысяч", "рубл", "процент", "место")
    arc_counted: tuple[str, ...] = (
        "миллион", "тысяч", "рубл", "мест", "пользовател", "подписчик", "процент",
    )
    topic_resets: tuple[str, ...] = (
        "теперь можно взрывать", "идем дальше", "идём дальше", "а пока", "про эту клетку", "кубик снова",
        "кубик уже", "кстати, про пользовател",
    )
    filler_openings: tuple[str, ...] = (
        "как так совпало", "о-о-о", "ооо", "вы можете подумать", "супер ответственный момент",
        "мы подготовили",
    )
    stopwords: tuple[str, ...] = (
        "это", "как", "что", "для", "или", "уже", "еще", "ещё", "там", "тут", "вот", "если", "когда",
        "можно", "нужно", "потом", "просто", "очень", "вообще",
    )
    # boundaries
    dangling_endings: tuple[str, ...] = (
        "а", "будто", "если", "и", "или", "когда", "но", "потому", "поэтому", "так", "что", "чтобы",
    )
    curiosity: tuple[str, ...] = (
        "почему", "как", "зачем", "что", "но", "однако", "если", "проблем", "важн", "главн", "значит",
        "задач", "страх", "тревож",
    )
    post_payoff: tuple[str, ...] = ("но ", "однако ", "зато ", "при этом ")
    deictic_endings: tuple[str, ...] = (
        "вот тут", "вот это", "вот так", "смотрите", "происходит вот это", "получилось вот так",
        "так что, бам", "так что бам",
    )
    followups: tuple[str, ...] = ("было ", "но ", "однако ", "зато ", "а теперь ", "в итоге ")
    # captions and cues
    caption_orphans: tuple[str, ...] = ("а", "бы", "в", "и", "к", "ли", "не", "но", "о", "с", "то", "у")
    question_strong: tuple[str, ...] = ("почему", "зачем", "разве", "неужели")
    question_cues: tuple[str, ...] = (
        "почему", "зачем", "разве", "неужели", "кто", "кого", "кому", "где", "куда", "откуда", "когда",
        "сколько", "какой", "какая", "какие", "какое", "как", "что", "че", "чего",
    )
    question_fillers: tuple[str, ...] = (
        "а", "в", "во", "да", "же", "ли", "на", "не", "нет", "ну", "просто", "с", "так", "типа", "это",
    )
    cue_contrast: tuple[str, ...] = ("но", "однако", "зато", "хотя", "вместо")
    cue_reveal: tuple[str, ...] = ("поэтому", "значит", "итог", "вывод", "главное", "получается")
    cue_stakes: tuple[str, ...] = ("важн", "проблем", "ошиб", "страх", "тревож", "никогда", "всегда")
    quantity_scores: tuple[tuple[str, float], ...] = (
        ("миллиард", 9.7), ("миллиарда", 9.7), ("миллионов", 9.6), ("миллион", 9.6),
        ("тысячи", 9.4), ("тысяч", 9.4), ("сотни", 9.2), ("сотен", 9.2),
    )
    fact_units: tuple[str, ...] = (
        "год", "лет", "месяц", "дн", "час", "минут", "секунд", "процент", "миллион", "миллиард", "тысяч",
        "раз",
    )
    # learning
    feature_results: tuple[str, ...] = ("вывод", "результат", "итого", "result")
    # mis-decoded text
    mojibake_markers: tuple[str, ...] = (
        "Ð", "Ñ", "Рџ", "Рђ", "Р‘", "Р“", "Р”", "Р•", "Р°", "Р±", "РІ", "Рі", "Рґ", "Рµ", "Рё", "Р№",
        "Рє", "Р»", "Рј", "РЅ", "Рѕ", "Рї", "СЂ", "СЃ", "С‚", "Сѓ", "С„", "С…", "С†", "С‡", "С€", "С‹",
        "СЊ", "СЌ", "СЋ", "СЏ", "С‘", "Р¶", "Гђ", "Г‘",
    )


DEFAULT = Lexicon()

# FIXED VALUES: problem names, score weights, profile table.
QUALITY_PROBLEMS = (
    "empty text", "ad or CTA language", "generic clip-analysis text", "low-information intro/outro",
    "too little speech", "repetitive speech",
)
SELECTION_HARD_PROBLEMS = ("ad or CTA language", "promotional segment", "teaser without payoff")
POOL_HARD_PROBLEMS = ("ad or CTA language", "generic clip-analysis text", "teaser without payoff")
SCORE_WEIGHTS = {
    "semantic_interest_score": 0.18,
    "hook_score": 0.18,
    "clarity_score": 0.12,
    "emotion_score": 0.10,
    "novelty_score": 0.10,
    "standalone_score": 0.12,
    "retention_score": 0.12,
    "speech_density_score": 0.04,
    "audio_energy_score": 0.02,
    "visual_energy_score": 0.02,
}
# profile: (max beats, seconds per beat, minimum gap, zoom scale, beat duration)
MONTAGE_PROFILES = {
    "clean": (0, 60.0, 8.0, 1.0, 0.0),
    "balanced": (2, 16.0, 5.2, 1.035, 1.20),
    "aggressive": (3, 9.0, 3.8, 1.065, 1.05),
    "podcast": (1, 22.0, 8.0, 1.030, 1.25),
    "gaming": (4, 7.0, 3.2, 1.080, 0.95),
    "banger": (3, 10.0, 4.4, 1.045, 1.10),
    "story": (1, 22.0, 8.0, 1.026, 1.20),
    "meme": (4, 6.5, 2.9, 1.085, 0.90),
}
MOTION_SCALES = {
    "podcast": 1.018, "balanced": 1.020, "story": 1.022, "banger": 1.026, "aggressive": 1.028,
    "gaming": 1.028, "meme": 1.028,
}
GENERATED_EFFECTS = (
    "audio_accent", "evidence_stamp", "hook_title", "micro_flash", "progress_bar", "punch_zoom",
    "shot_motion",
)
BASE_HASHTAGS = ("#shorts", "#tiktok", "#reels")
MODEL_REASON = "Personal ranking: prediction of the trained model."
ONLINE_REASON = "Personal ranking: online type and feature preference."
ONLINE_RANKER = "online_preference_v002"
MODEL_SPEC = "personal_logistic_v2"
SELECTION_POLICY = "content_arc_v2"
