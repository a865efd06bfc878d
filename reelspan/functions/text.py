"""Text expressions as Spark columns (no Python per row)."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from reelspan.lexicon import DEFAULT, Lexicon

# FIXED VALUES: patterns shared by every text rule.
WS = r"[\s\x0B\x1c-\x1f\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOKEN = "[a-zа-я0-9]+"
# the same as regular expressions that cost less a character
_WS = r"[[\x00-\x20\x85-\x{FFFF}]&&" + WS + "]"  # most letters are told apart by the first part
# white space that ``collapse`` would change: other than a blank, before a blank or the end, or at the start
_UNEVEN = _WS + r"(?:(?<! )|(?= |\z)|(?<=\A ))"
NUMBER = r"(?U)\b\d[\d\s.,]*%?\b"
SENTENCE_BREAK = _WS + "(?<=[.!?…]" + _WS + ")" + _WS + "*"  # asks for the mark only where white space is


def lit_array(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Pin computed columns before they are filtered on.

    Catalyst pushes a filter below the projections that compute its columns and
    thereby repeats their whole expression tree per reference; over staged text
    scores that tree explodes. A one-element generator is a natural stop: the
    filter can only use its output.
    """
    rest = [c for c in df.columns if c not in names]
    pinned = df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_pinned"))
    return pinned.select(*rest, *[F.col(f"_pinned.{n}").alias(n) for n in names]).select(*df.columns)


def contains_any(text: Column, patterns) -> Column:
    return reduce(or_, [text.contains(p) for p in patterns], F.lit(False))


def starts_with_any(text: Column, prefixes) -> Column:
    return reduce(or_, [text.startswith(p) for p in prefixes], F.lit(False))


def ends_with_any(text: Column, suffixes) -> Column:
    return reduce(or_, [text.endswith(p) for p in suffixes], F.lit(False))


def clamp(x: Column, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def round_to(x: Column, places: int) -> Column:
    """Half-up rounding that first removes binary noise beyond the 6th decimal."""
    return F.round(F.round(x.cast("double"), 6).cast("decimal(24,6)"), places).cast("double")


def round2(x: Column) -> Column:
    return round_to(x, 2)


def collapse(text: Column) -> Column:
    """Single blanks instead of any run of white space, trimmed."""
    return F.when(text.rlike(_UNEVEN), F.trim(F.regexp_replace(text, _WS + "+", " "))).otherwise(text)


def strip_ws(text: Column) -> Column:
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(_WS), F.regexp_replace(text, f"^{_WS}+|{_WS}+$", "")).otherwise(text)


def strip_set(text: Column, chars: str) -> Column:
    cls = "[" + "".join("\\" + c if c in r"\]^-[" else c for c in chars) + "]"
    return F.regexp_replace(text, f"^{cls}+|{cls}+$", "")


def rstrip_set(text: Column, chars: str) -> Column:
    cls = "[" + "".join("\\" + c if c in r"\]^-[" else c for c in chars) + "]"
    return F.regexp_replace(text, f"{cls}+$", "")


def n_words(text: Column) -> Column:
    """Number of blank-separated tokens; 0 for blank text."""
    clean = collapse(text)
    return F.when(clean == "", F.lit(0)).otherwise(F.size(F.split(clean, " ")))


# -- mis-decoded text --------------------------------------------------------

_CP1251 = [(b, bytes([b]).decode("cp1251")) for b in range(0x80, 0x100) if b != 0x98]
_CP1251_CHARS = "".join(c for _, c in _CP1251)
_CP1251_AS_LATIN1 = "".join(chr(b) for b, _ in _CP1251)


def mojibake_score(text: Column, lex: Lexicon = DEFAULT) -> Column:
    """3 per marker occurrence, 20 per replacement character."""

    def occurrences(x: Column, m: Column) -> Column:
        return ((F.length(x) - F.length(F.replace(x, m, F.lit("")))) / F.length(m)).cast("int")

    marks = F.aggregate(
        lit_array(lex.mojibake_markers), F.lit(0), lambda acc, m: acc + F.lit(3) * occurrences(text, m)
    )
    return marks + F.lit(20) * occurrences(text, F.lit("�"))


def repair_mojibake(text: Column, lex: Lexicon = DEFAULT) -> Column:
    """Undo one wrong single-byte decoding of UTF-8 where that lowers the marker score.

    Text without a marker character scores 0 and is returned untouched, so
    the expensive branch runs for suspicious rows only.
    """
    only_cp1251 = ~F.translate(text, _CP1251_CHARS, "").rlike(r"[^\x00-\x7F]")
    as_cp1251 = F.when(
        only_cp1251,
        F.try_validate_utf8(
            F.encode(F.translate(text, _CP1251_CHARS, _CP1251_AS_LATIN1), "ISO-8859-1").cast("string")
        ),
    )
    as_latin1 = F.when(
        ~text.rlike(r"[^\x{00}-\x{FF}]"),
        F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")),
    )
    ranked = F.transform(
        F.array(text, as_cp1251, as_latin1),
        lambda t, i: F.when(
            t.isNotNull(), F.struct(mojibake_score(t, lex).alias("score"), i.alias("i"), t.alias("text"))
        ),
    )
    best = F.array_min(F.array_compact(ranked))["text"]
    leads = "".join(sorted({m[0] for m in lex.mojibake_markers})) + "�"
    return F.when(text.rlike(f"[{leads}]"), best).otherwise(text)


def normalize_clean(text: Column) -> Column:
    """Lower case, ё→е, single blanks. For text that was repaired at ingestion."""
    return collapse(F.replace(F.lower(text), F.lit("ё"), F.lit("е")))


def normalize_quality_text(text: Column, lex: Lexicon = DEFAULT) -> Column:
    return normalize_clean(repair_mojibake(text, lex))


# -- phrases -----------------------------------------------------------------


def split_sentences(text: Column) -> Column:
    """Array of sentences: cut after . ! ? … followed by white space."""
    parts = F.transform(F.split(strip_ws(text), SENTENCE_BREAK), strip_ws)
    return F.filter(parts, lambda p: p != "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(text, " "), 1, n), " ")


def first_sentence(clean: Column) -> Column:
    return F.regexp_replace(clean, "(?s)" + SENTENCE_BREAK + ".*", "")


def first_phrase(clean: Column, n: int = 16) -> Column:
    """First sentence of collapsed text, at most n words."""
    return first_words(first_sentence(clean), n)


def hook_of(sentence: Column, n: int = 12) -> Column:
    return strip_set(first_words(sentence, n), " ,;:-")


def hook_phrase(clean: Column, n: int = 12) -> Column:
    return hook_of(first_sentence(clean), n)


def last_phrase(clean: Column) -> Column:
    """The last of ``split_sentences``: what follows the last break, found from the end."""
    return F.coalesce(F.regexp_replace(strip_ws(clean), r"(?s)\A.*" + SENTENCE_BREAK, ""), F.lit(""))


def drop_last_word(text: Column) -> Column:
    return F.regexp_replace(text, " [^ ]*$", "")


def first_complete_phrase(text: Column, words: int = 10, chars: int = 76) -> Column:
    phrase = strip_set(first_words(collapse(first_sentence(text)), words), " ,;:-")
    return F.when(F.length(phrase) <= chars, phrase).otherwise(
        rstrip_set(drop_last_word(F.left(phrase, F.lit(chars))), " ,;:-")
    )


def summarize(clean: Column, max_chars: int = 180) -> Column:
    """Collapsed text cut at a word boundary, '...' appended when cut."""
    cut = drop_last_word(F.rtrim(F.left(clean, F.lit(max_chars - 1))))
    return F.when(F.length(clean) <= max_chars, clean).otherwise(F.concat(cut, F.lit("...")))


def glue_hyphens(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+(-\w+)", "$1")


def bare_word(text: Column) -> Column:
    """Lower-cased token without any non-word character."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w]+", "")


def tokens(normalized: Column) -> Column:
    return F.regexp_extract_all(normalized, F.lit(f"({TOKEN})"), F.lit(1))


def terms(normalized: Column, lex: Lexicon = DEFAULT) -> Column:
    """Distinct tokens of 4+ characters that are not stop words."""
    return F.filter(F.array_except(tokens(normalized), lit_array(lex.stopwords)), lambda w: F.length(w) >= 4)


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(a) + F.size(b) - shared)
    )


# -- predicates over normalized text -----------------------------------------


def number_match(normalized: Column) -> Column:
    """First number-like run, '' if none."""
    return F.regexp_extract(normalized, NUMBER, 0)


def has_number(normalized: Column) -> Column:
    return normalized.rlike(NUMBER)


def has_quantity(normalized: Column, lex: Lexicon = DEFAULT) -> Column:
    digits = F.length(F.regexp_replace(number_match(normalized), r"(?U)\D", ""))
    return contains_any(normalized, lex.quantity_words) | (digits >= 3)


def _before_now(normalized: Column, lex: Lexicon) -> Column:
    return reduce(or_, [normalized.contains(a) & normalized.contains(b) for a, b in lex.before_now], F.lit(False))


def has_result(normalized: Column, lex: Lexicon = DEFAULT) -> Column:
    return _before_now(normalized, lex) | contains_any(normalized, lex.result_words)


def has_concrete_payoff(normalized: Column, lex: Lexicon = DEFAULT) -> Column:
    return (
        _before_now(normalized, lex)
        | contains_any(normalized, lex.arc_results)
        | contains_any(normalized, lex.arc_spoken_quantity)
        | (contains_any(normalized, lex.arc_counted) & has_number(normalized))
    )


def commercial_evidence(text: Column, normalized: Column, lex: Lexicon = DEFAULT) -> Column:
    """Sorted array of evidence categories; ``text`` keeps its letter case."""
    checks = [
        ("brand", text.rlike("(?U)" + lex.brand_regex)),
        ("context", contains_any(normalized, lex.context)),
        (
            "cta",
            contains_any(normalized, lex.cta)
            | (normalized.contains(lex.cta_pair[0]) & normalized.contains(lex.cta_pair[1])),
        ),
        ("disclosure", contains_any(normalized, lex.disclosure)),
        ("offer", contains_any(normalized, lex.offer)),
        ("urgency", contains_any(normalized, lex.urgency)),
    ]
    return F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in checks]))


def is_commercial(evidence: Column) -> Column:
    def has(*names: str) -> Column:
        return reduce(lambda x, y: x & y, [F.array_contains(evidence, n) for n in names])

    return has("disclosure") | has("cta") | has("offer", "urgency") | has("brand", "offer", "context")


def candidate_fingerprint(start: Column, end: Column, text: Column) -> Column:
    payload = F.concat_ws(
        "|",
        F.format_string("%.1f", start),
        F.format_string("%.1f", end),
        F.left(collapse(F.lower(text)), F.lit(320)),
    )
    return F.left(F.sha1(payload.cast("binary")), F.lit(8))


def post_copy(title: Column, description: Column, text: Column, base_tags) -> Column:
    """Title / description / hashtag block for one clip."""
    words = F.transform(F.split(collapse(text), " "), lambda w: F.lower(strip_set(w, ".,!?;:()[]\"'")))
    keywords = F.slice(F.filter(words, lambda w: F.length(w) > 5), 1, 5)
    tags = F.transform(
        keywords, lambda w: F.concat(F.lit("#"), F.regexp_replace(w, "[^A-Za-zА-Яа-я0-9_]", ""))
    )
    tags = F.array_distinct(F.concat(lit_array(base_tags), F.filter(tags, lambda t: F.length(t) > 1)))
    return F.concat(
        F.lit("TITLE:\n"), title, F.lit("\n\nDESCRIPTION:\n"), description,
        F.lit("\n\nHASHTAGS:\n"), F.array_join(tags, " "), F.lit("\n"),
    )


def timecode(seconds: Column) -> Column:
    """SubRip time HH:MM:SS,mmm."""
    ms = F.round(F.greatest(F.lit(0.0), seconds) * 1000).cast("long")
    return F.format_string(
        "%02d:%02d:%02d,%03d",
        (ms / 3600000).cast("long"),
        (ms / 60000).cast("long") % 60,
        (ms / 1000).cast("long") % 60,
        ms % 1000,
    )
