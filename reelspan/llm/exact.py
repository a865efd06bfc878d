"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then a hash of the whole text.

DataFrame functions only. Two texts are equal if they are identical after every run of ASCII white space has become
one space; null counts as the empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reelspan.llm.common import SPACES, id_order, keep_rows, row_keys, stage

#: Bits of the filter that spares the second reading of the texts most full hashes: 4,096 rows of 4 KB, whatever the input.
FILTER_BITS = 1 << 27


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _sieve(keys: DataFrame) -> DataFrame:
    """Bitmaps (one hash function, fixed size) of the surviving (length, prefix hash) keys."""
    h = F.pmod(F.xxhash64("n", "prefix"), F.lit(FILTER_BITS))
    return keys.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))


def _passes(texts: DataFrame, sieve: DataFrame) -> DataFrame:
    """Rows (n, prefix, ...) whose bit is set."""
    h = F.pmod(F.xxhash64("n", "prefix"), F.lit(FILTER_BITS))
    d = texts.withColumns({"bucket": F.bitmap_bucket_number(h), "pos": F.bitmap_bit_position(h)})
    d = d.join(F.broadcast(sieve), "bucket")  # at most FILTER_BITS / 8 bytes
    return d.where("(cast(conv(hex(substring(bits, cast(pos div 8 as int) + 1, 1)), 16, 10) as int) & shiftleft(1, cast(pos % 8 as int))) > 0") \
        .drop("bucket", "bits", "pos")


def exact_groups(docs: DataFrame, prefix_chars: int = 512, digest: str = "surviving") -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with the row that stands for its text.

    Returns _k1, _k2 (``row_keys``), doc_id, keep_id, group_size, kept, text_sha256, one row per input row. Level one
    groups by length, level two the survivors by a hash of their first ``prefix_chars`` characters, level three what is
    still together by SHA-256. digest="surviving": only texts whose (length, prefix hash) key may occur again are hashed
    whole, text_sha256 of the others is null; a fixed-size filter of the surviving keys is broadcast for that, and its
    false hits cost a hash but change nothing. digest="every": the caller wants all digests, which then are
    taken in the same reading.

    Null texts equal empty ones. Null ids count as larger than every id; a group of only such rows has keep_id null.
    Of rows that share doc_id and text one is kept. An empty table gives none.
    """
    k1, k2 = row_keys()
    text = normalised(F.col("text"))
    cols = {"_k1": k1, "_k2": k2, "doc_id": F.col("doc_id"), "n": F.length(text), "prefix": F.xxhash64(F.substring(text, 1, prefix_chars)),
            "sha": F.sha2(text, 256)}
    select = lambda *names: docs.select(*[cols[c].alias(c) for c in names])
    names = ("_k1", "_k2", "doc_id", "n", "prefix", *(("sha",) if digest == "every" else ()))
    narrow = stage(select(*names).withColumn("_row", F.monotonically_increasing_id()))

    lengths = narrow.groupBy("n").count().where("count > 1").select("n")
    level1 = narrow.join(lengths, "n", "left_semi")
    prefixes = level1.groupBy("n", "prefix").count().where("count > 1").select("n", "prefix")
    level2 = narrow.join(prefixes, ["n", "prefix"], "left_semi")
    if digest == "every":
        level3 = level2
    else:
        again = _passes(docs.select(*[cols[c].alias(c) for c in ("_k1", "_k2", "n", "prefix")], "text"), _sieve(stage(prefixes)))
        again = again.select("_k1", "_k2", cols["sha"].alias("sha"))
        # a key names its text, so one digest per key is enough
        level3 = level2.join(again.groupBy("_k1", "_k2").agg(F.min("sha").alias("sha")), ["_k1", "_k2"])
    first = F.min(F.struct(id_order().alias("id"), F.col("_row").alias("row"), F.col("doc_id").alias("doc_id")))
    groups = level3.groupBy("n", "prefix", "sha").agg(first.alias("first"), F.count("*").alias("size")).where("size > 1")
    hits = groups.select("n", "prefix", "sha", "first", "size")
    if digest == "every":
        out = narrow.join(hits, ["n", "prefix", "sha"], "left")
    else:
        named = level3.select("_row", "n", "prefix", "sha").join(hits, ["n", "prefix", "sha"]).select("_row", "sha", "first", "size")
        out = narrow.join(named, "_row", "left")
    single = F.col("first").isNull()
    return out.select(
        "_k1", "_k2", "doc_id", F.when(single, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), (single | (F.col("first.row") == F.col("_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest doc_id. Same columns."""
    g = exact_groups(docs).where("group_size > 1")
    return keep_rows(docs, g.groupBy("_k1", "_k2").agg(F.max(F.col("kept").cast("int")).alias("copies"), F.lit(True).alias("single")))
