"""From raw documents to token ids: toxicity, exact and near duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs``, and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from reelspan.llm import bpe, exact, minhash, mixing, simhash, toxicity
from reelspan.llm.catalog import vocabulary, word_pattern
from reelspan.llm.common import DOCUMENT_COLUMNS, first_of_groups, table
from reelspan.llm.components import merge_groups
from reelspan.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their nearest labelled examples do not call toxic."""
    return toxicity.drop_toxic(docs.select(*DOCUMENT_COLUMNS), table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the smallest doc_id."""
    return exact.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-copy group, the one with the smallest doc_id.

    SimHash links fingerprints that differ in 2 bits or fewer. Pairs of five-word Jaccard similarity 0.8 differ in up to 20 of
    64 bits, which no block index separates from chance; bands of minima find these too, and a group holds links of both kinds.
    """
    return first_of_groups(docs, merge_groups(minhash.near_components(docs, lower=True), simhash.near_groups(docs)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids (array of int), n_tokens, and whether the ids decode to the text again (null text: empty)."""
    path, pattern = vocabulary("byte_bpe_50k.tiktoken"), word_pattern()
    d = docs.select("doc_id", "source", "text", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_md5"))
    d = bpe.decode(bpe.encode(d, path, pattern), path, keep=True)
    return d.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.md5("decoded") == F.col("_md5")).alias("restored"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_decode),
]
#: Nearest examples, near copies and byte-level BPE have no SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what is between them is kept below the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
