"""A training corpus from raw documents: quality rules, near-duplicates, repeated passages, the mix of sources, tokens.

Each stage works on all that its predecessor kept, and its decisions take effect in the documents it returns.  All but the
last return the columns of their input, whatever these are; the last returns ``doc_id, text, ids`` (the token ids) and
digests of the ids and of what they decode to.

Defined results: a null text counts as empty, so the quality rules reject it; rows repeated under one doc_id are judged one by
one, and of equal or near-equal rows one stays, the smallest by (doc_id, hash of the text), null doc_ids last; a text of
which every word was cut stays as an empty one and takes part in no mix; an empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veristream.llm import bpe, mixing, quality, similar, substrings, textops
from veristream.llm.cluster import discard, small_batches, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.quality_filter(small_batches(docs))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (5-word shingles, similarity 0.8) one row stays."""
    return similar.near_dedup(small_batches(docs))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that start earlier are cut out of the texts; what is left keeps its lines."""
    return substrings.without_repeats(small_batches(docs))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(small_batches(docs))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts with their tokens, and digests of these and of the text they decode to."""
    return bpe.round_trip(small_batches(docs), whole=True)


STAGES = [
    ("op2_quality_rules", quality_stage),
    ("op9_simhash_near_dedup", near_dedup_stage),
    ("op3_substring_dedup", substring_stage),
    ("op6_mixing", mixing_stage),
    ("op1_bpe", encoding_stage),
]

#: SQL can't express the random mix or the encoding; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet and read again; a stage's table goes when the
    next one is written."""
    docs = textops.read_documents(spark, sf_dir)
    before = None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
