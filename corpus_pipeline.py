"""From raw documents to token ids: quality rules, line de-duplication, near-duplicate removal,
benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns the columns of docs, whatever they are called, the
last one token ids. Null and empty texts, and whatever else has fewer than 20 words, go with the first
stage; of equal rows the third keeps one; an empty table gives an empty result. `run` writes each
stage to the shared folder and reads it back, so a lost executor costs a part of one stage; a stage's
table goes when the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brisk.llm import bpe, decontam, jaccard, linededup, quality
from brisk.llm.common import Scratch, around, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the current policy; the rule on toxic words is fitted on the labels of
    the documents at hand."""
    labels = table(spark, sf_dir, "labels")
    return around(docs, quality.OWN, lambda d: quality.quality_rules(d, labels).where("kept"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the line chunks that stood in an earlier place."""

    def work(d: DataFrame) -> DataFrame:
        out = linededup.line_dedup(d)
        if "n_chars" in d.columns:
            out = out.withColumn("n_chars", F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
        return out

    return around(docs, linededup.RESULTS, work)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (32-bit little-endian) of every document, with their digest and that of the bytes
    they decode to."""
    import public_tokenizers

    out = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality_rules", drop_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenize),
]

#: Near duplicates and BPE cannot be put into SQL; tests hold `run` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), "documents")  # takes the place of the one before
    return STAGES[-1][1](spark, docs, sf_dir)
