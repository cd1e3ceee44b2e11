"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokenising.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet to the
shared folder and reads it again for the next, so a lost executor costs at most the stage that is running. All stages
but the last return the columns of ``documents`` and any others that docs has; n_chars follows the text.

Defined results: a null or empty text fails the quality rules; a stage that gets one all the same keeps it, and it has no
tokens. Of copies the one with the smallest id stays, a null id only where there is no other; rows equal in id and text
count as copies. Null ids are told apart by their texts. Empty tables pass through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from strideframe.llm import bpe, decontaminate, line_dedup, minhash, quality
from strideframe.llm.common import Scratch, fresh, own_columns, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that had words and have none left."""
    has_word = lambda c: F.coalesce(F.col(c).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    (had,) = fresh(docs, "had")
    left = line_dedup.dedup_lines(docs.withColumn(had, has_word("text"))).filter(~F.col(had) | has_word("text")).drop(had)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*own_columns(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return minhash.keep_one(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", remove_benchmark),
    ("byte-level BPE", tokenize),
]

#: SQL has no BPE; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
