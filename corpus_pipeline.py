"""A corpus pipeline of the training-data operators.

``run`` applies the stages to ``documents``. Each stage works on all rows that
its predecessor kept, and each result but the last is written as Parquet in the
shared folder and read again, so a lost executor costs one stage at most. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import decontam, exact_dedup, ngram_join, sp_sample, toxicity
from corvane.llm.common import forget, table, written

TOXIC_FROM = 0.3


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score under the threshold stay."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), TOXIC_FROM)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the row with the smallest doc_id stays; rows without shingles all stay."""
    return ngram_join.first_of_class(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item stay."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each text, with their piece ids."""
    import public_tokenizers

    return sp_sample.segmentations(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES = [
    ("toxicity", without_toxic),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("SentencePiece sampling", segmented),
]

#: Sampling by hashes and a fitted model are not expressible in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return result
        docs = written(result, f"stage-{i}")
        if before is not None:
            forget(before)
        before = docs
