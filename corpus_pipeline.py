"""A training-corpus pipeline over ``documents``: what is rejected or repeated or leaks goes, the rest is tokenized.

Each stage works on all that its predecessor kept and is judged on its own input. Null texts count as empty ones; a
stage that changes texts sets n_chars anew; repeated rows are one group of near duplicates and leave one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deducta.llm import bpe, decontaminate, near_dup, quality, substring
from deducta.llm.common import staged, table

#: Documents with a lower score for quality go: those that the classifier's own query predicts 0.
REJECT_BELOW = quality.THRESHOLD


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    net = quality.trained(spark, sf_dir, docs)
    return quality.score(docs, net, column="__score").filter(F.col("__score") >= REJECT_BELOW).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that with the smallest id."""
    return near_dup.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out; documents of which nothing is left go."""
    out = substring.dedup(docs).filter("n_removed = 0 or n_removed < n_words")
    return out.select(*(F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_chars, n_tokens long, ids array<int>."""
    import public_tokenizers as public

    ranks = bpe.load_ranks(public.path("byte_bpe_50k.tiktoken"))
    out = bpe.encode(docs.select("doc_id", "lang", "source", "n_chars", "text"), ranks, public.PATTERN)
    return out.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("tokenize", tokenize),
]

#: SQL can't express the learned stage; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
