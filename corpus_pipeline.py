"""A corpus pipeline: language, exact copies, near copies, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and returns the rows that stay, with the columns of documents; the last
one returns the token digests of each document. A stage's result is written as
Parquet and read again as the next one's docs, so lineage ends there.

Defined results: see the operators; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import byte_bpe, common, decontamination, exact_dedup, language_id, near_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language is told go: null, without a letter, or with no language that explains most of them."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles of similarity 0.8 or more stays."""
    return near_dedup.drop_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return byte_bpe.token_digests(docs, *byte_bpe.vocabulary())


STAGES = [
    ("language", language),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

#: SQL cannot express byte-pair merges or the language model; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        with common.scope() as made:
            docs = common.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        # A stage's own tables, and the rows that it read, aren't needed once its rows are written.
        common.free_all(made, docs)
        if before is not None:
            common.free(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
