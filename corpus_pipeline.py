"""A training corpus from raw documents, stage by stage.

Every stage takes what the one before kept, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webmetrics.llm import decontamination, language_id, line_dedup, ngram_join, packing
from webmetrics.llm.common import cut, free_name, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Near duplicates: shingles of five words, four fifths of them shared.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; null texts, texts without letters and those near no language go.

    The model is fitted on a bounded sample of the rows that name their language.
    """
    return language_id.accepted(docs, language_id.fit(docs, F.lit(True)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line is alike to go, and with them documents of which nothing but white space is left."""
    count = free_name(docs, "_removed")
    kept = line_dedup.dedup_lines(docs, removed_column=count)
    kept = kept.where((F.col(count) == 0) | F.col("text").rlike(r"[^\s]"))
    size = F.when(F.col(count) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*(size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near copies the one with the smallest id stays, and of rows that repeat an id the first
    in the order of their columns. Rows without an id stay."""
    groups = ngram_join.ngram_components(docs, size=NEAR_WORDS, percent=NEAR_PERCENT)
    key = free_name(docs, "_gone")
    gone = groups.where("component_id != doc_id").select(F.col("doc_id").alias(key)).distinct()
    rest = docs.join(cut(gone), F.col("doc_id") == F.col(key), "left_anti")
    again = docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select(F.col("doc_id").alias(key))
    again, same = cut(again), F.col("doc_id") == F.col(key)
    one = rest.join(again, same, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias(key))
    return rest.join(again, same, "left_anti").unionByName(one.select(f"{key}.*"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat a passage of the benchmark go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all that is left, in sequences for training."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("best_fit_packing", pack),
]

#: Kernels, masks and a tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; what a stage returns is written as Parquet in the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
