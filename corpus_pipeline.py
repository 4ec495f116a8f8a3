"""A pipeline over documents: each stage works on all rows that the one before it kept.

Quality rules, near-duplicates, repeated passages, benchmark passages, source mix. Every
stage but the last returns the columns of the documents. Between the stages the rows are
written as Parquet to the folder that driver and executors share, and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wrenchwork.llm.bag_minhash import one_of_each
from wrenchwork.llm.decontaminate import without_benchmark
from wrenchwork.llm.frames import fresh, sized, stored
from wrenchwork.llm.quality_rules import quality_rules
from wrenchwork.llm.source_mix import with_copies
from wrenchwork.llm.substring_dedup import without_repeats


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that break one."""
    (name,) = fresh(docs, "quality")
    judged = quality_rules(docs).where(F.col(f"{name}.kept"))
    clean = F.col(f"{name}.clean_text")
    columns = {"text": clean, "n_chars": F.length(clean).cast("bigint")}
    return judged.select(*[columns[c].alias(c) if c in columns else F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of passages that an earlier document has.

    A text that loses words is its kept words joined by one space; the others stay as they
    are. Documents that lose all their words go.
    """
    return without_repeats(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the mix takes at least once, with their number of ``copies``."""
    return with_copies(docs)


STAGES = [
    ("quality_rules", clean_lines),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("source_mix", source_mix),
]

# Signatures, search in an index and dependent rounding are beyond SQL; tests hold the
# pipeline against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
