"""The operators of this package as queries over whole tables, by name.

Each takes the session and the folder of the tables and returns a frame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .frames import sized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    def prepared(spark: SparkSession, folder: str) -> DataFrame:
        return fn(sized(spark, folder), folder)

    QUERIES[fn.__name__] = prepared
    return prepared


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from .quality_rules import quality_rules

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols",
        "quality.n_dup_lines", "quality.n_repeat_words", "quality.base_failed", "quality.kept",
        "quality.lost_words",
    )


@_query
def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    from .source_mix import mixed

    units = mixed(table(spark, folder, "documents"))
    one_each = F.explode(F.sequence(F.lit(1).cast("long"), "times"))
    return units.withColumn("row", one_each).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )


@_query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from .decontaminate import overlaps

    docs, benchmark = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return overlaps(docs, benchmark)


@_query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from .bag_minhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "class_id")


@_query
def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .substring_dedup import repeated_words

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return repeated_words(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def _remainder(by: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by))


@_query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from .language_id import fitted, with_language

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    network = fitted(docs.where(~held_out).select("text", "lang"))
    return with_language(docs.select("doc_id", held_out.alias("held_out"), "text"), network).select(
        "doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score")
    )


@_query
def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    from .quality_model import fitted, with_quality

    docs = table(spark, folder, "documents")
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    labels = table(spark, folder, "labels").where(~held_out)
    model = fitted(docs.select("doc_id", "text"), labels)
    scored = with_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return scored.select(
        "doc_id", "held_out", F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


@_query
def op8_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    from .html_extract import with_main_text

    pages = with_main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars")
    )


@_query
def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    from .license_scan import license_notices

    return license_notices(table(spark, folder, "documents"))


@_query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, folder, "documents")).select("doc_id", "n_tokens")


@_query
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_query
def op13_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    from .source_audit import source_audit

    return source_audit(table(spark, folder, "documents"))


@_query
def op11_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    from .vector_search import nearest_vectors

    return nearest_vectors(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)
