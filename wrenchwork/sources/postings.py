"""Postings of a table as stored tables, and searches that read a few of them.

``{path}/postings`` lies in folders by a hash of the trigram, sorted by trigram, so a search
opens the folders of its trigrams and skips what else is in them by the files' statistics. A
trigram of very many keys is cut over several files. ``{path}/counts`` has the number of keys per
trigram, from which the rarest ones of a query are chosen; it is as large as the alphabet allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.trigrams import query_trigrams, search_postings, trigram_postings

BUCKETS = 64
RAREST = 2


def write_postings(rows: DataFrame, path: str, key: str, *columns: str, buckets: int = BUCKETS) -> None:
    """Postings of all ``rows``; fails if the folder is there already."""
    postings = trigram_postings(rows, key, *columns).withColumn("bucket", _bucket(F.col("trigram"), buckets))
    (
        postings.hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "trigram", "key")
        .write.mode("errorifexists").partitionBy("bucket").parquet(f"{path}/postings")
    )
    stored = rows.sparkSession.read.parquet(f"{path}/postings")
    counts = stored.groupBy("trigram", "bucket").agg(F.count("*").alias("n"))
    counts.sortWithinPartitions("trigram").write.mode("errorifexists").parquet(f"{path}/counts")
    rows.sparkSession.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/layout")


def search_stored(
    rows: DataFrame, path: str, key: str, query: str, *columns: str, rarest: int = RAREST
) -> DataFrame:
    """The rows that hold the query, by the postings of its ``rarest`` trigrams.

    Of the counts a few rows come to the driver, one per trigram of the query; if one of these
    has no posting nothing is found. A query without trigrams is searched by a scan.
    """
    spark = rows.sparkSession
    grams = query_trigrams(spark, query)
    counts = dict(spark.read.parquet(f"{path}/counts").where(F.col("trigram").isin(*grams)).select("trigram", "n").collect())
    if len(counts) < len(grams):
        return rows.limit(0)
    chosen = sorted(grams, key=lambda g: (counts[g], g))[:rarest]
    return search_postings(rows, _read(spark, path, chosen), key, query, *columns, grams=chosen)


def _read(spark: SparkSession, path: str, grams: list[str]) -> DataFrame:
    postings = spark.read.parquet(f"{path}/postings")
    if not grams:
        return postings
    buckets = spark.read.parquet(f"{path}/layout").first()["buckets"]
    folders = spark.sql("select explode(:g) as trigram", args={"g": grams}).select(_bucket(F.col("trigram"), buckets))
    return postings.where(F.col("bucket").isin(*sorted({r[0] for r in folders.collect()})))


def _bucket(trigram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(trigram.cast("binary")), F.lit(buckets)).cast("int")
