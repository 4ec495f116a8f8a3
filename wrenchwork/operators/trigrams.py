"""Substring search through trigrams: candidates from a table of postings, then the exact test.

A text that holds the query holds all of its trigrams. So rows whose key stands under some
trigrams of the query are candidates, and only they are tested. A query of less than three
characters has no trigram and is searched by a full scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.base import as_column
from .search import search

SIZE = 3


def trigrams(text: Column | str) -> Column:
    """The different runs of three characters of a text in lower case; none of a null or shorter one."""
    lower = F.lower(F.coalesce(as_column(text), F.lit("")))
    places = F.sequence(F.lit(1), F.length(lower) - (SIZE - 1))
    cut = F.transform(places, lambda i: F.substr(lower, i, F.lit(SIZE)))
    return F.when(F.length(lower) >= SIZE, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def trigram_postings(rows: DataFrame, key: str, *columns: str) -> DataFrame:
    """``trigram, key``: each key once under every trigram of its texts.

    Keys are unique in ``rows``, so nothing has to be shuffled. Rows without key are left out;
    they can be found by a scan only.
    """
    held = F.array_distinct(F.flatten(F.array(*[trigrams(c) for c in columns])))
    keyed = rows.where(F.col(key).isNotNull())
    return keyed.select(F.explode(held).alias("trigram"), F.col(key).alias("key"))


def query_trigrams(spark: SparkSession, query: str) -> list[str]:
    """Trigrams of a query, cut by the same functions as those of the texts; no job is run."""
    return spark.sql("select * from values (:q) as t(q)", args={"q": query}).select(trigrams("q")).collect()[0][0]


def search_postings(
    rows: DataFrame, postings: DataFrame, key: str, query: str, *columns: str, grams: Sequence[str] | None = None
) -> DataFrame:
    """Rows that hold ``query`` in one of ``columns``, as ``search`` finds them.

    ``grams`` are the trigrams of the query by which candidates are taken, all by default; the
    rarest ones do as well and read less. ``postings`` has to cover all ``rows``.
    """
    if grams is None:
        grams = query_trigrams(rows.sparkSession, query)
    if not grams:
        return search(rows, query, *columns)
    under = postings.where(F.col("trigram").isin(*grams))
    if len(grams) > 1:
        under = under.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    candidates = under.select(F.col("key").alias(key))
    return search(rows.join(candidates, key, "left_semi").select(*rows.columns), query, *columns)
