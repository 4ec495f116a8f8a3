"""Rows of a log that were checked: the column ``reason`` is null where they count."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows that count, rejects with their reason)``; together they are all rows."""
    good = checked.filter(F.col("reason").isNull()).drop("reason")
    return good, checked.filter(F.col("reason").isNotNull())
