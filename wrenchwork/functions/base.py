"""Shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_column(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
