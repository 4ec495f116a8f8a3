"""Writers of logs and snapshots.

State is a snapshot and the logs that came after it; applying the logs gives a
new snapshot in a new folder, so a reader of the old one is never disturbed
and a job that is run again starts from the same input.

``rebalance`` lets adaptive execution cut the output into files of even size:
a large month is spread over several tasks and small ones share a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def append_rows(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Append to a log: decisions, rejects, write-off orders, shipment requests."""
    df.hint("rebalance").write.mode("append").format(format).save(path)


def write_snapshot(df: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a new snapshot; fails if the folder is there already."""
    df.hint("rebalance").write.mode("errorifexists").format(format).save(path)


def write_claims(claims: DataFrame, path: str, format: str = "parquet") -> None:
    """Write a new snapshot of the claims in one folder per month of ``date``."""
    _by_month(claims).write.mode("errorifexists").partitionBy("month").format(format).save(path)


def append_claims(claims: DataFrame, path: str, format: str = "parquet") -> None:
    """Append claims to a table laid out by ``write_claims``."""
    _by_month(claims).write.mode("append").partitionBy("month").format(format).save(path)


def require_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Return ``df``; raise ``ValueError`` if two rows share a key.

    Runs one aggregation and brings back a single example.
    """
    double = df.groupBy(*keys).count().filter(F.col("count") > 1).head(1)
    if double:
        example = {key: double[0][key] for key in keys}
        raise ValueError(f"{example} occurs {double[0]['count']} times")
    return df


def _by_month(claims: DataFrame) -> DataFrame:
    month = F.trunc("date", "month")
    return claims.withColumn("month", month).hint("rebalance", "month")
