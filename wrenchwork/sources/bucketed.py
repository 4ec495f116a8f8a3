"""Tables stored by VIN: in buckets of its hash, sorted within.

Joins by VIN of such tables with the same number of buckets need no shuffle, and a search for one
VIN opens one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 256


def write_by_vin(
    rows: DataFrame, table: str, vin: str = "vin", buckets: int = BUCKETS, path: str | None = None
) -> None:
    """Write a table of the catalog, outside of the warehouse if ``path`` is given; it must be new.

    Each bucket is one file, as the rows are dealt by the same hash first. A vehicle that holds a
    large share of a table makes its bucket large; choose ``buckets`` by the size of the largest
    table, for all tables alike.
    """
    dealt = rows.repartition(buckets, vin).write.bucketBy(buckets, vin).sortBy(vin)
    options = {} if path is None else {"path": path}
    dealt.saveAsTable(table, format="parquet", mode="errorifexists", **options)


def by_vin(spark: SparkSession, table: str) -> DataFrame:
    return spark.table(table)
