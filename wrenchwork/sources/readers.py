"""Readers with declared schemas; nothing is inferred.

Every reader takes a path Spark can list (one file, a folder or a glob) in
``parquet``, ``orc`` or ``json`` format, the last as one object per line.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas


def _read(spark: SparkSession, schema: T.StructType, path: str, format: str) -> DataFrame:
    return spark.read.format(format).schema(schema).load(path)


def read_vehicles(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, schemas.VEHICLES, path, format)


def read_claims(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    since: date | None = None,
    until: date | None = None,
) -> DataFrame:
    """Claims with their nested parts, optionally of a range of days, ends included.

    On a table written by ``write_claims`` the range also prunes the month folders.
    """
    claims = _read(spark, schemas.CLAIMS, path, format)
    by_month = "month" in claims.columns
    if since is not None:
        claims = claims.filter(F.col("date") >= F.lit(since))
        if by_month:
            claims = claims.filter(F.col("month") >= F.lit(since.replace(day=1)))
    if until is not None:
        claims = claims.filter(F.col("date") <= F.lit(until))
        if by_month:
            claims = claims.filter(F.col("month") <= F.lit(until.replace(day=1)))
    return claims.select(*schemas.CLAIMS.fieldNames())


def read_parts(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, schemas.PARTS, path, format)


def read_inventory(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, schemas.INVENTORY, path, format)


def read_shipments(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, schemas.SHIPMENTS, path, format)


def read_maintenance(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, schemas.MAINTENANCE, path, format)


def read_accidents(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, schemas.ACCIDENTS, path, format)


def read_decisions(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, schemas.DECISIONS, path, format)


def read_outbound(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, schemas.OUTBOUND, path, format)


def read_new_claims(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _read(spark, schemas.NEW_CLAIMS, path, format)
