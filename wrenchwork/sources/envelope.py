"""Dumps of the web API: ``{"success": ..., "data": [...]}`` with camel-case names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import API_NAMES

CORRUPT = "_corrupt_record"


def api_schema(schema: T.StructType) -> T.StructType:
    """The same fields under the names the API gives them."""
    return T.StructType(
        [T.StructField(API_NAMES.get(f.name, f.name), f.dataType) for f in schema.fields]
    )


def envelope_schema(schema: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("success", T.BooleanType()),
            T.StructField("data", T.ArrayType(api_schema(schema))),
        ]
    )


def unwrap_envelope(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per object in ``data``, with our field names.

    An envelope with ``data: null`` gives no rows, and so does one whose
    ``success`` is not true.
    """
    rows = df.filter(F.col("success")).select(F.explode("data").alias("row"))
    return rows.select(
        *[F.col("row")[API_NAMES.get(f.name, f.name)].alias(f.name) for f in schema.fields]
    )


def checked_bodies(bodies: DataFrame, schema: T.StructType, body: str = "body") -> DataFrame:
    """Bodies of responses as text, with the ``response`` parsed and a ``reason`` to set it aside.

    The reason is null where the rows count, else the first of: no body (null or blank), not JSON,
    wrong type (valid JSON in which a field, or the whole, is not as the schema says; a missing
    field is null, a further one is not looked at), not successful, no data (an empty list is data).
    """
    kept = T.StructType([*envelope_schema(schema).fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = bodies.withColumn("response", F.from_json(body, kept, options))
    response = F.col("response")
    reason = (
        F.when(~F.coalesce(F.col(body).rlike(r"\S"), F.lit(False)), "no body")
        .when(F.try_parse_json(F.col(body)).isNull(), "not JSON")
        .when(response[CORRUPT].isNotNull(), "wrong type")
        .when(~F.coalesce(response["success"], F.lit(False)), "not successful")
        .when(response["data"].isNull(), "no data")
    )
    return parsed.withColumn("reason", reason)


def rows_of_bodies(checked: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of the bodies that count; of ``checked_bodies``."""
    counted = checked.filter(F.col("reason").isNull())
    return unwrap_envelope(counted.select("response.success", "response.data"), schema)


def rejected_bodies(checked: DataFrame) -> DataFrame:
    """The bodies set aside, as they came, with the ``reason``."""
    return checked.filter(F.col("reason").isNotNull()).drop("response")


def read_checked_dump(spark: SparkSession, schema: T.StructType, path: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of dumped responses, one per line; each line is in one of both.

    A line without text is no response and not reported.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "body").filter(F.col("body").rlike(r"\S"))
    checked = checked_bodies(lines, schema)
    return rows_of_bodies(checked, schema), rejected_bodies(checked)


def read_api_dump(
    spark: SparkSession, schema: T.StructType, path: str, one_per_line: bool = True
) -> DataFrame:
    """Read dumped responses, by default one (paged) response per line, which Spark can split.

    Otherwise a file holds a single response and is read by one task.
    """
    dumps = spark.read.schema(envelope_schema(schema)).json(path, multiLine=not one_per_line)
    return unwrap_envelope(dumps, schema)
