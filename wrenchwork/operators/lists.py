"""The lists and cards of the portal as projections, and its ordered short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.cover import label_months, warranty_class
from ..functions.status import status_class
from ..functions.text import escape_html, thousands

RECENT = 4
PICKER_SIZE = 5


def vehicle_list(vehicles: DataFrame) -> DataFrame:
    return vehicles.select(
        "vin", "brand", "model", "plate",
        F.concat(thousands("mileage"), F.lit(" km")).alias("mileage"),
        "status",
    )


def vehicle_profile(vehicles: DataFrame) -> DataFrame:
    return vehicles.select(
        "brand", "model", "vin", "plate", "sale_date",
        F.concat(thousands("mileage"), F.lit(" km")).alias("mileage"),
    )


def vehicle_picker(vehicles: DataFrame) -> DataFrame:
    """What is unknown shows as empty text, between the same separators."""
    label = F.concat(_shown("vin"), F.lit(" · "), _shown("model"))
    return vehicles.select("id", label.alias("label"))


def _shown(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def claim_list(claims: DataFrame) -> DataFrame:
    return claims.select("no", "model", "vehicle", "fault", "date", "status")


def shipment_list(shipments: DataFrame) -> DataFrame:
    return shipments.select("no", "claim", "part", "qty", "carrier", "tracking", "status", "eta")


def part_cards(parts: DataFrame) -> DataFrame:
    """A wear part shows that it is one instead of its warranty label.

    A missing category or label shows as empty text.
    """
    # Fixed value: the badge of a wear part.
    cover = F.when(F.col("wear"), F.lit("⚠️ Wear Item")).otherwise(_shown("warranty"))
    return parts.select(
        "name", "oe",
        F.concat(_shown("cat"), F.lit(" · "), cover).alias("meta"),
        "brand",
        F.array_join("models", ", ").alias("models"),
    )


def part_picker(parts: DataFrame, size: int = PICKER_SIZE) -> DataFrame:
    """The first parts of the catalogue; rows have no order of their own, so by OE number."""
    return parts.select("name", "oe").orderBy("oe").limit(size)


def stock_level(inventory: DataFrame) -> DataFrame:
    """Stock at or below the safety quantity is low."""
    level = F.when(F.col("qty") <= F.col("safety"), "Low").otherwise("OK")
    return inventory.select("sku", "oe", "name", "qty", "location", level.alias("level"))


def status_badges(rows: DataFrame) -> DataFrame:
    """The rows with the badge class of their ``status``."""
    return rows.withColumn("badge", status_class("status"))


def newest_claims(claims: DataFrame, size: int = RECENT) -> DataFrame:
    """Newest claims first; claims of one day by number, highest first."""
    return claims.orderBy(F.desc("date"), F.desc("no")).limit(size)


def recent_claims(claims: DataFrame, size: int = RECENT) -> DataFrame:
    return newest_claims(claims, size).select("no", "model", "status", "date")


def part_labels(parts: DataFrame) -> DataFrame:
    """Class and months that the warranty label of a part states."""
    return parts.select(
        "oe", "warranty",
        warranty_class("warranty").alias("class"), label_months("warranty").alias("months"),
    )


def maintenance_timeline(maintenance: DataFrame) -> DataFrame:
    """Service history by vehicle, newest first.

    The sort key goes on beyond the vehicle, so the range partitioning of the
    sort can cut within a vehicle of many services.
    """
    return maintenance.select(
        "vin", "date", "km",
        F.concat_ws(" · ", F.col("date").cast("string"),
                    F.concat(thousands("km"), F.lit(" km"))).alias("when"),
        "title",
    ).orderBy("vin", F.desc("date"), F.desc("km"), "title")


def escaped_rows(rows: DataFrame) -> DataFrame:
    """Every text made safe for an HTML report, also inside arrays and structs.

    A null text becomes empty text; null arrays and structs stay null. Other values,
    maps among them, are left as they are.
    """
    return rows.select(
        *[_escaped(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema.fields]
    )


def _escaped(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return escape_html(value)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda item: _escaped(item, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_escaped(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value
