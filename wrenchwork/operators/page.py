"""The page of a vehicle: profile, covers, services and claims, as rows of one table."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import thousands
from .related import NO_CLAIMS
from .warranty import warranty_cover


def vehicle_page(vehicles: DataFrame, maintenance: DataFrame, claims: DataFrame, as_of: date) -> DataFrame:
    """``vin, section, day, title, detail`` of the given vehicles, as a rule of one.

    Sections are profile, cover, service and claim; a vehicle without claims has a row that says
    so. What is unknown is left out of a detail. All joins are by VIN, so on tables stored by VIN
    (``sources.write_by_vin``) nothing is shuffled, and a filter of ``vehicles`` on the VIN itself
    opens one bucket of each table.
    """
    given = vehicles.select("vin")
    profile = vehicles.select(
        "vin", _section("profile"), F.lit(None).cast("date").alias("day"),
        F.concat_ws(" ", "brand", "model").alias("title"),
        _joined(
            F.concat(F.lit("Plate "), "plate"),
            F.concat(F.lit("Sold "), F.col("sale_date").cast("string")),
            F.concat(thousands("mileage"), F.lit(" km")),
        ),
    )
    cover = warranty_cover(vehicles, as_of).select(
        "vin", _section("cover"), F.col("warranty_start").alias("day"), F.col("cover").alias("title"),
        _joined(F.col("terms"), F.col("state")),
    )
    service = maintenance.join(given, "vin", "left_semi").select(
        "vin", _section("service"), F.col("date").alias("day"), "title",
        _joined(F.col("date").cast("string"), F.concat(thousands("km"), F.lit(" km"))),
    )
    raised = claims.select(
        F.col("vehicle").alias("vin"), F.col("date").alias("day"), F.col("no").alias("title"),
        _joined(F.col("fault"), F.col("status")),
    )
    claim = given.join(raised, "vin", "left").select(
        "vin", _section("claim"), "day", F.coalesce("title", F.lit(NO_CLAIMS)).alias("title"), "detail"
    )
    return profile.unionByName(cover).unionByName(service).unionByName(claim)


def _section(name: str) -> Column:
    return F.lit(name).alias("section")


def _joined(*texts: Column) -> Column:
    found = F.concat_ws(" · ", *texts)
    return F.when(found != "", found).alias("detail")
