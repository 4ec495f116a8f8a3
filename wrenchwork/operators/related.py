"""Joins between vehicles, claims, claimed parts and shipments.

All are equi-joins of a table that may repeat a key with one that does not.
The repeating side is the left one, or the join is an inner one: those are the
cases in which adaptive execution can cut a partition that a hot key made too
large. No side is broadcast by hint; Spark does so by the size it knows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .search import pending_review

NO_CLAIMS = "No claims"


def claim_lines(claims: DataFrame) -> DataFrame:
    """One row per claimed part; a claim without parts keeps a row with null ``oe``.

    Exploded rather than inlined, so that a field nobody asks for is not read.
    """
    return claims.select("no", F.explode_outer("parts").alias("part")).select(
        "no", "part.oe", "part.qty"
    )


def related_claims(vehicles: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims of every vehicle; one without any has a row that says so.

    Written as matches plus vehicles without claims: an outer join from the
    vehicles could not be cut at a vehicle with very many claims.
    """
    matches = claims.join(vehicles.select("vin"), F.col("vehicle") == F.col("vin")).select(
        "vin", F.col("no").alias("claim"), "fault", "status"
    )
    claimed = claims.select(F.col("vehicle").alias("vin")).distinct()
    without = vehicles.select("vin").join(claimed, "vin", "left_anti").select(
        "vin",
        F.lit(NO_CLAIMS).alias("claim"),
        F.lit(None).cast("string").alias("fault"),
        F.lit(None).cast("string").alias("status"),
    )
    return matches.unionByName(without)


def vehicle_by_id(vehicles: DataFrame, vehicle_id: int) -> DataFrame:
    return vehicles.filter(F.col("id") == vehicle_id)


def vehicles_by_id(vehicles: DataFrame, ids: DataFrame) -> DataFrame:
    """Vehicles asked for by the column ``id`` of another frame, each once."""
    return vehicles.join(ids.select("id").distinct(), "id", "left_semi")


def review_queue_dealer(claims: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Claims under review with the dealer that holds the vehicle."""
    holder = vehicles.select(F.col("vin").alias("vehicle"), "dealer")
    queue = pending_review(claims).select("no", "vehicle", "model", "fault", "status")
    return queue.join(holder, "vehicle").select(
        "no", "dealer", "vehicle", "model", "fault", "status"
    )


def claimed_parts(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Claimed parts with name and warranty label from the catalogue.

    ``lines`` are rows as of ``claim_lines``. A part the catalogue does not
    know, or a claim without parts, has nulls.
    """
    return lines.join(parts.select("oe", "name", "warranty"), "oe", "left").select(
        "no", "oe", "name", "qty", "warranty"
    )


def shipments_with_claim(shipments: DataFrame, claims: DataFrame) -> DataFrame:
    """Shipments with the vehicle, model and status of their claim."""
    head = claims.select(
        F.col("no").alias("claim"), "vehicle", "model", F.col("status").alias("claim_status")
    )
    return shipments.join(head, "claim").select(
        "no", "claim", "part", "qty", "carrier", "status", "eta",
        "vehicle", "model", "claim_status",
    )
