"""Shipment requests booked as shipments, once, and what they make of the claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import WRITE_OFF

SHIPPED = "Shipped"


def booked_shipments(requests: DataFrame, shipments: DataFrame | None = None) -> DataFrame:
    """The shipments that requests ``(claim, oe, part, qty, status)`` lead to and that do not exist yet.

    The number is made of claim and part, so a request that comes again, in another run too, is
    the same shipment; requests of one claim for the same part are one shipment of their sum.
    Carrier, tracking and arrival are unknown as yet.
    """
    number = F.concat(F.lit("SHP-"), "claim", F.lit("/"), "oe")
    wanted = requests.groupBy("claim", "oe").agg(
        F.min("part").alias("part"), F.sum("qty").alias("qty"), F.min("status").alias("status")
    )
    new = wanted.select(
        number.alias("no"), "claim", "part", "qty",
        F.lit(None).cast("string").alias("carrier"), F.lit(None).cast("string").alias("tracking"),
        "status", F.lit(None).cast("date").alias("eta"),
    )
    return new if shipments is None else new.join(shipments.select("no"), "no", "left_anti")


def shipped_claims(claims: DataFrame, booked: DataFrame) -> DataFrame:
    """Approved and partly approved claims for which something was booked, now Shipped; no others."""
    settled = claims.filter(F.col("status").isin(*WRITE_OFF))
    done = booked.select(F.col("claim").alias("no")).distinct()
    return settled.join(done, "no", "left_semi").select(
        *[F.lit(SHIPPED).alias(c) if c == "status" else c for c in claims.columns]
    )


def merged_claims(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """All claims, those of ``changed`` in place of the ones with their number, and new ones.

    ``changed`` has each number once. Claims that stay are only looked up by number.
    """
    kept = claims.join(changed.select("no"), "no", "left_anti")
    return kept.select(*claims.columns).unionByName(changed.select(*claims.columns))
