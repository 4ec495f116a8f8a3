"""From approved claims to write-off orders and shipment requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schemas import OK, WRITE_OFF

SETTLEMENT = "Replace part"
REQUESTED = "Pending"


def awaiting_writeoff(
    claims: DataFrame, shipments: DataFrame, orders: DataFrame | None = None
) -> DataFrame:
    """Approved and partly approved claims for which nothing was shipped.

    ``orders`` may give the write-off orders so far; their claims are done too.
    Both are cut down to their claim numbers before the anti-join, which
    combines a claim of very many shipments before the shuffle.
    """
    done = shipments.select(F.col("claim").alias("no"))
    if orders is not None:
        done = done.unionByName(orders.select(F.col("claim").alias("no")))
    to_settle = claims.filter(F.col("status").isin(*WRITE_OFF))
    return to_settle.join(done.distinct(), "no", "left_anti")


def approved_lines(checks: DataFrame) -> DataFrame:
    """Claimed parts to be replaced: all of an approved claim, the passing ones of a partial.

    ``checks`` is the result of ``part_checks`` for the claims in the queue.
    """
    passes = (F.col("term") == OK) & (F.col("wear") == OK)
    approved = (F.col("status") == "Approved") | ((F.col("status") == "Partial") & passes)
    return checks.filter(F.col("oe").isNotNull() & approved).select("no", "oe", "name", "qty")


def shipment_requests(checks: DataFrame) -> DataFrame:
    """One request per claimed part to be replaced; the name is the catalogue's."""
    return approved_lines(checks).select(
        F.col("no").alias("claim"), "oe", F.col("name").alias("part"), "qty",
        F.lit(REQUESTED).alias("status"),
    )


def writeoff_orders(queue: DataFrame, checks: DataFrame) -> DataFrame:
    """One order per claim in the queue, also for a claim with no part to be replaced."""
    totals = approved_lines(checks).groupBy("no").agg(
        F.count("*").alias("parts"), F.sum("qty").alias("qty")
    )
    return queue.select("no", "vehicle", "model").join(totals, "no", "left").select(
        F.col("no").alias("claim"), "vehicle", "model",
        F.lit(SETTLEMENT).alias("settlement"),
        F.coalesce("parts", F.lit(0)).alias("parts"),
        F.coalesce("qty", F.lit(0).cast("long")).alias("qty"),
    )


def write_off(queue: DataFrame, checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(write-off orders, shipment requests)`` for the claims in ``queue``."""
    return writeoff_orders(queue, checks), shipment_requests(checks)


def writeoff_stock(requests: DataFrame, inventory: DataFrame) -> DataFrame:
    """Requested parts with the stock on hand, each request looked at for itself.

    A part without an article is out of stock.
    """
    stock = inventory.select("oe", F.col("qty").alias("qty_on_hand"))
    enough = F.coalesce(F.col("qty_on_hand") >= F.col("qty"), F.lit(False))
    return requests.join(stock, "oe", "left").select(
        "claim", "oe", "part", "qty", "qty_on_hand", enough.alias("in_stock")
    )
