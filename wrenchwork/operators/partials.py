"""Figures of the dashboards from counts that are kept, not from all rows.

Partials are counts per key; partials of disjoint rows add up to those of all, and rows that
change take a count from one key and bring it to another. So the partials of a new state are those of
the state before plus a few rows for what a batch has changed. Their size is that of the
calendar times dealers times statuses, whatever the number of claims.
"""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import WRITE_OFF
from .kpis import PENDING, _monday, _within_week

CLAIM_KEYS = ("date", "dealer", "status", "shipped")


def claim_partials(claims: DataFrame, shipments: DataFrame) -> DataFrame:
    """``date, dealer, status, shipped, n``: claims by day, dealer, status, and whether something was shipped.

    Only approved and partly approved claims are looked up among the shipments; of the others it
    is not asked, ``shipped`` is false.
    """
    done = shipments.select(F.col("claim").alias("no")).distinct().withColumn("found", F.lit(True))
    settled = F.coalesce(F.col("status").isin(*WRITE_OFF), F.lit(False))
    asked = claims.filter(settled).join(done, "no", "left").select(
        "date", "dealer", "status", F.coalesce("found", F.lit(False)).alias("shipped")
    )
    others = claims.filter(~settled).select("date", "dealer", "status", F.lit(False).alias("shipped"))
    return _counted(asked.unionByName(others), CLAIM_KEYS)


def stock_partials(inventory: DataFrame) -> DataFrame:
    """``low, n``: articles at or below their safety quantity, and others."""
    return _counted(inventory.select((F.col("qty") <= F.col("safety")).alias("low")), ("low",))


def minus(partials: DataFrame) -> DataFrame:
    """The same counts to be taken away: of rows as they were before they changed."""
    return partials.withColumn("n", -F.col("n"))


def merged_partials(*partials: DataFrame) -> DataFrame:
    """The sum of partials of one kind; keys that nothing is left of go."""
    keys = [c for c in partials[0].columns if c != "n"]
    rows = reduce(DataFrame.unionByName, partials)
    return rows.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def claims_per_status_from(claims: DataFrame) -> DataFrame:
    return claims.groupBy("status").agg(F.sum("n").alias("claims"))


def claims_this_week_from(claims: DataFrame, as_of: date | None = None) -> DataFrame:
    if as_of is not None:
        monday = _monday(as_of)
        return claims.agg(F.lit(monday).alias("week"), _total(_within_week(monday)).alias("claims"))
    weeks = claims.groupBy(F.trunc("date", "week").alias("week")).agg(F.sum("n").alias("claims"))
    return weeks.agg(F.max("week").alias("week"), F.coalesce(F.max_by("claims", "week"), F.lit(0)).alias("claims"))


def admin_kpis_from(claims: DataFrame, stock: DataFrame, as_of: date | None = None) -> DataFrame:
    """The row of ``admin_kpis``, from partials of claims and of stock."""
    waiting = F.col("status").isin(*WRITE_OFF) & ~F.col("shipped")
    on_claims = claims.agg(
        _total(F.col("status") == PENDING).alias("pending_review"), _total(waiting).alias("awaiting_writeoff")
    )
    week = claims_this_week_from(claims, as_of).select(F.col("claims").alias("claims_this_week"))
    low = stock.agg(_total(F.col("low")).alias("low_stock_skus"))
    figures = ("pending_review", "awaiting_writeoff", "low_stock_skus", "claims_this_week")
    rows = on_claims.unionByName(week, allowMissingColumns=True).unionByName(low, allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in figures])


def dealer_claims_from(claims: DataFrame) -> DataFrame:
    """Per dealer its claims under review, approved and shipped, as in ``dealer_kpis``."""
    counted = {"under_review": PENDING, "approved": "Approved", "shipped": "Shipped"}
    return claims.groupBy("dealer").agg(
        *[_total(F.col("status") == status).alias(name) for name, status in counted.items()]
    )


def _counted(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def _total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0).cast("long"))
