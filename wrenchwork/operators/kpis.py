"""Figures of the dashboards.

Each table is read once and reduced by partial aggregation before anything is
shuffled; the figures of several tables meet as rows of a union, not in a join.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from .search import low_stock
from .warranty import active
from .writeoff import awaiting_writeoff

PENDING = "Under Review"


def claims_per_status(claims: DataFrame) -> DataFrame:
    return claims.groupBy("status").agg(F.count("*").alias("claims"))


def active_vehicles(vehicles: DataFrame, as_of: date) -> DataFrame:
    """Vehicles with a cover in force on a day, per dealer; dealers without one show 0."""
    return vehicles.groupBy("dealer").agg(F.count_if(active(as_of)).alias("active_vehicles"))


def low_stock_count(inventory: DataFrame) -> DataFrame:
    return low_stock(inventory).agg(F.count("*").alias("low_stock_skus"))


def claims_this_week(claims: DataFrame, as_of: date | None = None) -> DataFrame:
    """Claims in the week of a day, Monday to Sunday; by default of the newest claim.

    With a day given the filter is a plain range on ``date``, which prunes; to
    prune month folders too, read the claims with ``since`` and ``until``.
    Without one the claims are counted per week, and the newest week is kept:
    one pass, where finding the newest day first would take two.
    """
    if as_of is not None:
        monday = _monday(as_of)
        return claims.filter(_within_week(monday)).agg(
            F.lit(monday).alias("week"), F.count("*").alias("claims")
        )
    return _newest_week(_per_week(claims, F.count("*").alias("claims")), "claims")


def admin_kpis(
    claims: DataFrame, shipments: DataFrame, inventory: DataFrame, as_of: date | None = None
) -> DataFrame:
    """Pending reviews, claims awaiting write-off, low-stock articles, claims this week."""
    pending = F.count_if(F.col("status") == PENDING)
    if as_of is not None:
        on_claims = claims.agg(
            pending.alias("pending_review"),
            F.count_if(_within_week(_monday(as_of))).alias("claims_this_week"),
        )
    else:
        weeks = _per_week(claims, pending.alias("pending"), F.count("*").alias("claims"))
        on_claims = weeks.agg(
            F.sum("pending").alias("pending_review"),
            F.max_by("claims", "week").alias("claims_this_week"),
        )
    queue = awaiting_writeoff(claims, shipments).agg(F.count("*").alias("awaiting_writeoff"))
    stock = inventory.agg(F.count_if(F.col("qty") <= F.col("safety")).alias("low_stock_skus"))
    figures = ("pending_review", "awaiting_writeoff", "low_stock_skus", "claims_this_week")
    rows = on_claims.unionByName(queue, allowMissingColumns=True).unionByName(
        stock, allowMissingColumns=True
    )
    return rows.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in figures])


def dealer_kpis(claims: DataFrame, vehicles: DataFrame, as_of: date) -> DataFrame:
    """Per dealer: its claims under review, approved and shipped, and its active vehicles."""
    counted = {"under_review": PENDING, "approved": "Approved", "shipped": "Shipped"}
    on_claims = claims.groupBy("dealer").agg(
        *[F.count_if(F.col("status") == status).alias(name) for name, status in counted.items()]
    )
    figures = (*counted, "active_vehicles")
    rows = on_claims.unionByName(active_vehicles(vehicles, as_of), allowMissingColumns=True)
    return rows.groupBy("dealer").agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in figures])


def _monday(day: date) -> date:
    return day - timedelta(days=day.weekday())


def _within_week(monday: date) -> Column:
    return F.col("date").between(F.lit(monday), F.lit(monday + timedelta(days=6)))


def _per_week(claims: DataFrame, *aggregates: Column) -> DataFrame:
    return claims.groupBy(F.trunc("date", "week").alias("week")).agg(*aggregates)


def _newest_week(weeks: DataFrame, figure: str) -> DataFrame:
    return weeks.agg(
        F.max("week").alias("week"),
        F.coalesce(F.max_by(figure, "week"), F.lit(0)).alias(figure),
    )
