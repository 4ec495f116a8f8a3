"""Searches and filters of the portal.

An empty search text or filter value selects everything, and its predicate is
then left out of the plan.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, functions as F

from ..functions.text import contains_text


def search(df: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows that hold the query in one of the columns."""
    if not query:
        return df
    return df.filter(reduce(or_, [contains_text(c, query) for c in columns]))


def search_vehicles(vehicles: DataFrame, query: str) -> DataFrame:
    return search(vehicles, query, "vin", "plate")


def search_claims(claims: DataFrame, query: str) -> DataFrame:
    return search(claims, query, "no", "vehicle")


def search_inventory(inventory: DataFrame, query: str) -> DataFrame:
    return search(inventory, query, "sku", "oe")


def search_parts(parts: DataFrame, query: str, brand: str = "") -> DataFrame:
    """Search in OE number and name, within a brand; the brand is case-sensitive."""
    if brand:
        parts = parts.filter(F.col("brand") == brand)
    return search(parts, query, "oe", "name")


def filter_claims(claims: DataFrame, status: str = "") -> DataFrame:
    return claims.filter(F.col("status") == status) if status else claims


def pending_review(claims: DataFrame) -> DataFrame:
    return filter_claims(claims, "Under Review")


def low_stock(inventory: DataFrame) -> DataFrame:
    """Articles whose quantity is at or below the safety quantity."""
    return inventory.filter(F.col("qty") <= F.col("safety"))


def dealer_scope(df: DataFrame, dealer: str) -> DataFrame:
    """Rows of one dealer, of any table with a ``dealer`` column."""
    return df.filter(F.col("dealer") == dealer)
