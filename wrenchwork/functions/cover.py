"""Warranty class of a part label and the test whether a cover is in force."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, functions as F

from ..schemas import WARRANTY_CLASSES
from .base import as_column


def warranty_class(label: Column | str) -> Column:
    """``EV Core (96mo)`` gives ``EV Core``; a label of no known class gives null."""
    found = F.regexp_extract(as_column(label), f"^({'|'.join(WARRANTY_CLASSES)})", 1)
    return F.nullif(found, F.lit(""))


def label_months(label: Column | str) -> Column:
    """``EV Core (96mo)`` gives 96; a label without months gives null.

    Shown only: the terms of the vehicle rule, not those of the label.
    """
    return F.regexp_extract(as_column(label), r"\((\d+)mo\)", 1).try_cast("int")


def cover_end(start: Column | str, months: Column | str) -> Column:
    return F.add_months(as_column(start), as_column(months))


def in_cover(on: Column | str | date, terms: str) -> Column:
    """Is the ``whole`` or ``ev`` cover in force on a day at the present mileage?

    Both ends of the term and the kilometre limit are inclusive. Missing
    vehicle data means no cover. Reads the columns ``warranty_start``,
    ``mileage``, ``<terms>_months`` and ``<terms>_km``.
    """
    day = F.lit(on) if isinstance(on, date) else as_column(on)
    in_term = day.between(F.col("warranty_start"), cover_end("warranty_start", f"{terms}_months"))
    in_km = F.col("mileage") <= F.col(f"{terms}_km")
    return F.coalesce(in_term & in_km, F.lit(False))
