"""Display class of a status."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .base import as_column

# Badge class per claim and shipment status (fixed values).
STATUS_CLASSES = {
    "Draft": "b-gray",
    "Submitted": "b-blue",
    "Under Review": "b-amber",
    "Approved": "b-green",
    "Partial": "b-teal",
    "Rejected": "b-red",
    "Shipped": "b-indigo",
    "Closed": "b-gray",
    "In Transit": "b-blue",
    "Delivered": "b-green",
    "Pending": "b-amber",
}
DEFAULT_CLASS = "b-gray"


def status_class(column: Column | str) -> Column:
    """Badge class of a status; unknown and null statuses get the default."""
    status = as_column(column)
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(STATUS_CLASSES.items())])
    return F.coalesce(F.element_at(lookup, status), F.lit(DEFAULT_CLASS))
