"""Fixed schemas and vocabularies of the after-sales data model.

Keys are ``vehicles.vin``, ``vehicles.id``, ``claims.no``, ``parts.oe`` and
``inventory.sku``; each is unique in its table.
"""

from __future__ import annotations

from pyspark.sql import types as T

STRING = T.StringType()
INT = T.IntegerType()
LONG = T.LongType()
DATE = T.DateType()
TIMESTAMP = T.TimestampType()
BOOLEAN = T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


CLAIM_PART = _struct(oe=STRING, qty=INT)
CLAIM_ITEM = _struct(oe_no=STRING, qty=INT)

VEHICLES = _struct(
    id=LONG, vin=STRING, brand=STRING, model=STRING, plate=STRING, dealer=STRING,
    sale_date=DATE, warranty_start=DATE, whole_months=INT, whole_km=INT,
    ev_months=INT, ev_km=INT, status=STRING, mileage=INT,
)
CLAIMS = _struct(
    no=STRING, vehicle=STRING, model=STRING, fault=STRING, status=STRING, date=DATE,
    parts=T.ArrayType(CLAIM_PART), diagnosis=STRING, dealer=STRING,
)
PARTS = _struct(
    oe=STRING, name=STRING, cat=STRING, models=T.ArrayType(STRING),
    warranty=STRING, wear=BOOLEAN, brand=STRING,
)
INVENTORY = _struct(sku=STRING, oe=STRING, name=STRING, qty=INT, location=STRING, safety=INT)
SHIPMENTS = _struct(
    no=STRING, claim=STRING, part=STRING, qty=INT, carrier=STRING,
    tracking=STRING, status=STRING, eta=DATE,
)
MAINTENANCE = _struct(vin=STRING, date=DATE, km=INT, title=STRING)
ACCIDENTS = _struct(vin=STRING, date=DATE)
DECISIONS = _struct(claim=STRING, decision=STRING, note=STRING, decided_at=TIMESTAMP)
OUTBOUND = _struct(order_id=STRING, oe=STRING, qty=INT, at=TIMESTAMP)
WRITEOFF_ORDERS = _struct(
    claim=STRING, vehicle=STRING, model=STRING, settlement=STRING, parts=LONG, qty=LONG,
)
NEW_CLAIMS = _struct(
    id=STRING, vehicle_id=LONG, fault_desc=STRING, diagnosis=STRING,
    items=T.ArrayType(CLAIM_ITEM),
)


def with_batch(schema: T.StructType) -> T.StructType:
    """The schema of a table that lies in one folder per batch."""
    return T.StructType([*schema.fields, T.StructField("batch", STRING)])


# The body a claim form posts; a form field always sends text, so the id is text.
CLAIM_PAYLOAD = _struct(
    vehicle_id=STRING, fault_desc=STRING, diagnosis=STRING, items=T.ArrayType(CLAIM_ITEM),
)

# Names the web API uses where they differ from ours (fixed values).
API_NAMES = {
    "sale_date": "saleDate",
    "warranty_start": "warrantyStart",
    "whole_months": "wholeMonths",
    "whole_km": "wholeKm",
    "ev_months": "evMonths",
    "ev_km": "evKm",
}

# Vocabularies (fixed values).
CLAIM_STATUSES = (
    "Draft", "Submitted", "Under Review", "Approved", "Partial", "Rejected", "Shipped", "Closed",
)
SHIPMENT_STATUSES = ("In Transit", "Delivered", "Pending")
DECISION_VALUES = ("Approved", "Partial", "Rejected")
WARRANTY_CLASSES = ("EV Core", "General", "Wear Item")

REVIEWABLE = ("Submitted", "Under Review")
WRITE_OFF = ("Approved", "Partial")

OK, WARN, BAD = "ok", "warn", "bad"
