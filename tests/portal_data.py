"""A small portal: the rows of FIXTURES.md (fixed values) as frames."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import SparkSession

from wrenchwork import schemas

VEHICLES = [
    (1024, "LGXCE4CC0N0123456", "BYD", "Sealion 6 (海狮06)", "IR-88421", "KTL",
     date(2026, 3, 15), date(2026, 3, 15), 72, 150000, 96, 240000, "In Warranty", 18400),
    (1025, "LGXCE4CC0N0654321", "BYD", "Sealion 7 (海狮07)", "IR-90337", "KTL",
     date(2026, 5, 2), date(2026, 5, 2), 72, 150000, 96, 240000, "In Warranty", 9200),
    (2033, "LFV3B2F55P7010203", "LEAP", "Leapmotor C10", "UAE-55129", "AvaMotor",
     date(2025, 11, 20), date(2025, 11, 20), 60, 120000, 96, 200000, "In Warranty", 31000),
]
VIN = {row[0]: row[1] for row in VEHICLES}

CLAIMS = [
    ("CLM-2026-0007", VIN[1024], "Sealion 6", "Battery pack failure, cannot charge",
     "Under Review", date(2026, 8, 17), [("BYD-BAT-8842", 1)], "Error code BMS-0x07", "KTL"),
    ("CLM-2026-0006", VIN[1025], "Sealion 7", "Rear tail light crack (transport)",
     "Approved", date(2026, 8, 14), [("BYD-LMP-2207", 1)], None, "KTL"),
    ("CLM-2026-0005", VIN[2033], "C10", "Brake pad wear (normal)",
     "Rejected", date(2026, 8, 10), [("LEAP-BRK-1011", 4)], None, "AvaMotor"),
    ("CLM-2026-0004", VIN[1024], "Sealion 6", "Infotainment screen flicker",
     "Shipped", date(2026, 8, 5), [("BYD-SCR-3320", 1)], None, "KTL"),
]

PARTS = [
    ("BYD-BAT-8842", "Battery Pack Assembly (LFP, 71.8kWh)", "Powertrain / Battery",
     ["Sealion 6"], "EV Core (96mo)", False, "BYD"),
    ("BYD-BAT-8850", "Battery Pack Assembly (LFP, 91kWh)", "Powertrain / Battery",
     ["Sealion 7"], "EV Core (96mo)", False, "BYD"),
    ("BYD-BMS-7710", "BMS Controller Module", "Powertrain / Battery",
     ["Sealion 6", "Sealion 7"], "EV Core (96mo)", False, "BYD"),
    ("BYD-MTR-5501", "Front Drive Motor", "Powertrain / E-Drive",
     ["Sealion 6"], "EV Core (96mo)", False, "BYD"),
    ("BYD-LMP-2207", "Rear Tail Light (LED)", "Body / Lighting",
     ["Sealion 7"], "General (72mo)", False, "BYD"),
    ("BYD-SCR-3320", "Center Infotainment Screen", "Electrics / Infotainment",
     ["Sealion 6", "Sealion 7"], "General (72mo)", False, "BYD"),
    ("LEAP-BRK-1011", "Front Brake Pad Set", "Chassis / Brake",
     ["C10"], "Wear Item", True, "LEAP"),
    ("BYD-WPR-1180", "Wiper Blade Set", "Wear Items", ["Sealion 6"], "Wear Item", True, "BYD"),
]

INVENTORY = [
    ("SKU-3001", "BYD-BAT-8842", "Battery Pack (71.8kWh)", 3, "WH-A-01", 2),
    ("SKU-3002", "BYD-LMP-2207", "Rear Tail Light (LED)", 12, "WH-B-03", 5),
    ("SKU-3003", "BYD-SCR-3320", "Infotainment Screen", 1, "WH-A-05", 3),
    ("SKU-3004", "LEAP-BRK-1011", "Brake Pad Set", 40, "WH-C-01", 10),
]

SHIPMENTS = [
    ("SHP-2026-0102", "CLM-2026-0004", "Infotainment Screen", 1, "DHL", "DHL-8842100",
     "In Transit", date(2026, 8, 24)),
]

MAINTENANCE = [
    (VIN[1024], date(2026, 8, 2), 18200, "Routine maintenance (first service)"),
    (VIN[1024], date(2026, 6, 10), 11500, "Software update & inspection"),
    (VIN[1024], date(2026, 3, 15), 0, "Delivery / PDI completed"),
]

# Log rows of our own making, with each case the operators tell apart.
DECISIONS = [
    ("CLM-2026-0007", "Partial", "only one pack", datetime(2026, 8, 18, 9)),
    ("CLM-2026-0007", "Approved", "all marks ok", datetime(2026, 8, 18, 10)),
    ("CLM-2026-0007", "Rejected", "", datetime(2026, 8, 18, 11)),
    ("CLM-2026-0005", "Approved", "too late", datetime(2026, 8, 18, 9)),
    ("CLM-2026-9999", "Approved", "no such claim", datetime(2026, 8, 18, 9)),
]

OUTBOUND = [
    ("O-1", "BYD-BAT-8842", 1, datetime(2026, 8, 18, 9)),
    ("O-2", "BYD-BAT-8842", 1, datetime(2026, 8, 18, 10)),
    ("O-3", "BYD-SCR-3320", 2, datetime(2026, 8, 18, 11)),
    ("O-4", "NO-SUCH-PART", 1, datetime(2026, 8, 18, 12)),
]

NEW_CLAIMS = [
    ("N-1", 1025, "Motor noise", "rattles", [("BYD-MTR-5501", 1), ("BYD-WPR-1180", 1)]),
    ("N-2", 2033, " ", None, []),
    ("N-3", None, "No vehicle", None, []),
    ("N-4", 1024, "", None, [("BYD-BAT-8842", 1)]),
    ("N-5", 1024, None, None, []),
    ("N-6", 77, "Unknown vehicle", None, []),
]


class Portal:
    def __init__(self, spark: SparkSession) -> None:
        make = spark.createDataFrame
        self.vehicles = make(VEHICLES, schemas.VEHICLES)
        self.claims = make(CLAIMS, schemas.CLAIMS)
        self.parts = make(PARTS, schemas.PARTS)
        self.inventory = make(INVENTORY, schemas.INVENTORY)
        self.shipments = make(SHIPMENTS, schemas.SHIPMENTS)
        self.maintenance = make(MAINTENANCE, schemas.MAINTENANCE)
        self.decisions = make(DECISIONS, schemas.DECISIONS)
        self.outbound = make(OUTBOUND, schemas.OUTBOUND)
        self.new_claims = make(NEW_CLAIMS, schemas.NEW_CLAIMS)
