"""The page of a vehicle: rows worked out by hand, and plans on tables stored by VIN."""

from __future__ import annotations

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from portal_data import VIN
from wrenchwork import operators as op, sources as src
from wrenchwork.plans.tables import AS_OF, Tables


def test_page_of_one(portal):
    one = op.vehicle_by_id(portal.vehicles, 1024)
    rows = op.vehicle_page(one, portal.maintenance, portal.claims, date(2026, 8, 20)).collect()
    assert {r.vin for r in rows} == {VIN[1024]}
    found = {(r.section, r.day, r.title, r.detail) for r in rows}
    assert len(found) == len(rows) == 8
    assert ("profile", None, "BYD Sealion 6 (海狮06)", "Plate IR-88421 · Sold 2026-03-15 · 18,400 km") in found
    assert ("cover", date(2026, 3, 15), "Whole Vehicle", "72 months / 150,000 km · In Warranty") in found
    assert ("service", date(2026, 3, 15), "Delivery / PDI completed", "2026-03-15 · 0 km") in found
    assert ("claim", date(2026, 8, 5), "CLM-2026-0004", "Infotainment screen flicker · Shipped") in found


def test_unknown_and_none(spark, portal):
    bare = portal.vehicles.filter("id = 1025").withColumns(
        {"plate": F.lit(None).cast("string"), "sale_date": F.lit(None).cast("date"), "mileage": F.lit(None).cast("int")}
    )
    rows = op.vehicle_page(bare, portal.maintenance.limit(0), portal.claims.limit(0), date(2026, 8, 20)).collect()
    assert [(r.title, r.detail) for r in rows if r.section == "claim"] == [("No claims", None)]
    assert [r.detail for r in rows if r.section == "profile"] == [None]
    assert op.vehicle_page(bare.limit(0), portal.maintenance, portal.claims, date(2026, 8, 20)).isEmpty()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    t, folder = Tables(spark, "/root/testdata/sf0.01"), tmp_path_factory.mktemp("by_vin")
    frames = {
        "page_vehicles": (t.vehicles().withColumn("sale_date", F.col("warranty_start")), "vin"),
        "page_services": (t.maintenance(), "vin"),
        "page_claims": (t.claims(), "vehicle"),
    }
    for name, (frame, vin) in frames.items():
        src.write_by_vin(frame, name, vin, 16, str(folder / name))
    yield t, [src.by_vin(spark, name) for name in frames]
    for name in frames:
        spark.sql(f"drop table {name}")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def bucketed_scans(spark):
    """Scans stay in buckets, also where no join needs it; else a plan does not tell what is pruned."""
    name = "spark.sql.sources.bucketing.autoBucketedScan.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def test_one_bucket_of_each_table(spark, stored, bucketed_scans):
    t, (vehicles, services, claims) = stored
    vin = t.vehicles().filter("id = 1024").first()["vin"]
    page = op.vehicle_page(vehicles.filter(F.col("vin") == vin), services, claims, AS_OF)
    text = plan_of(page)
    assert "Exchange hash" not in text and "Exchange range" not in text
    scans = re.findall(r"SelectedBucketsCount: (\d+) out of 16", text)
    assert len(scans) == text.count("FileScan") and set(scans) == {"1"}
    plain = op.vehicle_page(op.vehicle_by_id(t.vehicles().withColumn("sale_date", F.col("warranty_start")), 1024), t.maintenance(), t.claims(), AS_OF)
    assert sorted(map(str, page.collect())) == sorted(map(str, plain.collect())) and page.count() > 4


def test_pages_of_a_fleet_shuffle_nothing(spark, stored):
    t, (vehicles, services, claims) = stored
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pages = op.vehicle_page(vehicles, services, claims, AS_OF)
        assert "Exchange" not in plan_of(pages)
        expected = op.vehicle_page(t.vehicles().withColumn("sale_date", F.col("warranty_start")), t.maintenance(), t.claims(), AS_OF)
        assert sorted(map(str, pages.collect())) == sorted(map(str, expected.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
