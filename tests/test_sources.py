"""Readers, API dumps, writers and the flows built on them."""

from __future__ import annotations

import json
from datetime import date

import pytest

from portal_data import VIN
from wrenchwork import operators as op, schemas, sources as src
from wrenchwork.plans import flows

TODAY = date(2026, 8, 17)

READERS = {
    "vehicles": src.read_vehicles,
    "claims": src.read_claims,
    "parts": src.read_parts,
    "inventory": src.read_inventory,
    "shipments": src.read_shipments,
    "maintenance": src.read_maintenance,
    "decisions": src.read_decisions,
    "outbound": src.read_outbound,
    "new_claims": src.read_new_claims,
}


@pytest.fixture(scope="module")
def store(portal, tmp_path_factory):
    """The small portal as parquet folders."""
    folder = tmp_path_factory.mktemp("store")
    for name in READERS:
        frame = getattr(portal, name)
        if name == "claims":
            src.write_claims(frame, f"{folder}/{name}")
        else:
            src.write_snapshot(frame, f"{folder}/{name}")
    return str(folder)


def table(frame, *names):
    return {tuple(row[n] for n in names) for row in frame.collect()}


def rows(frame):
    return sorted(map(repr, frame.collect()))


@pytest.mark.parametrize("name", sorted(READERS))
@pytest.mark.parametrize("format", ["parquet", "orc", "json"])
def test_readers_give_back_what_was_written(spark, portal, tmp_path, name, format):
    frame = getattr(portal, name)
    src.write_snapshot(frame, f"{tmp_path}/t", format)
    back = READERS[name](spark, f"{tmp_path}/t", format)
    assert back.dtypes == frame.dtypes
    assert rows(back) == rows(frame)


def test_accidents(spark, tmp_path):
    frame = spark.createDataFrame([("v", TODAY)], schemas.ACCIDENTS)
    src.append_rows(frame, f"{tmp_path}/a")
    src.append_rows(frame, f"{tmp_path}/a")
    assert src.read_accidents(spark, f"{tmp_path}/a").count() == 2


def test_claims_of_a_range_of_days(spark, store):
    got = src.read_claims(spark, f"{store}/claims", since=date(2026, 8, 10), until=date(2026, 8, 14))
    assert table(got, "no") == {("CLM-2026-0005",), ("CLM-2026-0006",)}
    assert src.read_claims(spark, f"{store}/claims", until=date(2026, 7, 31)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan
    assert "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan


def test_a_snapshot_is_never_overwritten(portal, store):
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        src.write_snapshot(portal.parts, f"{store}/parts")


def test_require_unique(portal):
    assert src.require_unique(portal.inventory, "oe") is portal.inventory
    with pytest.raises(ValueError, match="BYD-BAT-8842.* occurs 2 times"):
        src.require_unique(portal.outbound, "oe")


# API dumps


def envelope(data, success=True):
    return json.dumps({"success": success, "data": data}, ensure_ascii=False)


VEHICLE = {
    "id": 1024, "vin": VIN[1024], "brand": "BYD", "model": "Sealion 6 (海狮06)",
    "plate": "IR-88421", "dealer": "KTL", "saleDate": "2026-03-15", "warrantyStart": "2026-03-15",
    "wholeMonths": 72, "wholeKm": 150000, "evMonths": 96, "evKm": 240000,
    "status": "In Warranty", "mileage": 18400,
}


def test_dump_of_vehicles(spark, portal, tmp_path):
    (tmp_path / "a.json").write_text(envelope([VEHICLE]), encoding="utf-8")
    (tmp_path / "b.json").write_text(envelope(None))
    (tmp_path / "c.json").write_text(envelope([VEHICLE], success=False))
    got = src.read_api_dump(spark, schemas.VEHICLES, str(tmp_path))
    assert got.collect() == op.vehicle_by_id(portal.vehicles, 1024).collect()


def test_dump_of_claims_by_line(spark, tmp_path):
    claim = {"no": "C-1", "vehicle": "v", "date": "2026-08-17", "parts": [{"oe": "x", "qty": 2}]}
    lines = [envelope([claim, claim]), envelope([]), envelope(None), envelope([claim])]
    (tmp_path / "pages.json").write_text("\n".join(lines))
    got = src.read_api_dump(spark, schemas.CLAIMS, str(tmp_path), one_per_line=True)
    assert got.count() == 3
    assert table(op.claim_lines(got), "no", "oe", "qty") == {("C-1", "x", 2)}


# Flows


def test_catalogue_search(spark, store):
    assert table(flows.find_parts(spark, store, "screen"), "oe", "meta") == {
        ("BYD-SCR-3320", "Electrics / Infotainment · General (72mo)")
    }
    assert flows.find_parts(spark, store, "", "BYD").count() == 7


def test_intake_flow(spark, store, portal, tmp_path):
    flows.take_in_claims(spark, store, str(tmp_path), TODAY)
    accepted = src.read_claims(spark, f"{tmp_path}/claims")
    assert table(accepted, "no", "status") == {("N-1", "Submitted"), ("N-2", "Submitted")}
    rejects = spark.read.parquet(f"{tmp_path}/claim_rejects")
    assert table(rejects, "id") == {("N-3",), ("N-4",), ("N-5",), ("N-6",)}


def test_decision_loop(spark, store, tmp_path):
    target = str(tmp_path)
    flows.review_claims(spark, store, target)
    reviewed = src.read_claims(spark, f"{target}/claims")
    assert ("CLM-2026-0007", "Approved") in table(reviewed, "no", "status")
    assert spark.read.parquet(f"{target}/decision_log").count() == 3

    flows.write_off_claims(spark, store, target, f"{target}/day1")
    orders = spark.read.parquet(f"{target}/day1/writeoff_orders")
    requests = spark.read.parquet(f"{target}/day1/shipment_requests")
    assert table(orders, "claim") == {("CLM-2026-0006",), ("CLM-2026-0007",)}
    assert table(requests, "claim", "oe", "status") == {
        ("CLM-2026-0006", "BYD-LMP-2207", "Pending"), ("CLM-2026-0007", "BYD-BAT-8842", "Pending")
    }
    stock = op.writeoff_stock(requests, src.read_inventory(spark, f"{store}/inventory"))
    assert table(stock, "oe", "in_stock") == {("BYD-LMP-2207", True), ("BYD-BAT-8842", True)}

    flows.write_off_claims(spark, store, target, f"{target}/day2", orders)
    assert spark.read.parquet(f"{target}/day2/writeoff_orders").count() == 0

    flows.move_stock(spark, store, target)
    left = src.read_inventory(spark, f"{target}/inventory")
    assert ("SKU-3001", 1) in table(left, "sku", "qty")
    assert spark.read.parquet(f"{target}/outbound_orders").count() == 3
    assert spark.read.parquet(f"{target}/outbound_rejects").count() == 1


def test_filters_on_stored_claims_reach_the_scan(spark, store):
    claims = src.read_claims(spark, f"{store}/claims")
    plan = op.pending_review(claims)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,Under Review)" in plan
    decisions = src.read_decisions(spark, f"{store}/decisions")
    plan = op.reviewed_claims(claims, decisions)._jdf.queryExecution().executedPlan().toString()
    assert "In(status, [Submitted,Under Review])" in plan
    assert "Or(Not(In(status, [Submitted,Under Review])),IsNull(status))" in plan


def test_nested_fields_nobody_asks_for_are_not_read(spark, store, portal):
    claims = src.read_claims(spark, f"{store}/claims")
    frame = op.warranty_recommendation(
        claims, portal.vehicles, portal.parts, portal.maintenance
    )
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<no:string,parts:array<struct<oe:string>>>" in plan
    assert "ReadSchema: struct<no:string,vehicle:string,date:date,dealer:string>" in plan


def test_bodies_are_rows_or_rejects(spark, tmp_path):
    from wrenchwork import schemas
    from wrenchwork.sources import checked_bodies, read_checked_dump, rejected_bodies, rows_of_bodies

    good = '{"success":true,"data":[{"oe":"A","qty":1},{"oe":"B","qty":null,"more":[]}]}'
    bodies = {
        good: None, '{"data":[],"success":true}': None,
        "null": "wrong type", "1": "wrong type", '"x"': "wrong type", "{": "not JSON", "<html>": "not JSON",
        '{"success":"yes","data":[]}': "wrong type", '{"success":true,"data":{}}': "wrong type",
        '{"success":true,"data":[{"oe":"A","qty":"1"}]}': "wrong type",
        '{"success":true,"data":[{"oe":"A","qty":1.5}]}': "wrong type",
        '{"success":true,"data":[{"oe":"A","qty":99999999999}]}': "wrong type",
        '{"success":true}': "no data", '{"success":null,"data":[]}': "not successful", "{}": "not successful",
    }
    frame = spark.createDataFrame([(k, b) for k, b in enumerate([*bodies, None, "", " \t"])], "id int, body string")
    schema = schemas.CLAIM_PART
    checked = checked_bodies(frame, schema)
    found = {r.body: r.reason for r in rejected_bodies(checked).collect()}
    expected = {b: r for b, r in bodies.items() if r} | {None: "no body", "": "no body", " \t": "no body"}
    assert found == expected
    assert sorted(rows_of_bodies(checked, schema).collect()) == [("A", 1), ("B", None)]
    (tmp_path / "dump.txt").write_text("\n".join([*bodies, "", "  "]))
    rows, rejects = read_checked_dump(spark, schema, str(tmp_path / "dump.txt"))
    assert rows.count() == 2 and rejects.count() == sum(r is not None for r in bodies.values())
