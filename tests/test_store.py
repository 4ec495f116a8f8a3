"""The flows over one store: versions of the claims, batches that die and come again."""

from __future__ import annotations

import os
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from portal_data import CLAIMS, NEW_CLAIMS, VIN
from wrenchwork import operators as op, schemas, sources as src
from wrenchwork.plans import flows
from wrenchwork.sources import versions

DAY = date(2026, 8, 20)
FORMS = [
    *NEW_CLAIMS,
    ("CLM-2026-0006", 1025, "Number in use", None, []),
    (None, 1025, "No number", None, []),
    (None, 1025, "No number either", None, []),
    ("N-7", 1024, "Screen dark", None, [("BYD-SCR-3320", 1), ("BYD-SCR-3320", 2)]),
    ("N-8", 1024, "Twice", None, []), ("N-8", 1024, "Twice", None, []),
]
DECISIONS = [
    ("CLM-2026-0007", "Approved", "all ok", datetime(2026, 8, 21, 9)),
    ("N-7", "Approved", "all ok", datetime(2026, 8, 21, 9)),
    ("N-1", "Rejected", "", datetime(2026, 8, 21, 9)),
    ("CLM-2026-0005", "Approved", "too late", datetime(2026, 8, 21, 9)),
]


@pytest.fixture
def store(spark, portal, tmp_path):
    source, store = f"{tmp_path}/source", f"{tmp_path}/store"
    src.write_claims(portal.claims, f"{source}/claims")
    for name in ("vehicles", "parts", "shipments"):
        src.write_snapshot(getattr(portal, name), f"{source}/{name}")
    flows.open_store(spark, source, store)
    spark.createDataFrame(FORMS, schemas.NEW_CLAIMS).write.parquet(f"{store}/inbox/new_claims/b1")
    spark.createDataFrame(DECISIONS, schemas.DECISIONS).write.parquet(f"{store}/inbox/decisions/b2")
    return store


def run_all(spark, store):
    flows.take_in_batch(spark, store, "b1", DAY)
    flows.review_batch(spark, store, "b2")
    flows.ship_batch(spark, store, "b3")


def state(spark, store):
    """Rows of every table of the store, whatever the files."""
    out = {
        "claims": Counter(map(str, flows.claims_now(spark, store).collect())),
        "partials": Counter(map(str, flows.claim_partials_now(spark, store).collect())),
    }
    for name in ("claim_rejects", "decision_log", "decision_rejects", "writeoff_orders", "shipments"):
        if os.path.isdir(f"{store}/{name}"):
            out[name] = Counter(map(str, spark.read.parquet(f"{store}/{name}").collect()))
    return out


def status(spark, store):
    rows = flows.claims_now(spark, store).collect()
    assert len({r.no for r in rows}) == len(rows)
    return {r.no: r.status for r in rows}


def test_all_flows_from_one_store(spark, store):
    before = {c[0]: c[4] for c in CLAIMS}
    assert status(spark, store) == before
    flows.take_in_batch(spark, store, "b1", DAY)
    taken = status(spark, store)
    assert taken == before | {"N-1": "Submitted", "N-2": "Submitted", "N-7": "Submitted"}
    rejects = spark.read.parquet(f"{store}/claim_rejects")
    reasons = Counter((r.id, r.reason) for r in rejects.collect())
    assert reasons[("CLM-2026-0006", "number taken")] == 1 and reasons[("N-8", "number taken")] == 2
    assert reasons[(None, "no number")] == 2
    assert rejects.count() + 3 == len(FORMS)
    flows.review_batch(spark, store, "b2")
    reviewed = status(spark, store)
    assert reviewed == taken | {"CLM-2026-0007": "Approved", "N-7": "Approved"}
    flows.ship_batch(spark, store, "b3")
    assert status(spark, store) == reviewed | {"CLM-2026-0007": "Shipped", "N-7": "Shipped", "CLM-2026-0006": "Shipped"}
    new = spark.read.parquet(f"{store}/shipments").filter("batch = 'b3'").collect()
    assert {(r.no, r.claim, r.qty, r.status) for r in new} == {
        ("SHP-CLM-2026-0007/BYD-BAT-8842", "CLM-2026-0007", 1, "Pending"),
        ("SHP-CLM-2026-0006/BYD-LMP-2207", "CLM-2026-0006", 1, "Pending"),
        ("SHP-N-7/BYD-SCR-3320", "N-7", 3, "Pending"),
    }
    assert not any(c.parts is None for c in flows.claims_now(spark, store).filter("no = 'N-7'").collect())
    # Nothing waits any more.
    flows.ship_batch(spark, store, "b4")
    assert src.newest_version(spark, f"{store}/claims").batch == "b3"


def test_partials_follow_the_claims(spark, store):
    """After every batch the counts kept are those of all claims; nothing else is read for the figures."""
    def check():
        shipments = spark.read.parquet(f"{store}/shipments/batch=*")
        expected = op.claim_partials(flows.claims_now(spark, store), shipments)
        found = flows.claim_partials_now(spark, store)
        assert sorted(map(str, found.collect())) == sorted(map(str, expected.select(found.columns).collect()))

    check()
    flows.take_in_batch(spark, store, "b1", DAY)
    check()
    flows.review_batch(spark, store, "b2")
    check()
    flows.ship_batch(spark, store, "b3")
    check()


def test_done_batches_do_nothing(spark, store):
    run_all(spark, store)
    before, version = state(spark, store), src.newest_version(spark, f"{store}/claims")
    run_all(spark, store)
    assert state(spark, store) == before and src.newest_version(spark, f"{store}/claims") == version


@pytest.mark.parametrize("dies_at", ["write", "commit"])
def test_a_batch_that_died_is_run_again(spark, store, tmp_path, monkeypatch, dies_at):
    """Each batch dies once, before it writes the new rows or before it commits them."""
    files = tmp_path / "whole"
    source = f"{tmp_path}/source"
    flows.open_store(spark, source, str(files))
    for box, batch in (("new_claims", "b1"), ("decisions", "b2")):
        spark.read.parquet(f"{store}/inbox/{box}/{batch}").write.parquet(f"{files}/inbox/{box}/{batch}")
    run_all(spark, str(files))

    class Died(Exception):
        pass

    def die(*_):
        raise Died

    name = {"write": "_folder_name", "commit": "_commit"}[dies_at]
    for run in (
        lambda: flows.take_in_batch(spark, store, "b1", DAY),
        lambda: flows.review_batch(spark, store, "b2"),
        lambda: flows.ship_batch(spark, store, "b3"),
    ):
        before, claims = src.newest_version(spark, f"{store}/claims"), status(spark, store)
        with monkeypatch.context() as patch:
            patch.setattr(versions, name, die)
            with pytest.raises(Died):
                run()
        assert src.newest_version(spark, f"{store}/claims") == before and status(spark, store) == claims
        run()
    assert state(spark, store) == state(spark, str(files))


def test_only_touched_months_are_written(spark, tmp_path):
    folder = f"{tmp_path}/claims"
    rows = [(f"C-{m}-{i}", VIN[1024], "M", "f", "Submitted", date(2026, m, 3 + i), None, None, "KTL")
            for m in range(1, 7) for i in range(3)]
    rows.append(("C-none", VIN[1024], "M", "f", "Submitted", None, None, None, "KTL"))
    first = src.merge_claims(spark, folder, spark.createDataFrame(rows, schemas.CLAIMS), "start")
    assert len(first.months) == 7 and set(first.months.values()) == {"00000000-start"}
    changed = [(r[0], *r[1:4], "Approved", *r[5:]) for r in rows if r[0] in ("C-2-1", "C-none")]
    new = ("C-new", VIN[1024], "M", "f", "Draft", date(2026, 9, 1), None, None, "KTL")
    second = src.merge_claims(spark, folder, spark.createDataFrame([*changed, new], schemas.CLAIMS), "next")
    moved = {m for m, s in second.months.items() if s == "00000001-next"}
    assert moved == {"2026-02-01", "2026-09-01", versions.NO_MONTH} and second.number == 1
    assert {m: s for m, s in second.months.items() if m not in moved} == {
        m: s for m, s in first.months.items() if m not in moved
    }
    written = {f for _, dirs, _ in os.walk(f"{folder}/snapshot=00000001-next") for f in dirs}
    assert written == {f"month={m}" for m in moved}
    now = {r.no: r.status for r in src.read_version(spark, folder, second).collect()}
    expected = {r[0]: r[4] for r in rows} | {"C-2-1": "Approved", "C-none": "Approved", "C-new": "Draft"}
    assert now == expected
    old = {r.no: r.status for r in src.read_version(spark, folder, first).collect()}
    assert old == {r[0]: r[4] for r in rows}
    part = src.read_version(spark, folder, second, date(2026, 2, 4), date(2026, 3, 4))
    assert {r.no for r in part.collect()} == {"C-2-1", "C-2-2", "C-3-0", "C-3-1"}
    assert len(part.inputFiles()) == 2
    assert src.merge_claims(spark, folder, spark.createDataFrame([], schemas.CLAIMS), "nothing") == second


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two batches that started from the same version one has to start again."""
    folder = f"{tmp_path}/claims"
    row = lambda no: spark.createDataFrame([(no, VIN[1024], "M", "f", "Draft", DAY, None, None, "KTL")], schemas.CLAIMS)
    first = src.merge_claims(spark, folder, row("A"), "a")
    newest = versions.newest_version
    src.merge_claims(spark, folder, row("B"), "b")
    with monkeypatch.context() as patch:
        patch.setattr(versions, "newest_version", lambda *_: first)
        with pytest.raises(src.VersionTaken):
            src.merge_claims(spark, folder, row("C"), "c")
    assert {r.no for r in src.read_version(spark, folder, newest(spark, folder)).collect()} == {"A", "B"}
    src.merge_claims(spark, folder, row("C"), "c")
    assert {r.no for r in src.read_version(spark, folder, newest(spark, folder)).collect()} == {"A", "B", "C"}
    assert src.is_done(spark, folder, "c") and not src.is_done(spark, folder, "d")
    with pytest.raises(ValueError):
        src.is_done(spark, folder, "a/b")


def test_booking_twice_changes_nothing(spark, portal):
    requests = spark.createDataFrame(
        [("C-1", "P-1", "Lamp", 1, "Pending"), ("C-1", "P-1", "Lamp", 2, "Pending"), ("C-2", "P-1", "Lamp", 1, "Pending")],
        "claim string, oe string, part string, qty int, status string",
    )
    once = op.booked_shipments(requests, portal.shipments.limit(0))
    assert {(r.no, r.qty) for r in once.collect()} == {("SHP-C-1/P-1", 3), ("SHP-C-2/P-1", 1)}
    assert op.booked_shipments(requests, once).isEmpty()
    assert op.booked_shipments(requests.limit(0), once).isEmpty()


def test_merge_keeps_claims_without_number(spark):
    claims = spark.createDataFrame([("a", 1), (None, 2), ("b", 3)], "no string, v int")
    changed = spark.createDataFrame([("b", 4), ("c", 5)], "no string, v int")
    assert sorted(r.v for r in op.merged_claims(claims, changed).collect()) == [1, 2, 4, 5]
