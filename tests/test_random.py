"""Operators on random small tables, with nulls and oddities, against plain Python."""

from __future__ import annotations

import random
from calendar import monthrange
from collections import Counter
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wrenchwork import operators as op, schemas
from wrenchwork.functions.text import contains_text, escape_html

SIGNS = "aAbBzZ019 _%&<>\"'\\/-#.*"
FIRST_DAY = date(2026, 1, 31)


def add_months(day, months):
    years, month = divmod(day.month - 1 + months, 12)
    year, month = day.year + years, month + 1
    return date(year, month, min(day.day, monthrange(year, month)[1]))


@pytest.fixture(scope="module", params=range(3))
def rng(request):
    return random.Random(request.param)


def maybe(rng, value, share=0.1):
    return None if rng.random() < share else value


def some_day(rng, span=120):
    return FIRST_DAY + timedelta(days=rng.randrange(span))


@pytest.fixture(scope="module")
def world(spark, rng):
    """Random rows of every table, as tuples in the order of the schema."""
    dealers = ["D1", "D2", "D3"]
    vehicles = [
        (
            n, f"V{n}", "b", "m", f"P{n}", maybe(rng, rng.choice(dealers)), None,
            maybe(rng, some_day(rng, 40)), rng.choice([1, 2, 3]), 100, rng.choice([2, 3, 4]), 200,
            None, maybe(rng, rng.choice([50, 100, 101, 200, 201])),
        )
        for n in range(30)
    ]
    labels = ["EV Core (96mo)", "General (72mo)", "Wear Item", "EV", "", None]
    parts = [
        (f"O{n}", f"part {n}", "c", ["m"], rng.choice(labels), maybe(rng, rng.random() < 0.3), "b")
        for n in range(25)
    ]
    claims = [
        (
            f"C{n}", maybe(rng, f"V{rng.randrange(34)}"), "m", "f",
            maybe(rng, rng.choice(schemas.CLAIM_STATUSES), 0.05), maybe(rng, some_day(rng)),
            maybe(rng, [(f"O{rng.randrange(28)}", rng.randrange(1, 4))
                        for _ in range(rng.randrange(4))]),
            None, maybe(rng, rng.choice(dealers)),
        )
        for n in range(400)
    ]
    titles = ["First Service", "Routine maintenance (first service)", "inspection", None]
    maintenance = [
        (maybe(rng, f"V{rng.randrange(34)}"), maybe(rng, some_day(rng)), 1, rng.choice(titles))
        for _ in range(60)
    ]
    accidents = [(maybe(rng, f"V{rng.randrange(34)}"), maybe(rng, some_day(rng)))
                 for _ in range(12)]
    shipments = [
        (f"S{n}", maybe(rng, f"C{rng.randrange(400)}"), "p", 1, "c", "t", "Pending", None)
        for n in range(150)
    ]
    decisions = [
        (
            f"C{rng.randrange(420)}", rng.choice(schemas.DECISION_VALUES),
            rng.choice(["", " ", "note", None]),
            datetime(2026, 6, 1) + timedelta(hours=rng.randrange(5)),
        )
        for _ in range(300)
    ]
    return {
        "vehicles": vehicles, "parts": parts, "claims": claims, "maintenance": maintenance,
        "accidents": accidents, "shipments": shipments, "decisions": decisions,
    }


@pytest.fixture(scope="module")
def frames(spark, world):
    return {
        name: spark.createDataFrame(rows, getattr(schemas, name.upper()))
        for name, rows in world.items()
    }


def brute_checks(world):
    """Marks per claim, and per claimed part ``(term, wear)``, by loops."""
    vehicles = {v[1]: v for v in world["vehicles"]}
    parts = {p[0]: p for p in world["parts"]}
    result = {}
    for no, vin, _, _, status, day, items, _, dealer in world["claims"]:
        v = vehicles.get(vin)
        identity = "ok" if v and v[5] is not None and v[5] == dealer else "bad"

        def covered(months, km):
            start, mileage = v[7], v[13]
            if None in (start, mileage, day):
                return False
            return start <= day <= add_months(start, months) and mileage <= km

        marks = []
        for oe, _ in items or []:
            part = parts.get(oe)
            label = (part and part[4]) or ""
            term = False
            if v and label.startswith("EV Core"):
                term = covered(v[10], v[11])
            elif v and label.startswith(("General", "Wear Item")):
                term = covered(v[8], v[9])
            fit = part is not None and part[5] is False
            marks.append((oe, "ok" if term else "bad", "ok" if fit else "bad"))
        served = any(
            m[0] == vin and None not in (m[0], m[1], day) and m[1] <= day
            and "first service" in (m[3] or "").lower()
            for m in world["maintenance"]
        )
        crashed = any(
            a[0] == vin and None not in (a[0], a[1], day) and a[1] <= day
            for a in world["accidents"]
        )
        result[no] = (
            status, identity, "warn" if crashed else "ok", "ok" if served else "warn", marks
        )
    return result


def test_check_and_recommendation(frames, world):
    arguments = [frames[n] for n in ("claims", "vehicles", "parts", "maintenance", "accidents")]
    expected_rows, expected = Counter(), {}
    for no, (_, identity, accident, service, marks) in brute_checks(world).items():
        for oe, term, wear in marks or [(None, None, None)]:
            expected_rows[(no, oe, identity, term, wear, accident, service)] += 1
        passing = sum(term == wear == "ok" for _, term, wear in marks)
        if identity == "bad" or (marks and not passing):
            verdict = "Reject"
        elif passing < len(marks):
            verdict = "Partial"
        elif not marks or "warn" in (accident, service):
            verdict = "Manual"
        else:
            verdict = "Approve"
        expected[no] = (len(marks), passing, verdict)
    rows = op.warranty_check(*arguments).select(
        "no", "oe", "identity", "term", "wear", "accident", "service"
    )
    assert Counter(tuple(r) for r in rows.collect()) == expected_rows
    got = op.warranty_recommendation(*arguments).collect()
    assert {r["no"]: tuple(r)[1:] for r in got} == expected
    assert len(got) == len(expected)
    assert set(v for _, _, v in expected.values()) >= {"Reject", "Manual", "Partial"}


def test_write_off(frames, world):
    queue = op.awaiting_writeoff(frames["claims"], frames["shipments"])
    shipped = {s[1] for s in world["shipments"]}
    checks = brute_checks(world)
    waiting = {
        no for no, c in checks.items() if c[0] in ("Approved", "Partial") and no not in shipped
    }
    assert {r["no"] for r in queue.collect()} == waiting
    orders, requests = op.write_off(
        queue, op.part_checks(queue, frames["vehicles"], frames["parts"])
    )
    quantities = {c[0]: c[6] or [] for c in world["claims"]}
    expected = Counter()
    totals = {}
    for no in waiting:
        sent = [
            (no, oe, qty)
            for (oe, term, wear), (_, qty) in zip(checks[no][4], quantities[no], strict=True)
            if checks[no][0] == "Approved" or term == wear == "ok"
        ]
        expected.update(sent)
        totals[no] = (len(sent), sum(qty for _, _, qty in sent))
    assert Counter(tuple(r) for r in requests.select("claim", "oe", "qty").collect()) == expected
    assert {r["claim"]: (r["parts"], r["qty"]) for r in orders.collect()} == totals


def test_decisions(frames, world):
    after, log, rejects = op.apply_decisions(frames["claims"], frames["decisions"])
    statuses = {c[0]: c[4] for c in world["claims"]}
    valid = [d for d in world["decisions"] if d[2] and d[0] in statuses]
    for claim, decision, _, _ in sorted(valid, key=lambda d: (d[3], d[1])):
        if dict((c[0], c[4]) for c in world["claims"])[claim] in schemas.REVIEWABLE:
            statuses[claim] = decision
    assert {r["no"]: r["status"] for r in after.collect()} == statuses
    assert Counter(tuple(r) for r in log.collect()) == Counter(valid)
    assert rejects.count() == len(world["decisions"]) - len(valid)


def test_related_claims(frames, world):
    expected = Counter()
    for v in world["vehicles"]:
        mine = [c[0] for c in world["claims"] if c[1] == v[1]]
        expected.update((v[1], no) for no in mine or ["No claims"])
    got = op.related_claims(frames["vehicles"], frames["claims"]).collect()
    assert Counter((r["vin"], r["claim"]) for r in got) == expected


def test_weeks(frames, world):
    days = [c[5] for c in world["claims"] if c[5] is not None]
    for as_of in (None, FIRST_DAY, max(days), date(2026, 3, 1)):
        monday = (as_of or max(days)) - timedelta(days=(as_of or max(days)).weekday())
        count = sum(monday <= d < monday + timedelta(days=7) for d in days)
        assert tuple(op.claims_this_week(frames["claims"], as_of).first()) == (monday, count)
        row = op.admin_kpis(
            frames["claims"], frames["shipments"], frames["parts"].selectExpr("1 qty", "1 safety"),
            as_of,
        ).first()
        assert row["claims_this_week"] == count
        assert row["pending_review"] == sum(c[4] == "Under Review" for c in world["claims"])


def test_search_and_escape(spark, rng):
    text = lambda longest: "".join(rng.choices(SIGNS, k=rng.randrange(longest)))
    texts = [maybe(rng, text(12)) for _ in range(2000)]
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for query in [text(4) for _ in range(12)] + ["%", "_", "\\", "a%"]:
        got = {r["id"] for r in frame.filter(contains_text("t", query)).collect()}
        assert got == {n for n, t in enumerate(texts) if query.lower() in (t or "").lower()}
    named = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#39;"}
    got = frame.select("id", escape_html(F.col("t")).alias("t")).collect()
    assert {r["id"]: r["t"] for r in got} == {
        n: "".join(named.get(c, c) for c in t or "") for n, t in enumerate(texts)
    }
