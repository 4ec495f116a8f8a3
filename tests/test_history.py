"""States of claims against a plain loop, on random logs and on one with a hot claim."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wrenchwork import operators as op
from wrenchwork.operators import history
from wrenchwork.plans.tables import Tables
from wrenchwork.schemas import CLAIM_STATUSES

ORDER = {s: k for k, s in enumerate(CLAIM_STATUSES)}


def walk(log, moves=op.LEGAL_MOVES, start="Draft"):
    """(states, history, illegal) by going through the events one after the other."""
    lives = defaultdict(Counter)
    for claim, at, event in log:
        if claim is not None and at is not None:
            lives[claim][(at, ORDER.get(event, 8), event or "", event)] += 1
    states, rows = {}, []
    for claim, life in lives.items():
        state, total, wrong = start, 0, 0
        for (at, _, _, event), n in sorted(life.items(), key=lambda x: x[0][:3]):
            before, illegal = state, 0
            for _ in range(n):
                if event in moves.get(state, ()):
                    state = event
                else:
                    illegal += 1
            rows.append((claim, at, event, n, before, state, illegal))
            total, wrong = total + n, wrong + illegal
        states[claim] = (state, total, wrong)
    return states, Counter(rows)


def check(spark, log, kind="date", unit="month", moves=op.LEGAL_MOVES, start="Draft"):
    states, rows = walk(log, moves, start)
    events = spark.createDataFrame(log, f"claim string, at {kind}, event string")
    found = op.claim_states(events, moves, start, unit).collect()
    assert {r.claim: (r.status, r.events, r.illegal) for r in found} == states and len(found) == len(states)
    told = op.claim_history(events, moves, start, unit)
    assert Counter(tuple(r) for r in told.collect()) == rows
    illegal = Counter((c, at, e, after, i) for (c, at, e, n, before, after, i) in rows.elements() if i)
    assert Counter(tuple(r) for r in op.illegal_moves(told).collect()) == illegal


EVENTS = [*CLAIM_STATUSES, "Cancelled", None]


@pytest.mark.parametrize("seed", range(3))
def test_random_logs(spark, seed):
    rng = random.Random(seed)
    day = lambda: date(2026, 1, 1) + timedelta(days=rng.randrange(200))
    log = [
        (rng.choice([*"abcdefgh", None]), rng.choice([day(), day(), day(), None]), rng.choice(EVENTS))
        for _ in range(rng.choice((5, 200, 600)))
    ]
    check(spark, log)


def test_other_moves_times_and_start(spark):
    """Statuses that may come again, moves back, seconds, and slices of a day."""
    moves = {s: CLAIM_STATUSES[:5] for s in CLAIM_STATUSES[:5]} | {"Rejected": ("Rejected", "Submitted")}
    rng = random.Random(9)
    log = [
        (f"c{rng.randrange(5)}", datetime(2026, 3, 1) + timedelta(seconds=rng.randrange(400_000)), rng.choice(EVENTS))
        for _ in range(800)
    ]
    check(spark, log + log[:50], "timestamp", "day", moves, "Rejected")


def test_a_hot_claim_is_many_slices(spark, monkeypatch):
    """Half of all events are one claim's; they meet as maps, one a slice, and in short pieces."""
    monkeypatch.setattr(history, "PIECE", 5)
    rng = random.Random(4)
    log = [("hot", date(2020, 1, 1) + timedelta(days=rng.randrange(1500)), rng.choice(EVENTS)) for _ in range(4000)]
    log += [(f"c{k}", date(2020, 1, 1), e) for k in range(500) for e in ("Submitted", "Approved", "Shipped")]
    check(spark, log)
    events = spark.createDataFrame(log, "claim string, at date, event string")
    slices = history._slices(events, "month")
    assert slices.filter("claim = 'hot'").count() == 50
    assert slices.agg(F.max(F.size("units"))).first()[0] <= 31 * len(EVENTS)


@pytest.mark.parametrize("few", (1, 20, 100))
def test_claims_with_few_and_with_many_events(spark, monkeypatch, few):
    """Whole or in slices, also where alike events make them many and no instants do."""
    monkeypatch.setattr(history, "FEW", few)
    rng = random.Random(few)
    day = lambda: date(2026, 1, 1) + timedelta(days=rng.randrange(200))
    log = [(f"c{k}", day(), rng.choice(EVENTS)) for k in range(12) for _ in range(k * k)]
    check(spark, log + [("again", date(2026, 1, 1), e) for e in ("Submitted", "Approved", None) for _ in range(30)])


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_claims_with_few_events_meet_once(spark):
    """One shuffle brings all events of a claim together, and no join follows."""
    log = [(f"c{k}", date(2020, 1 + k % 5, 1), e) for k in range(300) for e in ("Approved", "Submitted", "Closed")]
    events = spark.createDataFrame(log, "claim string, at date, event string")
    for told in (op.claim_states(events), op.claim_history(events), op.illegal_moves(op.claim_history(events))):
        text = final_plan(told)
        assert "Join" not in text and text.count("Exchange hashpartitioning(claim") == 1


def test_a_claim_that_fills_a_partition_is_cut(spark):
    settings = {
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    events = spark.range(0, 60_000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'hot', concat('c', id)) as claim", "date_add(date'2020-01-01', cast(id % 20011 as int)) as at",
        "element_at(array('Submitted', 'Approved', 'Closed'), cast(1 + id % 7 % 3 as int)) as event",
    )
    _, rows = walk([tuple(r) for r in events.collect()])
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        told = op.claim_history(events)
        assert "skew=true" in final_plan(told)
        assert Counter(tuple(r) for r in told.collect()) == rows
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_logs_are_read_once(spark):
    """What happened to shipments comes out of one join of the line items."""
    text = Tables(spark, "/root/testdata/sf0.001").claim_events()._jdf.queryExecution().executedPlan().toString()
    assert text.count("lineitem.parquet") == 1


def test_no_events(spark):
    check(spark, [])
    check(spark, [(None, date(2026, 1, 1), "Submitted"), ("a", None, "Submitted")])
