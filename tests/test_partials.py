"""Figures from partials against figures from all rows, on random splits and changes."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from wrenchwork import operators as op
from wrenchwork.schemas import CLAIM_STATUSES

CLAIMS = "no string, dealer string, status string, date date"
rows_of = lambda frame: sorted(map(str, frame.collect()))


@pytest.mark.parametrize("seed", range(3))
def test_random_splits_and_changes(spark, seed):
    rng = random.Random(seed)
    day = lambda: rng.choice([None, date(2026, 5, 1) + timedelta(days=rng.randrange(40))])
    claims = [(f"C{k}", rng.choice(["A", "B", None]), rng.choice([*CLAIM_STATUSES, None]), day()) for k in range(150)]
    shipments = spark.createDataFrame([(f"C{rng.randrange(200)}",) for _ in range(60)] + [(None,)], "claim string")
    stock = [(rng.choice([None, 1, 2, 3]), rng.choice([None, 2])) for _ in range(50)]
    stock = spark.createDataFrame(stock, "qty int, safety int")
    frame = lambda rows: spark.createDataFrame(rows, CLAIMS)
    count = lambda rows: op.claim_partials(frame(rows), shipments)
    cut = sorted(rng.sample(range(1, 150), 3))
    parts = [claims[a:b] for a, b in zip([0, *cut], [*cut, 150])]
    partials = op.merged_partials(*[count(p) for p in parts])
    for _ in range(2):  # some change, some are new
        again = rng.sample(claims, 20)
        now = {c[0]: (c[0], c[1], rng.choice(CLAIM_STATUSES), c[3]) for c in again}
        new = [(f"N{rng.random()}", "B", "Submitted", day()) for _ in range(5)]
        partials = op.merged_partials(partials, op.minus(count(again)), count([*now.values(), *new]))
        claims = [now.get(c[0], c) for c in claims] + new
    every = frame(claims)
    assert rows_of(partials) == rows_of(op.claim_partials(every, shipments).select(partials.columns))
    for as_of in (None, date(2026, 5, 20), date(2030, 1, 1)):
        expected = op.admin_kpis(every, shipments, stock, as_of)
        assert rows_of(op.admin_kpis_from(partials, op.stock_partials(stock), as_of)) == rows_of(expected)
        assert rows_of(op.claims_this_week_from(partials, as_of)) == rows_of(op.claims_this_week(every, as_of))
    assert rows_of(op.claims_per_status_from(partials)) == rows_of(op.claims_per_status(every))
    counted = every.groupBy("dealer").agg(
        *[F.count_if(F.col("status") == s).alias(n) for n, s in (("under_review", "Under Review"), ("approved", "Approved"), ("shipped", "Shipped"))]
    )
    assert rows_of(op.dealer_claims_from(partials)) == rows_of(counted)


def test_no_rows(spark):
    none = op.claim_partials(spark.createDataFrame([], CLAIMS), spark.createDataFrame([], "claim string"))
    stock = op.stock_partials(spark.createDataFrame([], "qty int, safety int"))
    assert op.admin_kpis_from(none, stock).first().asDict() == {
        "pending_review": 0, "awaiting_writeoff": 0, "low_stock_skus": 0, "claims_this_week": 0
    }
