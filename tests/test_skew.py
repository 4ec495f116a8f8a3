"""One key with a third of all rows: cut at run time, and nothing lost.

The fixtures are small, so the sizes from which adaptive execution calls a
partition skewed are made small too; broadcasts are off, as they would be at
scale.
"""

from __future__ import annotations

import re
from collections import Counter
from datetime import date
from statistics import median

import pytest
from pyspark.sql import functions as F

from wrenchwork import operators as op, sources as src
from wrenchwork.session import prepare

N = 240_000
HOT = "id % 3 = 0"
DAY = date(2026, 8, 17)

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
}


@pytest.fixture(scope="module")
def cluster(spark):
    """The session with settings under which the fixtures count as large."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    prepare(spark)
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    yield spark
    for name, value in before.items():
        if value is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, value)


def final_plan(frame):
    """The rows, and the plan as it was when the last stage ran."""
    rows = frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in text
    return rows, text.split("== Initial Plan ==")[0]


def rows_of(spark, n=N):
    return spark.range(0, n, 1, 24)


def key(prefix, count):
    """Key 0 for a third of the rows, the other keys alike."""
    return F.concat(F.lit(prefix), F.when(F.expr(HOT), 0).otherwise(F.col("id") % count))


def claims(spark):
    return rows_of(spark).select(
        F.concat(F.lit("C"), "id").alias("no"),
        key("V", 500).alias("vehicle"),
        F.lit("m").alias("model"),
        F.lit("f").alias("fault"),
        F.when(F.col("id") % 2 == 0, "Approved").otherwise("Under Review").alias("status"),
        F.lit(DAY).alias("date"),
        F.when(F.col("id") % 7 == 0, "D2").otherwise("D1").alias("dealer"),
    )


def lines_by_part(spark):
    """Two thirds of the parts claimed are spread, one third is one part."""
    return rows_of(spark).select(
        F.concat(F.lit("C"), "id").alias("no"), key("P", 400).alias("oe"), F.lit(1).alias("qty")
    )


def lines_by_claim(spark):
    """A third of all claimed parts belongs to one claim."""
    return rows_of(spark).select(
        key("C", 700).alias("no"), F.concat(F.lit("P"), F.col("id") % 400).alias("oe"),
        F.lit(1).alias("qty"),
    )


def vehicles(spark):
    return spark.range(0, 500, 1, 4).select(
        "id", F.concat(F.lit("V"), "id").alias("vin"), F.lit("D1").alias("dealer"),
        F.lit("m").alias("model"),
        F.lit(date(2025, 1, 1)).alias("warranty_start"), F.lit(10).alias("mileage"),
        F.lit(72).alias("whole_months"), F.lit(100).alias("whole_km"),
        F.lit(96).alias("ev_months"), F.lit(100).alias("ev_km"),
    )


def parts(spark):
    return spark.range(0, 400, 1, 4).select(
        F.concat(F.lit("P"), "id").alias("oe"), F.concat(F.lit("part "), "id").alias("name"),
        F.when(F.col("id") % 5 == 1, "Wear Item").otherwise("EV Core (96mo)").alias("warranty"),
        (F.col("id") % 5 == 1).alias("wear"),
    )


def inventory(spark):
    return parts(spark).select("oe", F.lit(5).alias("qty"))


def maintenance(spark):
    """A third of all services on one vehicle."""
    return rows_of(spark).select(
        key("V", 500).alias("vin"), F.lit(DAY).alias("date"), F.lit("first service").alias("title")
    )


def test_vehicle_with_a_third_of_the_claims(cluster):
    frame = op.claim_checks(claims(cluster), vehicles(cluster), maintenance(cluster))
    rows, plan = final_plan(frame)
    assert "skew=true" in plan
    assert len(rows) == N
    assert Counter(r["identity"] for r in rows) == {
        "bad": len(range(0, N, 7)), "ok": N - len(range(0, N, 7))
    }
    assert {(r["service"], r["accident"], r["ev_in_term"]) for r in rows} == {("ok", "ok", True)}


def test_part_claimed_in_a_third_of_the_lines(cluster):
    rows, plan = final_plan(op.claimed_parts(lines_by_part(cluster), parts(cluster)))
    assert "skew=true" in plan
    assert len(rows) == N
    assert Counter(r["oe"] for r in rows).most_common(1)[0][0] == "P0"
    assert all(r["name"] == f"part {r['oe'][1:]}" for r in rows)


def test_recommendation_with_a_hot_vehicle_and_a_hot_part(cluster):
    frame = op.warranty_recommendation(
        claims(cluster), vehicles(cluster), parts(cluster), maintenance(cluster),
        lines=lines_by_part(cluster),
    )
    rows, plan = final_plan(frame)
    assert plan.count("skew=true") >= 2
    expected = Counter(
        "Reject" if n % 7 == 0 or (n % 3 and n % 400 % 5 == 1) else "Approve" for n in range(N)
    )
    assert Counter(r["recommendation"] for r in rows) == expected


def test_check_and_stock_of_a_claim_with_a_third_of_the_lines(cluster):
    queue = op.filter_claims(claims(cluster), "Approved")
    checks = op.part_checks(queue, vehicles(cluster), parts(cluster), lines_by_claim(cluster))
    rows, plan = final_plan(op.writeoff_stock(op.shipment_requests(checks), inventory(cluster)))
    assert "skew=true" in plan
    expected = Counter(
        f"C{0 if n % 3 == 0 else n % 700}" for n in range(N) if n % 3 == 0 or n % 700 % 2 == 0
    )
    assert Counter(r["claim"] for r in rows) == expected
    assert {r["in_stock"] for r in rows} == {True}


def test_chain_of_lookups_of_a_hot_part(cluster):
    """Catalogue and stock are both looked up by part; each join is cut."""
    queue = op.filter_claims(claims(cluster), "Approved")
    checks = op.part_checks(queue, vehicles(cluster), parts(cluster), lines_by_part(cluster))
    rows, plan = final_plan(op.writeoff_stock(op.shipment_requests(checks), inventory(cluster)))
    assert plan.count("skew=true") >= 2
    assert Counter(r["oe"] for r in rows) == Counter(
        f"P{0 if n % 3 == 0 else n % 400}" for n in range(0, N, 2)
    )


def test_related_claims_of_a_hot_vehicle(cluster):
    more = vehicles(cluster).unionByName(vehicles(cluster).limit(1).withColumn("vin", F.lit("V-")))
    rows, plan = final_plan(op.related_claims(more, claims(cluster)))
    assert "skew=true" in plan
    assert len(rows) == N + 1
    assert [r["vin"] for r in rows if r["claim"] == "No claims"] == ["V-"]


def test_shipments_of_a_hot_claim(cluster):
    shipments = rows_of(cluster).select(
        F.concat(F.lit("S"), "id").alias("no"), key("C", 700).alias("claim"),
        F.lit("p").alias("part"), F.lit(1).alias("qty"), F.lit("c").alias("carrier"),
        F.lit("Delivered").alias("status"), F.lit(DAY).alias("eta"),
    )
    rows, plan = final_plan(op.shipments_with_claim(shipments, claims(cluster)))
    assert "skew=true" in plan
    assert len(rows) == N
    waiting, plan = final_plan(op.awaiting_writeoff(claims(cluster), shipments))
    shipped = {0 if n % 3 == 0 else n % 700 for n in range(N)}
    assert {r["no"] for r in waiting} == {f"C{n}" for n in range(0, N, 2) if n not in shipped}


def test_new_claims_on_a_hot_vehicle(cluster):
    forms = rows_of(cluster).select(
        F.concat(F.lit("N"), "id").alias("id"),
        F.when(F.expr(HOT), 0).otherwise(F.col("id") % 600).alias("vehicle_id"),
        F.lit("f").alias("fault_desc"),
    )
    rows, plan = final_plan(op.check_intake(forms, vehicles(cluster)))
    assert "skew=true" in plan
    assert Counter(r["reason"] for r in rows)["unknown vehicle"] == sum(
        1 for n in range(N) if n % 3 and n % 600 >= 500
    )


def test_movements_of_a_hot_part(cluster):
    """Summed before the shuffle: what reaches the join is one row per part."""
    moved = rows_of(cluster).select(
        F.concat(F.lit("O"), "id").alias("order_id"), key("P", 450).alias("oe"),
        F.lit(1).alias("qty"),
    )
    stock = inventory(cluster).withColumn("sku", F.col("oe"))
    rows, _ = final_plan(op.stock_after_outbound(stock, moved))
    expected = Counter(f"P{0 if n % 3 == 0 else n % 450}" for n in range(N))
    assert {r["oe"]: r["taken_out"] for r in rows} == {
        f"P{n}": expected[f"P{n}"] for n in range(400)
    }
    rows, plan = final_plan(op.check_outbound(stock, moved))
    assert "skew=true" in plan
    assert sum(r["reason"] is not None for r in rows) == sum(
        1 for n in range(N) if n % 3 and n % 450 >= 400
    )


def test_decisions_on_a_hot_claim(cluster):
    decisions = rows_of(cluster).select(
        key("C", 700).alias("claim"),
        F.when(F.col("id") == N - 3, "Rejected").otherwise("Approved").alias("decision"),
        F.lit("n").alias("note"), F.col("id").cast("timestamp").alias("decided_at"),
    )
    under_review = claims(cluster).withColumn("status", F.lit("Under Review"))
    after, log, rejects = op.apply_decisions(under_review, decisions)
    rows, _ = final_plan(after)
    assert Counter(r["status"] for r in rows)["Rejected"] == 1
    assert [r["no"] for r in rows if r["status"] == "Rejected"] == ["C0"]
    rows, plan = final_plan(log)
    assert "skew=true" in plan
    assert len(rows) == N and rejects.count() == 0


def test_month_with_a_third_of_the_claims_is_written_in_pieces(cluster, tmp_path):
    spread = claims(cluster).withColumn(
        "date",
        F.when(F.hash("no") % 3 == 0, F.lit(DAY)).otherwise(
            F.add_months(F.lit(date(2025, 1, 1)), F.pmod(F.hash("no"), F.lit(12)))
        ),
    )
    small = cluster.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    cluster.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    src.write_claims(spread, f"{tmp_path}/claims")
    cluster.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", small)
    files = Counter(
        re.search(r"month=([\d-]+)", name)[1]
        for name in cluster.read.parquet(f"{tmp_path}/claims").inputFiles()
    )
    hot = files.pop("2026-08-01")
    assert hot >= 2 * median(files.values()), (hot, files)
    back = cluster.read.parquet(f"{tmp_path}/claims").drop("month")
    assert back.count() == N
    assert back.exceptAll(spread.select(*back.columns)).isEmpty()
