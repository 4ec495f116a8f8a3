"""The flows over stored tables of the test data, against the queries over the same data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wrenchwork import operators as op, schemas, sources as src
from wrenchwork.plans import flows
from wrenchwork.plans.queries import QUERIES
from wrenchwork.plans.tables import AS_OF, Tables


def shaped(df, schema):
    """The frame in the columns and types of a schema, with nulls for what it lacks."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def same_rows(left, right):
    right = right.select(*left.columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def store(t, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("given"))
    items = t.claim_parts().groupBy("no").agg(
        F.collect_list(F.struct("oe", F.col("qty").cast("int").alias("qty"))).alias("parts")
    )
    claims = t.claims().join(items, "no", "left")
    src.write_claims(shaped(claims, schemas.CLAIMS), f"{folder}/claims")
    for name in ("vehicles", "parts", "inventory", "shipments", "decisions", "outbound",
                 "new_claims"):
        table = shaped(getattr(t, name)(), getattr(schemas, name.upper()))
        src.write_snapshot(table, f"{folder}/{name}")
    return folder


def test_intake(spark, t, store, tmp_path):
    flows.take_in_claims(spark, store, str(tmp_path), AS_OF)
    accepted = src.read_claims(spark, f"{tmp_path}/claims").drop("parts")
    assert same_rows(QUERIES["claim_intake"](t), accepted)
    rejects = spark.read.parquet(f"{tmp_path}/claim_rejects")
    assert same_rows(QUERIES["intake_rejects"](t), rejects)


def test_intake_refuses_numbers_in_use(spark, t, store, tmp_path):
    """Every second claim so far is known; forms with their numbers are not taken in again."""
    claims = src.read_claims(spark, f"{store}/claims").filter("pmod(crc32(no), 2) = 0")
    src.write_claims(claims, f"{tmp_path}/known")
    flows.take_in_claims(spark, store, f"{tmp_path}/out", AS_OF, f"{tmp_path}/known")
    accepted = src.read_claims(spark, f"{tmp_path}/out/claims").drop("parts")
    expected = QUERIES["claim_intake"](t).filter("pmod(crc32(no), 2) = 1")
    assert same_rows(expected, accepted) and not expected.isEmpty()
    rejects = spark.read.parquet(f"{tmp_path}/out/claim_rejects").filter("reason = 'number taken'")
    assert not rejects.isEmpty() and rejects.join(claims, rejects.id == claims.no, "left_anti").isEmpty()


def test_review(spark, t, store, tmp_path):
    flows.review_claims(spark, store, str(tmp_path))
    reviewed = src.read_claims(spark, f"{tmp_path}/claims")
    assert same_rows(QUERIES["claim_status_after_review"](t), reviewed.select("no", "status"))
    before = src.read_claims(spark, f"{store}/claims")
    assert same_rows(before.drop("status"), reviewed.drop("status"))
    rejects = spark.read.parquet(f"{tmp_path}/decision_rejects")
    assert same_rows(QUERIES["decision_rejects"](t), rejects.drop("decided_at"))


def test_write_off(spark, t, store, tmp_path):
    """On the claims as they are, the flow does what the queries do."""
    flows.write_off_claims(spark, store, store, str(tmp_path))
    orders = spark.read.parquet(f"{tmp_path}/writeoff_orders")
    assert same_rows(QUERIES["writeoff_orders"](t), orders)
    requests = spark.read.parquet(f"{tmp_path}/shipment_requests")
    assert same_rows(QUERIES["shipment_requests"](t), requests)
    flows.write_off_claims(spark, store, store, f"{tmp_path}/again", orders)
    assert spark.read.parquet(f"{tmp_path}/again/shipment_requests").isEmpty()


def test_stock(spark, t, store, tmp_path):
    flows.move_stock(spark, store, str(tmp_path))
    left = src.read_inventory(spark, f"{tmp_path}/inventory").selectExpr("sku", "qty as on_hand")
    expected = QUERIES["stock_after_outbound"](t).selectExpr("sku", "cast(on_hand as int) on_hand")
    assert same_rows(expected, left)


def test_search(spark, t, store):
    found = flows.find_parts(spark, store, "RING", "Brand#2")
    expected = op.part_cards(op.search_parts(t.parts(), "ring", "Brand#2"))
    assert same_rows(expected, found) and not found.isEmpty()
