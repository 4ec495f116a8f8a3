"""Relations that hold between operators, over the whole of the smallest tables."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from wrenchwork import operators as op
from wrenchwork.functions.text import contains_text
from wrenchwork.plans.tables import AS_OF, Tables


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def same_rows(left, right):
    columns = left.columns
    assert sorted(columns) == sorted(right.columns)
    right = right.select(*columns)
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


@pytest.mark.parametrize("query", ["customer#", "N1-", "00012", "zzz", " "])
def test_case_of_a_query_does_not_matter(t, query):
    vehicles = t.vehicles()
    found = op.search_vehicles(vehicles, query)
    assert same_rows(found, op.search_vehicles(vehicles, query.upper()))
    assert same_rows(found, op.search_vehicles(vehicles, query.lower()))


def test_empty_queries_find_everything(t):
    assert op.search_vehicles(t.vehicles(), "").count() == t.vehicles().count()
    assert op.search_parts(t.parts(), "", "").count() == t.parts().count()
    assert op.search_claims(t.claims(), "").count() == t.claims().count()
    assert op.search_inventory(t.inventory(), "").count() == t.inventory().count()
    assert op.filter_claims(t.claims(), "").count() == t.claims().count()


def test_every_text_contains_its_parts(t):
    documents = t.raw("documents").filter("length(text) > 20")
    for length in (1, 5, 20):
        part = documents.select("text", F.substring("text", 7, length).alias("part"))
        example = part.first()["part"]
        assert documents.filter(contains_text("text", example)).count() >= 1


def test_statuses_sum_to_all_claims(t):
    counts = op.claims_per_status(t.claims())
    assert counts.agg(F.sum("claims")).first()[0] == t.claims().count()


def test_an_article_is_low_or_ok(t):
    levels = {r["level"]: r["count"] for r in op.stock_level(t.inventory()).groupBy("level")
              .count().collect()}
    assert levels["Low"] == op.low_stock(t.inventory()).count()
    assert levels["Low"] == op.low_stock_count(t.inventory()).first()[0]
    assert sum(levels.values()) == t.inventory().count()


def test_approved_claims_are_waiting_or_shipped(t):
    approved = t.claims().filter(F.col("status").isin("Approved", "Partial")).select("no")
    waiting = op.awaiting_writeoff(t.claims(), t.shipments()).select("no")
    shipped = t.shipments().select(F.col("claim").alias("no")).distinct().join(approved, "no")
    assert same_rows(waiting.unionByName(shipped), approved)


def test_accepted_and_rejected_are_all(t):
    accepted, rejected = op.intake_claims(t.new_claims(), t.vehicles(), AS_OF)
    both = accepted.select(F.col("no").alias("id")).unionByName(rejected.select("id"))
    assert same_rows(both, t.new_claims().select("id"))


def test_log_and_rejects_are_all_decisions(t):
    _, log, rejects = op.apply_decisions(t.claim_heads(), t.decisions())
    assert same_rows(log.unionByName(rejects.drop("reason")), t.decisions())


def test_review_keeps_every_claim(t):
    after = op.reviewed_claims(t.claim_heads(), t.decisions())
    assert same_rows(after.select("no"), t.claim_heads().select("no"))
    settled = ~F.col("status").isin("Submitted", "Under Review")
    assert same_rows(
        t.claim_heads().filter(settled).select("no", "status"),
        after.select("no", F.col("status").alias("after")).join(
            t.claim_heads().filter(settled).select("no"), "no"
        ).select("no", F.col("after").alias("status")),
    )


def test_stock_goes_down_by_what_went_out(t):
    after, orders, rejects = op.apply_outbound(t.inventory(), t.outbound())
    total = lambda frame: frame.agg(F.coalesce(F.sum("qty"), F.lit(0))).first()[0]
    assert total(t.inventory()) - total(after) == total(orders)
    assert same_rows(orders.unionByName(rejects.drop("reason")), t.outbound())


def test_check_has_one_row_per_claimed_part(t):
    arguments = (t.claims(), t.vehicles(), t.parts(), t.maintenance(), t.accidents())
    check = op.warranty_check(*arguments, t.claim_lines())
    assert same_rows(check.select("no", "oe", "qty"), t.claim_lines())
    recommendation = op.warranty_recommendation(*arguments, t.claim_lines())
    assert same_rows(recommendation.select("no"), t.claims().select("no"))
    assert same_rows(
        recommendation, op.warranty_recommendation(*arguments, t.claim_parts())
    )
    passing = check.filter("term = 'ok' and wear = 'ok'").count()
    assert recommendation.agg(F.sum("passing")).first()[0] == passing
    assert op.review_card(*arguments, t.claim_lines()).count() == 5 * check.count()


def test_nested_and_flat_parts_give_the_same(t):
    """The parts as a column of the claims, as they are stored, and as a table of their own."""
    items = t.claim_parts().groupBy("no").agg(
        F.collect_list(F.struct("oe", "qty")).alias("parts")
    )
    nested = t.claims().join(items, "no", "left")
    rest = (t.vehicles(), t.parts(), t.maintenance(), t.accidents())
    assert same_rows(
        op.warranty_recommendation(nested, *rest),
        op.warranty_recommendation(t.claims(), *rest, t.claim_parts()),
    )
    assert same_rows(
        op.warranty_check(nested, *rest),
        op.warranty_check(t.claims(), *rest, t.claim_lines()),
    )


def test_items_are_whole(t):
    lines = t.claim_parts().select(F.col("no").alias("claim"), F.col("oe").alias("oe_no"), "qty")
    assert same_rows(op.claim_items(lines).select("claim", F.inline("items")), lines)


def test_weeks_add_up(t):
    """The week of a given day, over all weeks of the claims, counts each claim once."""
    first, last = t.claims().agg(F.min("date"), F.max("date")).first()
    assert op.claims_this_week(t.claims()).first() == op.claims_this_week(t.claims(), last).first()
    per_week = t.claims().groupBy(F.date_trunc("week", "date")).count()
    assert per_week.agg(F.sum("count")).first()[0] == t.claims().count()
    outside = op.claims_this_week(t.claims(), date(first.year - 1, 1, 1)).first()
    assert outside["claims"] == 0


def test_dashboards_agree_with_their_parts(t):
    admin = op.admin_kpis(t.claims(), t.shipments(), t.inventory()).first()
    assert admin["pending_review"] == op.pending_review(t.claims()).count()
    assert admin["awaiting_writeoff"] == op.awaiting_writeoff(t.claims(), t.shipments()).count()
    assert admin["low_stock_skus"] == op.low_stock_count(t.inventory()).first()[0]
    assert admin["claims_this_week"] == op.claims_this_week(t.claims()).first()["claims"]
    dealers = op.dealer_kpis(t.claims(), t.vehicles(), AS_OF)
    sums = dealers.agg(F.sum("under_review"), F.sum("approved"), F.sum("active_vehicles")).first()
    counts = {r["status"]: r["claims"] for r in op.claims_per_status(t.claims()).collect()}
    active = op.active_vehicles(t.vehicles(), AS_OF).agg(F.sum("active_vehicles")).first()[0]
    assert tuple(sums) == (counts["Under Review"], counts["Approved"], active)
