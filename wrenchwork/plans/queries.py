"""Every operator as a query over the given tables, by name.

Each query takes a ``Tables`` and returns a lazy frame. ``oracle.py`` holds the
same queries in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .. import operators as op
from ..functions.text import escape_html
from ..schemas import INVENTORY
from ..sources.envelope import (
    checked_bodies,
    envelope_schema,
    rejected_bodies,
    rows_of_bodies,
    unwrap_envelope,
)
from .tables import AS_OF, Tables

Query = Callable[[Tables], DataFrame]

QUERIES: dict[str, Query] = {}


def _query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# Tables as they are read


@_query
def scan_vehicles(t: Tables) -> DataFrame:
    return t.vehicles()


@_query
def scan_claims(t: Tables) -> DataFrame:
    return t.claims()


@_query
def scan_claims_nested(t: Tables) -> DataFrame:
    item = lambda p: F.concat(p["oe"], F.lit(" x"), p["qty"].cast("string"))
    return t.nested_claims().withColumn("parts", F.array_join(F.transform("parts", item), ", "))


@_query
def scan_parts(t: Tables) -> DataFrame:
    return t.parts().withColumn("models", F.array_join("models", ", "))


@_query
def scan_inventory(t: Tables) -> DataFrame:
    return t.inventory()


@_query
def scan_shipments(t: Tables) -> DataFrame:
    return t.shipments().drop("tracking")


@_query
def scan_maintenance(t: Tables) -> DataFrame:
    return t.maintenance()


# Lists and cards


@_query
def vehicle_list(t: Tables) -> DataFrame:
    return op.vehicle_list(op.with_status(t.vehicles(), AS_OF))


@_query
def vehicle_profile(t: Tables) -> DataFrame:
    sold = t.vehicles().withColumn("sale_date", F.col("warranty_start"))
    return op.vehicle_profile(sold)


@_query
def vehicle_picker(t: Tables) -> DataFrame:
    return op.vehicle_picker(t.vehicles())


@_query
def claim_list(t: Tables) -> DataFrame:
    return op.claim_list(t.claims())


@_query
def part_cards(t: Tables) -> DataFrame:
    return op.part_cards(t.parts())


@_query
def part_cards_unknown(t: Tables) -> DataFrame:
    """Cards of parts of which something is unknown."""
    unknown = lambda column, every: F.when(F.col("part_id") % every != 0, F.col(column))
    return op.part_cards(t.parts().withColumns({c: unknown(c, k) for c, k in (("cat", 3), ("warranty", 5), ("name", 7))}))


@_query
def vehicle_picker_unknown(t: Tables) -> DataFrame:
    return op.vehicle_picker(t.vehicles().withColumn("model", F.when(F.col("id") % 3 != 0, F.col("model"))))


@_query
def part_labels(t: Tables) -> DataFrame:
    return op.part_labels(t.parts())


@_query
def part_picker(t: Tables) -> DataFrame:
    return op.part_picker(t.parts())


@_query
def stock_level(t: Tables) -> DataFrame:
    return op.stock_level(t.inventory())


@_query
def shipment_list(t: Tables) -> DataFrame:
    return op.shipment_list(t.shipments()).drop("tracking")


@_query
def status_class(t: Tables) -> DataFrame:
    claims = t.claim_heads().select(F.lit("claim").alias("kind"), "no", "status")
    shipments = t.shipment_heads().select(F.lit("shipment").alias("kind"), "no", "status")
    return op.status_badges(claims.unionByName(shipments))


@_query
def vehicle_badges(t: Tables) -> DataFrame:
    """The vehicle list shows its status as a badge; that of a vehicle has the default class."""
    vehicles = t.vehicles().select("vin", F.lit("In Warranty").alias("status"))
    return op.status_badges(vehicles)


@_query
def api_envelope(t: Tables) -> DataFrame:
    """Stock as responses of the API, one per article, read back; every ninth has failed."""
    number = F.expr("cast(substring(sku, 5) as bigint)")
    response = F.to_json(
        F.struct(
            (number % 9 != 0).alias("success"),
            F.when(number % 7 != 0, F.array(F.struct("sku", "oe", "qty"))).alias("data"),
        )
    )
    stock = t.inventory().select(response.alias("body"))
    schema = StructType([f for f in INVENTORY.fields if f.name in ("sku", "oe", "qty")])
    parsed = stock.select(F.from_json("body", envelope_schema(schema)).alias("r")).select("r.*")
    return unwrap_envelope(parsed, schema)


STOCK_ANSWER = StructType([f for f in INVENTORY.fields if f.name in ("sku", "oe", "qty")])


def _answers(t: Tables) -> DataFrame:
    """Stock as responses of the API, one per article, many of them bad in one way or another."""
    good = """concat('{"success":true,"data":[{"sku":"', sku, '","oe":"', oe, '","qty":', qty, '}]}')"""
    body = f"""case cast(substring(sku, 5) as bigint) % 11
        when 1 then null
        when 2 then '  '
        when 3 then left({good}, 30)
        when 4 then replace({good}, '"qty":', '"qty":"many","was":')
        when 5 then concat('[', {good}, ']')
        when 6 then replace({good}, 'true', 'false')
        when 7 then '{{"success":true,"data":null}}'
        when 8 then replace({good}, '"success":true,', '')
        when 9 then '{{"success":true,"data":[]}}'
        else {good} end"""
    return t.inventory().selectExpr("sku as asked", f"{body} as body")


@_query
def api_rows(t: Tables) -> DataFrame:
    return rows_of_bodies(checked_bodies(_answers(t), STOCK_ANSWER), STOCK_ANSWER)


@_query
def api_rejects(t: Tables) -> DataFrame:
    return rejected_bodies(checked_bodies(_answers(t), STOCK_ANSWER))


@_query
def recent_claims(t: Tables) -> DataFrame:
    newest = op.newest_claims(t.claim_heads())
    return op.recent_claims(t.claims(newest))


@_query
def maintenance_timeline(t: Tables) -> DataFrame:
    return op.maintenance_timeline(t.maintenance())


@_query
def escaped_text(t: Tables) -> DataFrame:
    documents = t.raw("documents").select("doc_id", escape_html("text").alias("text"))
    pages = t.raw("pages").select(
        F.col("page_id").alias("doc_id"), escape_html("html").alias("text")
    )
    return documents.withColumn("kind", F.lit("document")).unionByName(
        pages.withColumn("kind", F.lit("page"))
    )


# Searches and filters


@_query
def vehicle_search(t: Tables) -> DataFrame:
    return op.search_vehicles(t.vehicles(), "N1-")


@_query
def claim_search(t: Tables) -> DataFrame:
    return op.search_claims(t.claims(), "clm-1997-")


@_query
def inventory_search(t: Tables) -> DataFrame:
    return op.search_inventory(t.inventory(), "brand#1")


@_query
def part_search(t: Tables) -> DataFrame:
    found = op.search_parts(t.parts(), "RING", "Brand#2")
    return found.withColumn("models", F.array_join("models", ", "))


@_query
def part_search_literal(t: Tables) -> DataFrame:
    """Wildcards are plain characters: nothing holds a per cent sign."""
    found = op.search_parts(t.parts(), "%")
    return found.withColumn("models", F.array_join("models", ", "))


@_query
def part_search_all(t: Tables) -> DataFrame:
    """The empty search."""
    return op.part_cards(op.search_parts(t.parts(), ""))


@_query
def claim_search_trigrams(t: Tables) -> DataFrame:
    postings = op.trigram_postings(t.claims(), "no", "no", "vehicle")
    return op.search_postings(t.claims(), postings, "no", "clm-1997-", "no", "vehicle")


@_query
def vehicle_search_trigrams(t: Tables) -> DataFrame:
    postings = op.trigram_postings(t.vehicles(), "vin", "vin", "plate")
    return op.search_postings(t.vehicles(), postings, "vin", "N1-", "vin", "plate")


@_query
def claims_by_status(t: Tables) -> DataFrame:
    return op.filter_claims(t.claims(), "Approved")


@_query
def pending_review_queue(t: Tables) -> DataFrame:
    return op.claim_list(op.pending_review(t.claims()))


@_query
def low_stock(t: Tables) -> DataFrame:
    return op.low_stock(t.inventory())


@_query
def dealer_vehicles(t: Tables) -> DataFrame:
    return op.dealer_scope(t.vehicles(), "NATION_3")


@_query
def dealer_claims(t: Tables) -> DataFrame:
    """Claims on the vehicles a dealer holds."""
    return op.dealer_scope(op.review_queue_dealer(t.claims(), t.vehicles()), "NATION_3")


# Joins


@_query
def related_claims(t: Tables) -> DataFrame:
    return op.related_claims(t.vehicles(), t.claims())


@_query
def one_vehicle(t: Tables) -> DataFrame:
    return op.vehicle_by_id(t.vehicles(), 1024)


@_query
def vehicle_page(t: Tables) -> DataFrame:
    """All that the page of one vehicle shows."""
    sold = t.vehicles().withColumn("sale_date", F.col("warranty_start"))
    return op.vehicle_page(op.vehicle_by_id(sold, 1024), t.maintenance(), t.claims(), AS_OF)


@_query
def vehicle_pages(t: Tables) -> DataFrame:
    """The pages of all vehicles of a brand."""
    sold = t.vehicles().withColumn("sale_date", F.col("warranty_start")).filter("brand = 'MACHINERY'")
    return op.vehicle_page(sold, t.maintenance(), t.claims(), AS_OF)


@_query
def vehicle_by_id(t: Tables) -> DataFrame:
    """The vehicles that new claims name."""
    asked = t.new_claims().select(F.col("vehicle_id").alias("id"))
    return op.vehicles_by_id(t.vehicles(), asked)


@_query
def review_queue_dealer(t: Tables) -> DataFrame:
    return op.review_queue_dealer(t.claims(), t.vehicles())


@_query
def claimed_parts(t: Tables) -> DataFrame:
    return op.claimed_parts(t.claim_lines(), t.parts())


@_query
def claimed_parts_nested(t: Tables) -> DataFrame:
    return op.claimed_parts(op.claim_lines(t.nested_claims()), t.nested_catalogue())


@_query
def shipments_with_claim(t: Tables) -> DataFrame:
    return op.shipments_with_claim(t.shipments(), t.claims())


# Warranty


@_query
def warranty_cover(t: Tables) -> DataFrame:
    return op.warranty_cover(t.vehicles(), AS_OF)


@_query
def vehicle_record(t: Tables) -> DataFrame:
    return op.vehicle_record(t.vehicles(), t.maintenance(), t.accidents())


@_query
def warranty_check(t: Tables) -> DataFrame:
    return op.warranty_check(
        t.claims(), t.vehicles(), t.parts(), t.maintenance(), t.accidents(), t.claim_lines()
    )


@_query
def recommendation_nested(t: Tables) -> DataFrame:
    """The recommendation from the parts that claims carry."""
    return op.warranty_recommendation(
        t.nested_claims(), t.vehicles(), t.nested_catalogue(), t.maintenance(), t.accidents()
    )


@_query
def review_card(t: Tables) -> DataFrame:
    return op.review_card(
        t.claims(), t.vehicles(), t.parts(), t.maintenance(), t.accidents(), t.claim_lines()
    )


@_query
def warranty_recommendation(t: Tables) -> DataFrame:
    return op.warranty_recommendation(
        t.claims(), t.vehicles(), t.parts(), t.maintenance(), t.accidents(), t.claim_parts()
    )


# Figures


@_query
def claims_per_status(t: Tables) -> DataFrame:
    return op.claims_per_status(t.claim_heads())


@_query
def active_vehicles(t: Tables) -> DataFrame:
    return op.active_vehicles(t.vehicles(), AS_OF)


@_query
def low_stock_count(t: Tables) -> DataFrame:
    return op.low_stock_count(t.inventory())


@_query
def claims_this_week(t: Tables) -> DataFrame:
    return op.claims_this_week(t.claim_heads())


@_query
def claims_in_week(t: Tables) -> DataFrame:
    return op.claims_this_week(t.claim_heads(), AS_OF)


@_query
def admin_kpis(t: Tables) -> DataFrame:
    return op.admin_kpis(t.claim_heads(), t.shipment_heads(), t.inventory())


@_query
def admin_kpis_partials(t: Tables) -> DataFrame:
    """The same from partials: of most claims, plus others, minus and plus some that changed."""
    claims = t.claims().select("no", "date", "dealer", "status", "claim_id")
    shipments = t.shipment_heads()
    old, new = claims.filter("claim_id % 5 <> 0"), claims.filter("claim_id % 5 = 0")
    changed = old.filter("claim_id % 7 = 0")
    was = changed.withColumn("status", F.lit("Submitted"))
    before = op.merged_partials(
        op.claim_partials(old.filter("claim_id % 7 <> 0"), shipments), op.claim_partials(was, shipments)
    )
    now = op.merged_partials(
        before, op.claim_partials(new, shipments), op.minus(op.claim_partials(was, shipments)),
        op.claim_partials(changed, shipments),
    )
    return op.admin_kpis_from(now, op.stock_partials(t.inventory()))


@_query
def claim_partials(t: Tables) -> DataFrame:
    return op.claim_partials(t.claims(), t.shipment_heads())


@_query
def dealer_kpis(t: Tables) -> DataFrame:
    return op.dealer_kpis(t.claims(), t.vehicles(), AS_OF)


# Intake


@_query
def claim_intake(t: Tables) -> DataFrame:
    accepted, _ = op.intake_claims(t.new_claims(), t.vehicles(), AS_OF)
    return accepted


@_query
def intake_rejects(t: Tables) -> DataFrame:
    _, rejected = op.intake_claims(t.new_claims(), t.vehicles(), AS_OF)
    return rejected


@_query
def intake_numbers_in_use(t: Tables) -> DataFrame:
    """New forms, some with the number of a settled claim, and the reason to refuse them."""
    settled = t.claim_heads().filter("stage <> 'O'")
    again = settled.filter("claim_id % 11 = 0").selectExpr(
        "no as id", "vehicle_id", "fault as fault_desc", "cast(null as string) as diagnosis"
    )
    forms = t.new_claims().unionByName(again)
    return op.check_intake(forms, t.vehicles(), settled).select("id", "reason")


@_query
def claims_after_intake(t: Tables) -> DataFrame:
    """The settled claims and the new ones; forms with the number of a settled claim are refused."""
    columns = ["no", "vehicle", "model", "fault", "dealer", "date", "status"]
    settled = t.claim_heads().filter("stage <> 'O'")
    again = settled.filter("claim_id % 11 = 0").selectExpr(
        "if(claim_id % 22 = 0, no, null) as id", "vehicle_id", "fault as fault_desc", "cast(null as string) as diagnosis"
    )
    claims = t.claims(settled).select(*columns)
    accepted, _ = op.intake_claims(t.new_claims().unionByName(again), t.vehicles(), AS_OF, settled)
    return op.merged_claims(claims, accepted)


def _forms(t: Tables) -> DataFrame:
    lines = t.claim_parts().select(F.col("no").alias("claim"), F.col("oe").alias("oe_no"), "qty")
    return op.claim_items(lines)


@_query
def claim_items(t: Tables) -> DataFrame:
    item = lambda i: F.concat(i["oe_no"], F.lit(" x"), i["qty"].cast("string"))
    return _forms(t).select(
        "claim", F.array_join(F.transform("items", item), ", ").alias("items")
    )


@_query
def claim_intake_items(t: Tables) -> DataFrame:
    """The parts of accepted claims, as their forms sent them; a claim without has one row."""
    accepted, _ = op.intake_claims(t.nested_forms(), t.vehicles(), AS_OF)
    return op.claim_lines(accepted)


@_query
def claim_payload_json(t: Tables) -> DataFrame:
    return op.claim_payload(_forms_with_items(t))


@_query
def claim_payload_pieces(t: Tables) -> DataFrame:
    """Every form's body in pieces of about two items."""
    lines = t.claim_parts().select(F.col("no").alias("claim"), F.col("oe").alias("oe_no"), "qty")
    sent = lines.join(t.new_claims().select(F.col("id").alias("claim")), "claim", "left_semi")
    return op.payload_pieces(t.new_claims(), sent, 2)


def _forms_with_items(t: Tables) -> DataFrame:
    """Every form, also one without items."""
    items = _forms(t).select(F.col("claim").alias("id"), "items")
    none = F.array().cast(items.schema["items"].dataType)
    forms = t.new_claims().join(items, "id", "left")
    return forms.withColumn("items", F.coalesce("items", none))


@_query
def payload_round_trip(t: Tables) -> DataFrame:
    """Items of accepted claims after their forms were posted and read again."""
    back = op.parse_payload(op.claim_payload(_forms_with_items(t)))
    accepted, _ = op.intake_claims(back, t.vehicles(), AS_OF)
    return accepted.select("no", F.explode("parts").alias("part")).select("no", "part.oe", "part.qty")


@_query
def accepted_lines(t: Tables) -> DataFrame:
    lines = t.claim_parts().select(F.col("no").alias("claim"), F.col("oe").alias("oe_no"), "qty")
    return op.accepted_lines(lines, op.check_intake(t.new_claims(), t.vehicles()))


# Review, write-off, stock


@_query
def claim_status_after_review(t: Tables) -> DataFrame:
    return op.reviewed_claims(t.claim_heads(), t.decisions()).select("no", "status")


@_query
def decision_log(t: Tables) -> DataFrame:
    _, log, _ = op.apply_decisions(t.claim_heads(), t.decisions())
    return log.select("claim", "decision", "note", F.to_date("decided_at").alias("decided_on"))


@_query
def decision_rejects(t: Tables) -> DataFrame:
    _, _, rejects = op.apply_decisions(t.claim_heads(), t.decisions())
    return rejects.select("claim", "decision", "note", "reason")


@_query
def claim_states(t: Tables) -> DataFrame:
    return op.claim_states(t.claim_events())


@_query
def claim_history(t: Tables) -> DataFrame:
    return op.claim_history(t.claim_events())


@_query
def illegal_moves(t: Tables) -> DataFrame:
    return op.illegal_moves(op.claim_history(t.claim_events()))


@_query
def awaiting_writeoff(t: Tables) -> DataFrame:
    queue, _ = _queue(t)
    return queue.select("no", "vehicle", "model", "status", "date")


def _queue(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The queue, and the heads it was decided on: few claims, whose vehicles are looked up last."""
    heads = op.awaiting_writeoff(t.claim_heads(), t.shipment_heads())
    return t.claims(heads), heads


def _settled(t: Tables) -> tuple[DataFrame, DataFrame]:
    queue, heads = _queue(t)
    return queue, op.part_checks(queue, t.vehicles(), t.parts(), t.parts_of(heads))


@_query
def writeoff_orders(t: Tables) -> DataFrame:
    return op.writeoff_orders(*_settled(t))


@_query
def shipment_requests(t: Tables) -> DataFrame:
    _, checks = _settled(t)
    return op.shipment_requests(checks)


@_query
def booked_shipments(t: Tables) -> DataFrame:
    """New shipments; of claims whose number ends in 7 they were booked before."""
    _, checks = _settled(t)
    requests = op.shipment_requests(checks)
    before = op.booked_shipments(requests.filter("right(claim, 1) = '7'"))
    return op.booked_shipments(requests, before).select("no", "claim", "part", "qty", "status")


@_query
def claims_after_shipment(t: Tables) -> DataFrame:
    queue, checks = _settled(t)
    booked = op.booked_shipments(op.shipment_requests(checks), t.shipments())
    claims = t.claims().select("no", "vehicle", "status")
    return op.merged_claims(claims, op.shipped_claims(queue.select("no", "vehicle", "status"), booked))


@_query
def writeoff_stock(t: Tables) -> DataFrame:
    _, checks = _settled(t)
    return op.writeoff_stock(op.shipment_requests(checks), t.inventory())


@_query
def outbound_rejects(t: Tables) -> DataFrame:
    _, _, rejects = op.apply_outbound(t.inventory(), t.outbound())
    return rejects.select("order_id", "oe", "qty", "reason")


@_query
def stock_after_outbound(t: Tables) -> DataFrame:
    return op.stock_after_outbound(t.inventory(), t.outbound())
