"""Whole flows from stored tables to stored tables.

The flows named by batch work on one ``store``: its ``claims`` are a table of versions, see
``sources.versions``, what else a batch writes lies in folders of its name, and the new version
of the claims comes last. So a batch that died is run again as it is, and one that is done does
nothing when run again. Forms and decisions wait in ``inbox/new_claims/{batch}`` and
``inbox/decisions/{batch}``.

The other flows go from folder to folder. ``source`` is the folder of the present state, ``target`` a new folder for what
the flow makes of it; each table is a folder below, named as the entity. A flow
that dies is run again with another target. Where a step builds on one before
it, it reads the table that step has written.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import operators as op, schemas, sources as src
from ..session import prepare


def find_parts(spark: SparkSession, source: str, query: str, brand: str = "") -> DataFrame:
    """Catalogue search: the cards of the parts found; one plan, nothing is fetched whole."""
    parts = src.read_parts(spark, f"{source}/parts")
    return op.part_cards(op.search_parts(parts, query, brand))


def take_in_claims(
    spark: SparkSession, source: str, target: str, submitted_on: date, known: str | None = None
) -> None:
    """Accepted new claims to ``claims``, the others to ``claim_rejects``.

    ``known`` is the folder of the claims so far, as a rule ``{source}/claims``; forms with their
    numbers are refused. Without it a number only has to be on one form.
    """
    vehicles = src.read_vehicles(spark, f"{source}/vehicles")
    forms = src.read_new_claims(spark, f"{source}/new_claims")
    claims = None if known is None else src.read_claims(spark, known)
    checked = _stored(op.check_intake(forms, vehicles, claims), f"{target}/intake_checked")
    src.append_claims(op.accepted_claims(checked, submitted_on), f"{target}/claims")
    src.append_rows(op.rejected_claims(checked), f"{target}/claim_rejects")


def review_claims(spark: SparkSession, source: str, target: str) -> None:
    """Apply ``decisions``: new ``claims``, ``decision_log`` and ``decision_rejects``."""
    claims = src.read_claims(spark, f"{source}/claims")
    decisions = src.read_decisions(spark, f"{source}/decisions")
    checked = _stored(op.check_decisions(claims, decisions), f"{target}/decisions_checked")
    log, rejects = op.split_checked(checked)
    src.write_claims(op.reviewed_claims(claims, log), f"{target}/claims")
    src.append_rows(log, f"{target}/decision_log")
    src.append_rows(rejects, f"{target}/decision_rejects")


def write_off_claims(
    spark: SparkSession,
    source: str,
    reviewed: str,
    target: str,
    orders: DataFrame | None = None,
) -> None:
    """Settle the claims approved in ``reviewed``: ``writeoff_orders``, ``shipment_requests``.

    ``reviewed`` is the target of ``review_claims``; ``orders`` are the orders so far.
    """
    claims = src.read_claims(spark, f"{reviewed}/claims")
    vehicles = src.read_vehicles(spark, f"{source}/vehicles")
    parts = src.read_parts(spark, f"{source}/parts")
    shipments = src.read_shipments(spark, f"{source}/shipments")

    queue = op.awaiting_writeoff(claims, shipments, orders)
    queue = _stored(queue, f"{target}/writeoff_queue")
    checks = _stored(op.part_checks(queue, vehicles, parts), f"{target}/writeoff_checks")
    new_orders, requests = op.write_off(queue, checks)
    src.append_rows(new_orders, f"{target}/writeoff_orders")
    src.append_rows(requests, f"{target}/shipment_requests")


def move_stock(spark: SparkSession, source: str, target: str) -> None:
    """Apply ``outbound``: new ``inventory``, ``outbound_orders`` and ``outbound_rejects``."""
    inventory = src.require_unique(src.read_inventory(spark, f"{source}/inventory"), "oe")
    outbound = src.read_outbound(spark, f"{source}/outbound")
    checked = _stored(op.check_outbound(inventory, outbound), f"{target}/outbound_checked")
    orders, rejects = op.split_checked(checked)
    src.write_snapshot(op.moved_stock(inventory, orders), f"{target}/inventory")
    src.append_rows(orders, f"{target}/outbound_orders")
    src.append_rows(rejects, f"{target}/outbound_rejects")


def open_store(spark: SparkSession, source: str, store: str) -> None:
    """A store from the tables of ``source``: its claims are the first version."""
    prepare(spark, source)
    _kept(src.read_vehicles(spark, f"{source}/vehicles"), f"{store}/vehicles")
    _kept(src.read_parts(spark, f"{source}/parts"), f"{store}/parts")
    _kept(src.read_shipments(spark, f"{source}/shipments"), f"{store}/shipments/batch=start")
    _merge(spark, store, src.read_claims(spark, f"{source}/claims"), "start")


def claims_now(
    spark: SparkSession, store: str, since: date | None = None, until: date | None = None
) -> DataFrame:
    """The claims of a store in their newest version, optionally of a range of days."""
    version = src.newest_version(spark, f"{store}/claims")
    return src.read_version(spark, f"{store}/claims", version, since, until)


def take_in_batch(spark: SparkSession, store: str, batch: str, submitted_on: date) -> None:
    """New claims of the inbox into the claims; those refused to ``claim_rejects``.

    A number in use is refused, so together with the claims so far each number occurs once.
    """
    prepare(spark, store)
    if src.is_done(spark, f"{store}/claims", batch):
        return
    forms = src.read_new_claims(spark, f"{store}/inbox/new_claims/{batch}")
    vehicles = src.read_vehicles(spark, f"{store}/vehicles")
    checked = op.check_intake(forms, vehicles, claims_now(spark, store))
    checked = _kept(checked, f"{store}/work/{batch}/intake_checked")
    _kept(op.rejected_claims(checked), f"{store}/claim_rejects/batch={batch}")
    accepted = _kept(op.accepted_claims(checked, submitted_on), f"{store}/work/{batch}/accepted")
    _merge(spark, store, accepted, batch)


def review_batch(spark: SparkSession, store: str, batch: str) -> None:
    """Decisions of the inbox into the claims, ``decision_log`` and ``decision_rejects``."""
    prepare(spark, store)
    if src.is_done(spark, f"{store}/claims", batch):
        return
    claims = claims_now(spark, store)
    decisions = src.read_decisions(spark, f"{store}/inbox/decisions/{batch}")
    checked = _kept(op.check_decisions(claims, decisions), f"{store}/work/{batch}/decisions_checked")
    log, rejects = op.split_checked(checked)
    log = _kept(log, f"{store}/decision_log/batch={batch}")
    _kept(rejects, f"{store}/decision_rejects/batch={batch}")
    decided = _kept(op.decided_claims(claims, log), f"{store}/work/{batch}/decided")
    _merge(spark, store, decided, batch)


def ship_batch(spark: SparkSession, store: str, batch: str) -> None:
    """Write off what is approved: ``writeoff_orders``, new ``shipments``, claims to Shipped.

    A claim is settled by one batch only, as its order stands from then on. What this batch has
    written before it died does not count as done.
    """
    prepare(spark, store)
    if src.is_done(spark, f"{store}/claims", batch):
        return
    claims = claims_now(spark, store)
    vehicles, parts = src.read_vehicles(spark, f"{store}/vehicles"), src.read_parts(spark, f"{store}/parts")
    shipments = _other_batches(spark, f"{store}/shipments", schemas.SHIPMENTS, batch)
    orders = _other_batches(spark, f"{store}/writeoff_orders", schemas.WRITEOFF_ORDERS, batch)
    queue = _kept(op.awaiting_writeoff(claims, shipments, orders), f"{store}/work/{batch}/queue")
    checks = _kept(op.part_checks(queue, vehicles, parts), f"{store}/work/{batch}/checks")
    new_orders, requests = op.write_off(queue, checks)
    booked = op.booked_shipments(requests, shipments).withColumn("qty", F.col("qty").cast("int"))
    booked = _kept(booked, f"{store}/shipments/batch={batch}")
    _kept(new_orders, f"{store}/writeoff_orders/batch={batch}")
    shipped = _kept(op.shipped_claims(queue, booked), f"{store}/work/{batch}/shipped")
    _merge(spark, store, shipped, batch)


def claim_partials_now(spark: SparkSession, store: str) -> DataFrame:
    """The partials of the newest version of the claims, for the figures of ``operators.partials``."""
    version = src.newest_version(spark, f"{store}/claims")
    return spark.read.parquet(f"{store}/claim_partials/{_figures_of(version)}")


def _merge(spark: SparkSession, store: str, changed: DataFrame, batch: str) -> None:
    """Rows into the claims, and the partials of the new version from those of the one before.

    Only the rows that change are counted, as they were and as they are now. A claim counts as
    shipped by the shipments there are, for both, as no batch ships what it does not change.
    """
    claims = f"{store}/claims"
    last = src.newest_version(spark, claims)

    def count(version: src.Version, before: DataFrame) -> None:
        shipments = spark.read.schema(schemas.SHIPMENTS).parquet(f"{store}/shipments/batch=*")
        earlier = _other_batches(spark, f"{store}/shipments", schemas.SHIPMENTS, batch) if last else shipments
        partials = op.claim_partials(changed, shipments)
        if last is not None:
            was = op.minus(op.claim_partials(before, earlier))
            partials = op.merged_partials(claim_partials_now(spark, store), was, partials)
        _kept(partials.coalesce(1), f"{store}/claim_partials/{_figures_of(version)}")

    src.merge_claims(spark, claims, changed, batch, count)


def _figures_of(version: src.Version) -> str:
    return f"version={version.number:08d}-{version.batch}"


def _other_batches(spark: SparkSession, path: str, schema, batch: str) -> DataFrame:
    """Rows that other batches have written; none where there is no table yet."""
    if not src.exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schemas.with_batch(schema)).parquet(path)
    return rows.filter(F.col("batch") != batch).drop("batch")


def _kept(df: DataFrame, path: str) -> DataFrame:
    """Write a table of a batch, in place of what a run that died has left, and read it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stored(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate table and go on from what was written."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
