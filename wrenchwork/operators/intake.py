"""New claims: the form's items, its payload, validation and acceptance."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from ..schemas import CLAIM_PAYLOAD

NEW_STATUS = "Submitted"


def claim_items(items: DataFrame) -> DataFrame:
    """Item rows ``(claim, oe_no, qty)`` as one list per claim, the form's own shape.

    A claim's list is one cell because the form posts it as one body; it is as long as what one
    form sent. In bulk, items travel as rows: see ``accepted_lines``.
    """
    item = F.struct("oe_no", "qty")
    return items.groupBy("claim").agg(F.sort_array(F.collect_list(item)).alias("items"))


def claim_payload(forms: DataFrame) -> DataFrame:
    """The JSON body the claim form posts, per row of ``NEW_CLAIMS`` shape.

    The vehicle's id goes as text, as a form field does; nulls are kept.
    """
    body = F.struct(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in CLAIM_PAYLOAD.fields]
    )
    return forms.select("id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def payload_pieces(forms: DataFrame, lines: DataFrame, piece_items: int = 1000) -> DataFrame:
    """The bodies of ``claim_payload`` in pieces: ``id, piece, pieces, items, body``.

    The bodies of a form, joined in the order of ``piece`` from 0, are its payload. ``lines`` are
    item rows ``(claim, oe_no, qty)``; forms are unique in ``id``, have no items of their own and
    may have no lines. Lines are counted per form first, which tells the number of its pieces;
    then each is dealt into one by its part and quantity, so that the lines of one form, however
    many, are spread over tasks and no list holds many more than ``piece_items``. Like lines are
    one row up to that number. Within a piece items are in order.
    """
    alike = lines.groupBy("claim", "oe_no", "qty").agg(F.count("*").alias("n"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / piece_items))).alias("block")
    rows = alike.select("claim", "oe_no", "qty", "n", blocks).withColumn(
        "times", F.least(F.col("n") - F.col("block") * piece_items, F.lit(piece_items)).cast("int")
    )
    sizes = lines.groupBy("claim").agg(F.ceil(F.count("*") / piece_items).alias("pieces"))
    text = F.concat_ws("/", F.coalesce("oe_no", F.lit("")), F.coalesce(F.col("qty").cast("string"), F.lit("")), "block")
    hashed = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    dealt = rows.join(sizes, "claim").withColumn("piece", F.pmod(hashed, "pieces"))
    items = F.array_sort(F.collect_list(F.struct("oe_no", "qty", "block", "times")))
    written = lambda i: F.array_repeat(
        F.to_json(F.struct(i["oe_no"].alias("oe_no"), i["qty"].alias("qty")), {"ignoreNullFields": "false"}), i["times"]
    )
    bodies = dealt.groupBy("claim", "piece").agg(F.sum("times").alias("items"), items.alias("list")).select(
        F.col("claim").alias("id"), "piece", "items",
        F.array_join(F.flatten(F.transform("list", written)), ",").alias("list"),
    )
    opened = bodies.groupBy("id").agg(F.min("piece").alias("opened"))  # the first piece with an item
    head = F.struct(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in CLAIM_PAYLOAD.fields if f.name != "items"]
    )
    head = F.regexp_replace(F.to_json(head, {"ignoreNullFields": "false"}), r"\}$", ',"items":[')
    known = forms.select("id", head.alias("head")).join(sizes.withColumnRenamed("claim", "id"), "id", "left")
    pieces = F.coalesce("pieces", F.lit(1).cast("long"))
    each = known.join(opened, "id", "left").select(
        "id", "head", "opened", pieces.alias("pieces"), F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1)).alias("piece")
    )
    body = F.concat(
        F.when(F.col("piece") == 0, F.col("head")).otherwise(""),
        F.when(F.col("items").isNotNull() & (F.col("piece") > F.col("opened")), ",").otherwise(""),
        F.coalesce("list", F.lit("")),
        F.when(F.col("piece") == F.col("pieces") - 1, "]}").otherwise(""),
    )
    return each.join(bodies, ["id", "piece"], "left").select(
        "id", "piece", "pieces", F.coalesce("items", F.lit(0).cast("long")).alias("items"), body.alias("body")
    )


def parse_payload(payloads: DataFrame) -> DataFrame:
    """``(id, payload)`` back into rows of ``NEW_CLAIMS`` shape.

    An id that is no number counts as no vehicle chosen.
    """
    return payloads.select("id", F.from_json("payload", CLAIM_PAYLOAD).alias("body")).select(
        "id",
        F.col("body.vehicle_id").try_cast("long").alias("vehicle_id"),
        "body.fault_desc", "body.diagnosis", "body.items",
    )


def check_intake(
    new_claims: DataFrame, vehicles: DataFrame, claims: DataFrame | None = None
) -> DataFrame:
    """New claims with their vehicle, and the ``reason`` to refuse them, null where accepted.

    A form needs a number. A vehicle must be chosen and exist, and the fault must not be empty;
    blanks are a text. A number must be new: not among ``claims``, if given, and on one form only.
    """
    held = vehicles.select(
        F.col("id").alias("vehicle_id"), F.col("vin").alias("vehicle"), "model", "dealer"
    )
    numbers = new_claims.select("id")
    if claims is not None:
        numbers = numbers.unionByName(claims.select(F.col("no").alias("id")))
    taken = numbers.groupBy("id").agg(F.count("*").alias("uses")).filter("uses > 1")
    reason = (
        F.when(F.col("id").isNull(), "no number")
        .when(F.col("vehicle_id").isNull(), "no vehicle")
        .when(F.coalesce(F.length("fault_desc"), F.lit(0)) == 0, "no fault")
        .when(F.col("vehicle").isNull(), "unknown vehicle")
        .when(F.col("uses").isNotNull(), "number taken")
    )
    return new_claims.join(held, "vehicle_id", "left").join(taken, "id", "left").select(
        *new_claims.columns, "vehicle", "model", "dealer", reason.alias("reason")
    )


def accepted_lines(lines: DataFrame, checked: DataFrame) -> DataFrame:
    """Of the item rows ``(claim, oe_no, qty)`` those of accepted claims, still as rows."""
    accepted = checked.filter(F.col("reason").isNull()).select(F.col("id").alias("claim"))
    return lines.join(accepted, "claim", "left_semi")


def accepted_claims(checked: DataFrame, submitted_on: date) -> DataFrame:
    """Accepted rows of ``check_intake`` as claims; nested parts where there are items."""
    claims = checked.filter(F.col("reason").isNull())
    parts = []
    if "items" in checked.columns:
        as_part = lambda item: F.struct(item["oe_no"].alias("oe"), item["qty"].alias("qty"))
        parts = [F.transform("items", as_part).alias("parts")]
    diagnosis = ["diagnosis"] if "diagnosis" in checked.columns else []
    return claims.select(
        F.col("id").alias("no"), "vehicle", "model", F.col("fault_desc").alias("fault"),
        F.lit(NEW_STATUS).alias("status"), F.lit(submitted_on).alias("date"),
        *parts, *diagnosis, "dealer",
    )


def rejected_claims(checked: DataFrame) -> DataFrame:
    return checked.filter(F.col("reason").isNotNull()).drop("vehicle", "model", "dealer")


def intake_claims(
    new_claims: DataFrame,
    vehicles: DataFrame,
    submitted_on: date,
    claims: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(accepted claims, rejects)``; together they are all new claims."""
    checked = check_intake(new_claims, vehicles, claims)
    return accepted_claims(checked, submitted_on), rejected_claims(checked)
