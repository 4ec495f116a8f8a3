"""The warranty check of a claim and the recommendation that follows from it.

Five marks per claim or claimed part:

* identity - the VIN is known and its vehicle is held by the claiming dealer;
* term - the day of the claim and the present mileage are within the cover for
  the part's class. The vehicle's own terms rule: its EV terms for ``EV Core``,
  its whole-vehicle terms for ``General`` and ``Wear Item``; the months in the
  part's label only describe. A part of no known class is not covered;
* wear - the part is no wear item;
* accident - no accident of the vehicle is on record up to the day of the claim;
* service - a first service is on record up to that day.

The first three are ok or bad, the last two ok or warn.

Recommendation, first match wins: Reject if identity is bad, or if parts are
claimed and none is within term and no wear item; Partial if only some are;
Manual if no parts are claimed or a mark is warn; else Approve.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cover import in_cover, warranty_class
from ..functions.text import contains_text, thousands
from ..schemas import BAD, OK, WARN
from .related import claim_lines

IN_WARRANTY, OUT_OF_WARRANTY = "In Warranty", "Out of Warranty"
TERMS = ("whole_months", "whole_km", "ev_months", "ev_km")
COVER_NAMES = (("Whole Vehicle", "whole"), ("EV Components (Battery / Motor / ECU)", "ev"))


@dataclass(frozen=True)
class Rules:
    """What a user of the check may want to set otherwise.

    ``class_terms`` names the terms of the vehicle, ``ev`` or ``whole``, that
    cover a class of parts; ``first_service`` is the text by which a service
    counts as the first one.
    """

    class_terms: Mapping[str, str]
    first_service: str


RULES = Rules(
    class_terms={"EV Core": "ev", "General": "whole", "Wear Item": "whole"},
    first_service="first service",
)


def warranty_cover(vehicles: DataFrame, as_of: date) -> DataFrame:
    """One row per vehicle and cover, with its terms and its state on a day."""
    covers = F.array(
        *[
            F.struct(
                F.lit(name).alias("cover"),
                F.col(f"{terms}_months").alias("months"),
                F.col(f"{terms}_km").alias("km"),
                F.when(in_cover(as_of, terms), IN_WARRANTY)
                .otherwise(OUT_OF_WARRANTY)
                .alias("state"),
            )
            for name, terms in COVER_NAMES
        ]
    )
    return vehicles.select("vin", "warranty_start", F.inline(covers)).select(
        "vin", "cover", "months", "km",
        F.concat(F.col("months").cast("string"), F.lit(" months / "), thousands("km"),
                 F.lit(" km")).alias("terms"),
        "warranty_start", "state",
    )


def active(as_of: date) -> Column:
    """Is any cover of the vehicle in force on the day?"""
    return in_cover(as_of, "whole") | in_cover(as_of, "ev")


def with_status(vehicles: DataFrame, as_of: date) -> DataFrame:
    """The vehicles with the ``status`` their covers give them on a day."""
    status = F.when(active(as_of), IN_WARRANTY).otherwise(OUT_OF_WARRANTY)
    return vehicles.withColumn("status", status)


def vehicle_record(
    vehicles: DataFrame,
    maintenance: DataFrame,
    accidents: DataFrame | None = None,
    rules: Rules = RULES,
) -> DataFrame:
    """One row per VIN: holder, terms, day of the first service and first accident.

    The histories are cut down to two dates per VIN, by one aggregation over
    both, before they meet anything else. Whether an event lies before a claim
    then is a comparison of dates, and no range join is needed.
    """
    no_date = F.lit(None).cast("date")
    history = maintenance.filter(contains_text("title", rules.first_service)).select(
        "vin", F.col("date").alias("serviced"), no_date.alias("crashed")
    )
    if accidents is not None:
        history = history.unionByName(
            accidents.select("vin", no_date.alias("serviced"), F.col("date").alias("crashed"))
        )
    # What is on record without a VIN is on no vehicle's record.
    history = history.filter(F.col("vin").isNotNull()).groupBy("vin").agg(
        F.min("serviced").alias("first_service"), F.min("crashed").alias("first_accident")
    )
    return _terms(vehicles).join(history, "vin", "full")


def claim_checks(
    claims: DataFrame,
    vehicles: DataFrame,
    maintenance: DataFrame,
    accidents: DataFrame | None = None,
    rules: Rules = RULES,
) -> DataFrame:
    """One row per claim: the marks that do not depend on the part.

    ``ev_in_term`` and ``whole_in_term`` say which of the vehicle's covers is
    in force; what the marks rest on comes along. After the full join in ``vehicle_record`` both sides reach this
    join through plain exchanges, so a VIN with very many claims can be cut.
    """
    record = vehicle_record(vehicles, maintenance, accidents, rules)
    return _with_vehicle(claims, record).select(
        "no", "vehicle", "status", "holder", "mileage", *TERMS, "first_service", "first_accident",
        _mark(F.col("holder") == F.col("dealer"), BAD).alias("identity"),
        *_covers_in_force(),
        F.when(F.col("first_accident") <= F.col("date"), WARN).otherwise(OK).alias("accident"),
        _mark(F.col("first_service") <= F.col("date"), WARN).alias("service"),
    )


def part_checks(
    claims: DataFrame,
    vehicles: DataFrame,
    parts: DataFrame,
    lines: DataFrame | None = None,
    rules: Rules = RULES,
) -> DataFrame:
    """The marks term and wear alone, which ask for no history, per claimed part."""
    checks = _with_vehicle(claims, _terms(vehicles)).select("no", "status", *_covers_in_force())
    return _per_part(claims, checks, parts, lines, rules).select(
        "no", "status", "oe", "name", "qty", "class", "term", "wear"
    )


def warranty_check(
    claims: DataFrame,
    vehicles: DataFrame,
    parts: DataFrame,
    maintenance: DataFrame,
    accidents: DataFrame | None = None,
    lines: DataFrame | None = None,
    rules: Rules = RULES,
) -> DataFrame:
    """The five marks, one row per claimed part.

    A claim without parts keeps one row, with null part, ``term`` and ``wear``.
    ``lines`` may give the claimed parts as a table of their own, shaped as the
    result of ``claim_lines``, where they are not nested in the claims.
    """
    checks = claim_checks(claims, vehicles, maintenance, accidents, rules)
    return _per_part(claims, checks, parts, lines, rules).select(
        "no", "status", "oe", "qty", "class", "identity", "term", "wear", "accident", "service"
    )


def review_card(
    claims: DataFrame,
    vehicles: DataFrame,
    parts: DataFrame,
    maintenance: DataFrame,
    accidents: DataFrame | None = None,
    lines: DataFrame | None = None,
    rules: Rules = RULES,
) -> DataFrame:
    """The check as the reviewer reads it: five rows per claimed part, in words.

    Rows two and three of a claim without parts have no mark.
    """
    checks = claim_checks(claims, vehicles, maintenance, accidents, rules)
    rows = _per_part(claims, checks, parts, lines, rules)
    named = {"ev": "EV", "whole": "Whole Vehicle"}
    limit = F.lit(None).cast("string")
    for terms, name in named.items():
        stated = F.concat(
            F.lit(f"{name} "), F.col(f"{terms}_months").cast("string"), F.lit("mo / "),
            thousands(f"{terms}_km"), F.lit(" km"),
        )
        limit = F.when(F.col("terms") == terms, stated).otherwise(limit)
    reading = F.concat(
        thousands("mileage"),
        F.when(F.col("term") == OK, " km · within ").otherwise(" km · outside "), limit,
    )
    details = (
        ("Vehicle Identity", "identity",
         F.when(F.col("holder").isNull(), "VIN not in any dealer inventory")
         .when(F.col("identity") == OK,
               F.concat(F.lit("VIN matches dealer inventory · "), "holder"))
         .otherwise(F.concat(F.lit("VIN held by another dealer · "), "holder"))),
        ("Warranty Term / Mileage", "term", F.coalesce(reading, F.lit("No cover known"))),
        ("Wear / Exclusion", "wear",
         F.when(F.col("wear") == OK,
                F.concat("name", F.lit(" is "), F.coalesce("class", F.lit("of no class")),
                         F.lit(" — not a wear item")))
         .when(F.col("wear_part"), F.concat("name", F.lit(" is a wear item")))
         .otherwise("Part not in the catalogue")),
        ("Human / Accident", "accident",
         F.when(F.col("accident") == OK, "No accident record; pending manual confirm")
         .otherwise(_dated("Accident on record", "first_accident"))),
        ("Maintenance Compliance", "service",
         F.when(F.col("service") == OK, _dated("First service on record", "first_service"))
         .otherwise("No first service on record")),
    )
    card = F.array(
        *[
            F.struct(
                F.lit(step).alias("step"), F.lit(title).alias("check"),
                F.col(mark).alias("mark"),
                F.when(F.col(mark).isNotNull(), text).alias("detail"),
            )
            for step, (title, mark, text) in enumerate(details, 1)
        ]
    )
    return rows.select("no", "oe", F.inline(card))


def warranty_recommendation(
    claims: DataFrame,
    vehicles: DataFrame,
    parts: DataFrame,
    maintenance: DataFrame,
    accidents: DataFrame | None = None,
    lines: DataFrame | None = None,
    rules: Rules = RULES,
) -> DataFrame:
    """One row per claim: number of parts, how many pass, and the recommendation.

    Whether a part passes depends on the claim only through which covers are in
    force. So the lines are counted by kind of cover first, which combines
    before the shuffle and leaves one row per claim, and the claims meet counts
    and never a claim's lines.
    """
    if lines is None:
        lines = claim_lines(claims)
    fit = ~F.col("wear_part")
    counts = lines.join(_catalogue(parts, rules), "oe", "left").groupBy("no").agg(
        F.count("oe").alias("parts"),
        F.count_if(fit & (F.col("terms") == "ev")).alias("ev_parts"),
        F.count_if(fit & (F.col("terms") == "whole")).alias("whole_parts"),
    )
    checks = claim_checks(claims, vehicles, maintenance, accidents, rules)
    passing = F.when(F.col("ev_in_term"), F.col("ev_parts")).otherwise(0) + F.when(
        F.col("whole_in_term"), F.col("whole_parts")
    ).otherwise(0)
    counted = checks.join(counts, "no", "left").select(
        "no", "identity", "accident", "service",
        F.coalesce("parts", F.lit(0)).alias("parts"),
        F.coalesce(passing, F.lit(0)).alias("passing"),
    )
    some_parts = F.col("parts") > 0
    unclear = (F.col("accident") == WARN) | (F.col("service") == WARN)
    recommendation = (
        F.when((F.col("identity") == BAD) | (some_parts & (F.col("passing") == 0)), "Reject")
        .when(F.col("passing") < F.col("parts"), "Partial")
        .when(~some_parts | unclear, "Manual")
        .otherwise("Approve")
    )
    return counted.select("no", "parts", "passing", recommendation.alias("recommendation"))


def _terms(vehicles: DataFrame) -> DataFrame:
    return vehicles.select(
        "vin", F.col("dealer").alias("holder"), "warranty_start", "mileage", *TERMS
    )


def _with_vehicle(claims: DataFrame, record: DataFrame) -> DataFrame:
    needed = claims.select("no", "vehicle", "dealer", "date", "status")
    return needed.join(record.withColumnRenamed("vin", "vehicle"), "vehicle", "left")


def _covers_in_force() -> list[Column]:
    return [
        in_cover("date", "ev").alias("ev_in_term"),
        in_cover("date", "whole").alias("whole_in_term"),
    ]


def _per_part(
    claims: DataFrame,
    checks: DataFrame,
    parts: DataFrame,
    lines: DataFrame | None,
    rules: Rules,
) -> DataFrame:
    """Marks per claim and the claimed parts, with the marks of the part added."""
    if lines is None:
        lines = claim_lines(claims)
    claimed = F.col("oe").isNotNull()
    in_term = ((F.col("terms") == "ev") & F.col("ev_in_term")) | (
        (F.col("terms") == "whole") & F.col("whole_in_term")
    )
    rows = lines.join(checks, "no").join(_catalogue(parts, rules), "oe", "left")
    return rows.withColumns(
        {
            "term": F.when(claimed, _mark(in_term, BAD)),
            "wear": F.when(claimed, _mark(~F.col("wear_part"), BAD)),
        }
    )


def _catalogue(parts: DataFrame, rules: Rules) -> DataFrame:
    """Per OE number the name, the class, the terms that cover it, and the wear flag."""
    terms = F.lit(None).cast("string")
    for name, covered_by in rules.class_terms.items():
        terms = F.when(F.col("class") == name, covered_by).otherwise(terms)
    labelled = parts.select(
        "oe", "name", warranty_class("warranty").alias("class"), F.col("wear").alias("wear_part")
    )
    return labelled.withColumn("terms", terms)


def _dated(text: str, day: str) -> Column:
    return F.concat(F.lit(f"{text} ("), F.col(day).cast("string"), F.lit(")"))


def _mark(passed: Column, otherwise: str) -> Column:
    """Ok where the test holds; a test that meets a null does not hold."""
    return F.when(passed, OK).otherwise(otherwise)
