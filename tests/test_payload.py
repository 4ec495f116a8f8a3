"""Payloads in pieces against whole payloads, and a form that holds most lines."""

from __future__ import annotations

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wrenchwork import operators as op

FORMS = "id string, vehicle_id bigint, fault_desc string, diagnosis string"
LINES = "claim string, oe_no string, qty int"


def bodies(pieces):
    out = {}
    for row in sorted(pieces.collect(), key=lambda r: (r.id, r.piece)):
        out.setdefault(row.id, []).append(row)
    for rows in out.values():
        assert [r.piece for r in rows] == list(range(rows[0].pieces)) and len({r.pieces for r in rows}) == 1
    return out


@pytest.mark.parametrize("piece_items", [1, 2, 3, 1000])
def test_pieces_make_the_payload(spark, piece_items):
    rng = random.Random(piece_items)
    words = ["", " ", "a}", 'x"},{', "é\n", None]
    forms = [(f"F{k}", rng.choice([None, 7, 8]), rng.choice(words), rng.choice(words)) for k in range(12)]
    lines = [(f"F{rng.randrange(10)}", rng.choice([*"ABCDE", 'q"', None]), rng.choice([1, 2, None])) for _ in range(80)]
    lines += [("F1", "A", 1)] * 9 + [("nobody", "A", 1), (None, "A", 1)]
    frame = spark.createDataFrame(forms, FORMS)
    found = bodies(op.payload_pieces(frame, spark.createDataFrame(lines, LINES), piece_items))
    assert set(found) == {f[0] for f in forms}
    for key, vehicle, fault, diagnosis in forms:
        body = json.loads("".join(r.body for r in found[key]))
        assert {k: body[k] for k in body if k != "items"} == {
            "vehicle_id": None if vehicle is None else str(vehicle), "fault_desc": fault, "diagnosis": diagnosis
        }
        sent = Counter((i["oe_no"], i["qty"]) for i in body["items"])
        assert sent == Counter((oe, qty) for claim, oe, qty in lines if claim == key)
        assert sum(r.items for r in found[key]) == len(body["items"])
    joined = spark.createDataFrame([(k, "".join(r.body for r in rows)) for k, rows in found.items()], "id string, payload string")
    parsed = {r.id: r["items"] for r in op.parse_payload(joined).collect()}
    assert all(len(parsed[k]) == sum(r.items for r in found[k]) for k in found)


def test_a_form_with_most_lines_is_many_pieces(spark):
    hot = spark.range(20_000).selectExpr("'hot' as claim", "concat('P', id) as oe_no", "cast(id % 3 as int) as qty")
    same = spark.range(5_000).selectExpr("'hot' as claim", "'P1' as oe_no", "1 as qty")
    others = spark.range(20_000).selectExpr("concat('F', id div 2) as claim", "concat('P', id) as oe_no", "1 as qty")
    lines = hot.unionByName(same).unionByName(others)
    forms = lines.select(F.col("claim").alias("id")).distinct().selectExpr("id", "1L as vehicle_id", "'f' as fault_desc", "'' as diagnosis")
    pieces = op.payload_pieces(forms, lines, 100)
    of_hot = pieces.filter("id = 'hot'").collect()
    assert len(of_hot) == 250 and sum(r.items for r in of_hot) == 25_000
    assert max(r.items for r in of_hot) < 700  # some of the 50 lists of a hundred like lines may meet
    assert sum(r.items > 0 for r in of_hot) == 250
    assert pieces.filter("id <> 'hot'").agg(F.max("pieces")).first()[0] == 1


def test_nothing(spark):
    none = spark.createDataFrame([], FORMS), spark.createDataFrame([], LINES)
    assert op.payload_pieces(*none).count() == 0
