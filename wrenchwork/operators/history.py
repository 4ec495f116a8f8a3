"""The states of a claim, from all events in its life.

An event asks a claim to move to a status at a time. It moves it if the move is legal from the
status the claim has by then; else it changes nothing and is reported. So each event is a map
from statuses to statuses, and a run of events is one such map too. Events are first counted
where they are alike. A claim with few of them, as nearly all are, is then gone through in one
row, from the first status on. The events of a claim with many are folded into one map per slice
of time, and only these maps meet in the claim's row: it is many slices, on many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import CLAIM_STATUSES, REVIEWABLE, WRITE_OFF

START = "Draft"

# Decision: a claim goes forward only; what a decision or a shipment may change is as in
# ``reviewed_claims`` and ``awaiting_writeoff``.
LEGAL_MOVES: Mapping[str, Sequence[str]] = {
    "Draft": ("Submitted",),
    "Submitted": ("Under Review", "Approved", "Partial", "Rejected"),
    "Under Review": ("Approved", "Partial", "Rejected"),
    "Approved": ("Shipped", "Closed"),
    "Partial": ("Shipped", "Closed"),
    "Rejected": ("Closed",),
    "Shipped": ("Closed",),
    "Closed": (),
}
assert set(REVIEWABLE) | set(WRITE_OFF) < set(LEGAL_MOVES)

# Events of a row are gone through in pieces of this size, so that lists stay short.
PIECE = 64

# A claim with more events than this is gone through slice by slice.
FEW = 1000


def claim_states(
    events: DataFrame,
    moves: Mapping[str, Sequence[str]] = LEGAL_MOVES,
    start: str = START,
    unit: str = "month",
) -> DataFrame:
    """``claim, status, events, illegal`` after all ``events`` ``(claim, at, event)``.

    Events of one time go in the order of the statuses, unknown ones last, which are always
    illegal. Events without claim or time are left out.
    """
    legal, (few, many) = _Moves(moves), _by_size(events)
    first = F.struct(F.lit(_number(start)).alias("state"), F.lit(0).cast("long").alias("illegal"))

    whole = _lives(few).select("claim", _events_in("units").alias("events"), F.aggregate("units", first, legal.moved).alias("end"))
    runs = _slices(many, unit).select("claim", "slice", _events_in("units").alias("n"), _map("units", legal).alias("map"))
    per_claim = runs.groupBy("claim").agg(
        F.sum("n").alias("events"), F.array_sort(F.collect_list(F.struct("slice", "map"))).alias("runs")
    )
    end = F.aggregate(
        "runs",
        first,
        lambda acc, run: F.struct(
            F.get(run["map"], acc["state"])["state"].alias("state"),
            (acc["illegal"] + F.get(run["map"], acc["state"])["illegal"]).alias("illegal"),
        ),
    )
    ended = whole.union(per_claim.select("claim", "events", end.alias("end")))
    return ended.select("claim", _name(F.col("end.state")).alias("status"), "events", F.col("end.illegal").alias("illegal"))


def claim_history(
    events: DataFrame,
    moves: Mapping[str, Sequence[str]] = LEGAL_MOVES,
    start: str = START,
    unit: str = "month",
) -> DataFrame:
    """``claim, at, event, times, before, after, illegal`` of all events, like ones as one row.

    Of events alike in claim, time and status, ``illegal`` tells how many could not move the
    claim. Order and what is left out are as in ``claim_states``.
    """
    legal, (few, many) = _Moves(moves), _by_size(events)
    whole = _lives(few).select("claim", "units", F.lit(_number(start)).alias("state"))
    slices = _slices(many, unit)
    maps = slices.select("claim", F.struct("slice", _map("units", legal).alias("map")).alias("run"))
    per_claim = maps.groupBy("claim").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    # The status before each slice: as many as a claim has slices, never as many as events.
    before = F.aggregate(
        "runs",
        F.array(F.lit(_number(start))),
        lambda acc, run: F.array_append(acc, F.get(run["map"], F.element_at(acc, F.lit(-1)))["state"]),
    )
    starts = per_claim.select("claim", F.explode(F.arrays_zip(F.col("runs.slice").alias("slice"), before.alias("state"))).alias("s"))
    starts = starts.selectExpr("claim as of", "s.slice as since", "s.state").where("since is not null")
    # Null-safe, though no slice is null: else a filter of the join's would part the shuffles of the events.
    known = whole.union(slices.join(starts, F.expr("claim = of and slice <=> since")).select("claim", "units", "state"))
    at_type = events.schema["at"].dataType.simpleString()
    each = known.select("claim", F.explode(_steps("units", F.col("state"), legal, at_type)).alias("e"))
    return each.select(
        "claim", "e.at", "e.event", F.col("e.n").alias("times"),
        _name(F.col("e.before")).alias("before"), _name(F.col("e.after")).alias("after"), "e.illegal",
    )


def illegal_moves(history: DataFrame) -> DataFrame:
    """Of a ``claim_history`` the events that could not move the claim, and its status then."""
    return history.where("illegal > 0").select(
        "claim", "at", "event", F.col("after").alias("status"), F.col("illegal").alias("times")
    )


def _number(status: str) -> int:
    return CLAIM_STATUSES.index(status)


def _name(number: Column) -> Column:
    return F.get(_statuses(), number)


def _statuses() -> Column:
    return F.expr(f"array({', '.join(f"'{status}'" for status in CLAIM_STATUSES)})")


def _by_size(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events with claim and time: those of claims with few, and of claims with many.

    The names of the claims with many, at most one in ``FEW`` events, are gathered by a shuffle of
    their own: if there are none, as is usual, that is known before the join runs. It is one by
    merging, which cuts a claim that fills a partition into several tasks.
    """
    dated = events.where(F.col("claim").isNotNull() & F.col("at").isNotNull())
    many = dated.groupBy("claim").agg(F.count("*").alias("n")).where(F.col("n") > FEW)
    many = many.select("claim", F.lit(True).alias("many")).hint("rebalance").hint("merge")
    sized = dated.join(many, "claim", "left")
    return sized.where("many is null").drop("many"), sized.where("many").drop("many")


def _lives(events: DataFrame) -> DataFrame:
    """``claim, units``: all events of a claim, in their order, in one row."""
    counted = _counted(events.repartition("claim"))
    return counted.groupBy("claim").agg(_in_order().alias("units"))


def _slices(events: DataFrame, unit: str) -> DataFrame:
    """``claim, slice, units``: the events of a claim in a unit of time, in their order.

    Like events are counted first, so a slice is no longer than the instants in it.
    """
    return _counted(events).groupBy("claim", F.date_trunc(unit, "at").alias("slice")).agg(_in_order().alias("units"))


def _counted(events: DataFrame) -> DataFrame:
    return events.groupBy("claim", "at", "event").agg(F.count("*").alias("n"))


def _in_order() -> Column:
    """The list of like events, by time and place of the status."""
    place = F.array_position(_statuses(), F.col("event")).cast("int")
    number = F.when(F.coalesce(place, F.lit(0)) > 0, place - 1).otherwise(len(CLAIM_STATUSES))
    return F.sort_array(F.collect_list(F.struct("at", number.alias("to"), "event", "n")))


def _events_in(units: str) -> Column:
    return F.aggregate(units, F.lit(0).cast("long"), lambda acc, u: acc + u["n"])


class _Moves:
    """Legal moves as constant arrays: for every status what each status, or an unknown one, does to it."""

    def __init__(self, moves: Mapping[str, Sequence[str]]) -> None:
        legal = lambda at, to: to is not None and to in moves.get(at, ())
        events = (*CLAIM_STATUSES, None)
        # The status after an event, and which of like events are illegal: none, all but the first, or all.
        afters = [_number(to if legal(at, to) else at) for at in CLAIM_STATUSES for to in events]
        wrong = [(0 if legal(to, to) else 1) if legal(at, to) else 2 for at in CLAIM_STATUSES for to in events]
        self.afters = F.expr(f"array({', '.join(map(str, afters))})")
        self.wrong = F.expr(f"array({', '.join(map(str, wrong))})")

    def _at(self, state: Column, unit: Column) -> Column:
        return state * (len(CLAIM_STATUSES) + 1) + unit["to"]

    def after(self, state: Column, unit: Column) -> Column:
        """The status after like events."""
        return F.get(self.afters, self._at(state, unit))

    def illegal(self, state: Column, unit: Column) -> Column:
        """How many of like events are illegal."""
        wrong = F.get(self.wrong, self._at(state, unit))
        return F.when(wrong == 2, unit["n"]).when(wrong == 1, unit["n"] - 1).otherwise(0).cast("long")

    def moved(self, entry: Column, unit: Column) -> Column:
        """``state, illegal`` after like events, from those before."""
        state, illegal = self.after(entry["state"], unit), self.illegal(entry["state"], unit)
        return F.struct(state.alias("state"), (entry["illegal"] + illegal).alias("illegal"))


def _map(units: str, moves: _Moves) -> Column:
    """What a run of events makes of each status: an array of ``state, illegal``."""
    states = range(len(CLAIM_STATUSES))
    unmoved = F.expr(f"array({', '.join(f"named_struct('state', {k}, 'illegal', 0L)" for k in states)})")
    return F.aggregate(units, unmoved, lambda acc, unit: F.transform(acc, lambda entry: moves.moved(entry, unit)))


def _steps(units: str, start: Column, moves: _Moves, at_type: str) -> Column:
    """Every unit with the status before and after it, piece by piece."""
    pieces = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(units) - 1) / PIECE).cast("int")),
        lambda k: F.slice(units, k * PIECE + 1, F.lit(PIECE)),
    )
    end = lambda piece, state: F.aggregate(piece, state, moves.after)
    starts = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        F.array(start),
        lambda acc, piece: F.array_append(acc, end(piece, F.element_at(acc, F.lit(-1)))),
    )

    nothing = F.array().cast(f"array<struct<at:{at_type},event:string,n:bigint,before:int,after:int,illegal:bigint>>")

    def with_states(pair: Column) -> Column:
        def step(acc: Column, unit: Column) -> Column:
            before = F.when(F.size(acc) == 0, pair["start"]).otherwise(F.try_element_at(acc, F.lit(-1))["after"])
            after, illegal = moves.after(before, unit), moves.illegal(before, unit)
            return F.array_append(
                acc,
                F.struct(
                    unit["at"].alias("at"), unit["event"].alias("event"), unit["n"].alias("n"),
                    before.alias("before"), after.alias("after"), illegal.alias("illegal"),
                ),
            )

        return F.aggregate(pair["piece"], nothing, step)

    pairs = F.zip_with(pieces, starts, lambda p, s: F.struct(p.alias("piece"), s.alias("start")))
    return F.flatten(F.transform(pairs, with_states))

