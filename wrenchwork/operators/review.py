"""Review decisions: what counts, what is refused, and the claims afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..schemas import DECISION_VALUES, REVIEWABLE
from .checked import split_checked


def newest_decisions(decisions: DataFrame) -> DataFrame:
    """The newest decision of each claim; of two at one time the later in the alphabet.

    An aggregation rather than a ranking: it combines before the shuffle, so a
    claim decided very often is no burden on one task.
    """
    newest = F.max(F.struct("decided_at", "decision", "note")).alias("newest")
    return decisions.groupBy("claim").agg(newest).select("claim", "newest.*")


def check_decisions(claims: DataFrame, decisions: DataFrame) -> DataFrame:
    """The decisions with a ``reason`` to refuse them, null where they count.

    A decision needs a note, which may be blank but not empty, a value that can be
    decided, and a claim that exists.
    """
    known = claims.select(F.col("no").alias("claim"), F.lit(True).alias("known"))
    unknown_claim = F.when(F.col("known").isNull(), "unknown claim")
    return decisions.join(known, "claim", "left").select(
        *decisions.columns, F.coalesce(_refusal(), unknown_claim).alias("reason")
    )


def _refusal() -> Column:
    """Why a decision does not count, whatever its claim; null if it may."""
    no_note = F.coalesce(F.length("note"), F.lit(0)) == 0
    decided = F.coalesce(F.col("decision").isin(*DECISION_VALUES), F.lit(False))
    return F.when(no_note, "no note").when(~decided, "unknown decision")


def reviewed_claims(
    claims: DataFrame, decisions: DataFrame, reviewable: Sequence[str] = REVIEWABLE
) -> DataFrame:
    """All claims, with the newest valid decision as the status of those it may change.

    A decision changes claims of a ``reviewable`` status, Submitted or Under
    Review unless told otherwise, and no others. So only those are joined; the
    others, in time nearly all, pass through without a shuffle. Decisions that
    ``check_decisions`` refuses for their note or value never count here, so that
    none of them hides an earlier one that does.
    """
    newest = newest_decisions(decisions.filter(_refusal().isNull())).select(F.col("claim").alias("no"), "decision")
    is_open = F.col("status").isin(*reviewable)
    decided = claims.filter(is_open).join(newest, "no", "left").withColumn(
        "status", F.coalesce("decision", "status")
    )
    settled = claims.filter(~is_open | F.col("status").isNull())
    return settled.unionByName(decided.select(*claims.columns))


def decided_claims(
    claims: DataFrame, decisions: DataFrame, reviewable: Sequence[str] = REVIEWABLE
) -> DataFrame:
    """Of ``reviewed_claims`` only the rows whose status a decision changes."""
    newest = newest_decisions(decisions.filter(_refusal().isNull())).select(F.col("claim").alias("no"), "decision")
    decided = claims.filter(F.col("status").isin(*reviewable)).join(newest, "no")
    return decided.select(*[F.col("decision").alias(c) if c == "status" else c for c in claims.columns])


def apply_decisions(
    claims: DataFrame, decisions: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(claims afterwards, audit log, rejects)``.

    The audit log keeps every decision that counts, also those that a newer one
    replaced; log and rejects together are all decisions given.
    """
    log, rejects = split_checked(check_decisions(claims, decisions))
    return reviewed_claims(claims, decisions), log, rejects
