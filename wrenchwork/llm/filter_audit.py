"""What a chain of document filters removes, in every order of the filters.

Whether a document fails a filter does not depend on the other filters, so each document is
one mask of failures, and all figures of all orders are sums over counts per mask.

Four filters look at one text. The fifth, "a copy of a document with a smaller id", needs the
table. A counting Bloom filter clears the texts that are certainly unique: every text counts up
three slots of one block of counters, the counts of all tasks are merged, and a text with a
slot that nobody else has used is alone. Only the others, possible repeats, are shuffled as
full texts for their smallest id. The sketch has a number of blocks in proportion to the rows
up to ``most_blocks``; beyond, it clears fewer texts and more are compared in full, with the
same result.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .frames import stored

NAMES = "ABCDE"
ORDERS = ["".join(order) for order in permutations(NAMES)]
COPY = 16  # bit of E

SPACES = "[\t-\r ]"
SYMBOLS = "[#$%&*|]"

# A block is 8 longs of 32 counters with two bits each, which count 0, 1, 2 and "3 or more".
SLOTS = 256
PER_LONG = 32


@dataclass(frozen=True)
class Limits:
    least_words: int = 100
    least_distinct_percent: int = 80
    most_capitals_percent: int = 10
    rows_per_block: int = 32
    most_blocks: int = 1 << 20  # about 64 MB of counters, the bound of what is broadcast


def text_failures(text: Column, limits: Limits = Limits()) -> Column:
    """Bits 1, 2, 4 and 8 for the filters A to D that a text, not null, fails."""
    words = F.array_remove(F.split(text, SPACES), "")

    def mask(w: Column) -> Column:
        n, distinct = F.size(w).cast("long"), F.size(F.array_distinct(w)).cast("long")
        capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
        fails = [
            n < limits.least_words,
            100 * distinct < limits.least_distinct_percent * n,
            100 * capitals > limits.most_capitals_percent * F.length(text).cast("long"),
            text.rlike(SYMBOLS),
        ]
        return sum(F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails))

    return F.get(F.transform(F.array(words), mask), F.lit(0))


def digest(text: Column) -> list[Column]:
    """Two independent hashes of a text, the first of which places it in the sketch."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _slots(h: Column) -> Column:
    """Three slots of a block, from bits of a hash that do not choose the block."""
    return F.array_distinct(
        F.array(*[F.shiftrightunsigned(h, 40 + 8 * k).bitwiseAND(F.lit(SLOTS - 1)) for k in range(3)])
    )


def sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """``block, counters``: how often each slot was used, from the column ``h``.

    Partial counts are made in each task and merged by slot, so a text of very many rows is
    one row per task.
    """
    used = hashes.select(F.pmod("h", F.lit(blocks)).alias("block"), F.explode(_slots(F.col("h"))).alias("slot"))
    counted = used.groupBy("block", "slot").agg(F.least(F.count("*"), F.lit(3)).alias("n"))
    longs = [
        F.coalesce(
            F.bit_or(
                F.when(
                    F.floor(F.col("slot") / PER_LONG) == k,
                    F.expr(f"shiftleft(n, cast(2 * (slot % {PER_LONG}) as int))"),
                )
            ),
            F.lit(0).cast("long"),
        )
        for k in range(SLOTS // PER_LONG)
    ]
    return counted.groupBy("block").agg(F.array(*longs).alias("counters"))


def _may_repeat(counters: Column, h: Column) -> Column:
    """Whether all slots of a text were used at least twice."""
    twice = lambda slot: F.call_function(
        "shiftrightunsigned",
        F.get(counters, F.floor(slot / PER_LONG).cast("int")),
        (2 * (slot % PER_LONG)).cast("int"),
    ).bitwiseAND(F.lit(3)) >= 2
    return F.coalesce(F.forall(_slots(h), twice), F.lit(False))


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, part, mask`` of every row; a null text counts as empty, a null lang as ''.

    Bit 16 of the mask tells that a row with a smaller ``doc_id`` has the same text. A row
    without id is no copy and has no copies; rows alike in id are no copies of each other.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.col("lang"), F.lit("")).alias("part")
    h, h2 = digest(text)
    rows = docs.count()
    blocks = min(max(1, -(-rows // limits.rows_per_block)), limits.most_blocks)
    seen = docs.where(F.col("doc_id").isNotNull()).select(h.alias("h"))
    used = F.broadcast(sketch(seen, blocks))  # at most most_blocks rows of 64 bytes
    hashed = docs.select("doc_id", part, text.alias("text"), h.alias("h"), F.pmod(h, F.lit(blocks)).alias("block"))
    judged = hashed.join(used, "block", "left").select(
        "doc_id", "part", "h", text_failures(F.col("text"), limits).alias("mask"),
        F.when(F.col("doc_id").isNotNull() & _may_repeat(F.col("counters"), F.col("h")), F.col("text")).alias("text"),
    )
    judged = stored(judged.withColumn("h2", F.when(F.col("text").isNotNull(), F.xxhash64(F.lit(1), "text"))))
    # The text itself decides; its hashes only make the way back to the rows short.
    by_text = judged.where("text is not null").groupBy("h", "h2", "text").agg(F.min("doc_id").alias("first"))
    alone = by_text.groupBy("h", "h2").agg(F.min("first").alias("first"), F.count("*").alias("texts"))
    alone = stored(alone)
    key = ["h", "h2"]
    firsts = alone.select(*key, "first")
    if not alone.where("texts > 1").isEmpty():  # two texts with the same 128 bits
        key = ["h", "h2", "text"]
        firsts = by_text
    copy = F.when(F.col("doc_id") > F.col("first"), COPY).otherwise(0)
    return (
        judged.select("doc_id", "part", "mask", *key)
        .join(firsts, key, "left")
        .select("doc_id", "part", F.col("mask").bitwiseOR(copy).alias("mask"))
    )


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: rows, and those with a label of quality 1 or toxic 1.

    Of several labels of one document any counts; labels without id belong to none.
    """
    told = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    units = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    return (
        units.join(told, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"),
            F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"),
        )
    )


def _steps() -> Column:
    """All orders and steps as an array of fixed values: order, step, bits before, own bit."""
    steps = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << NAMES.index(name)
            steps.append(f"named_struct('filter_order', '{order}', 'step', {step}, 'before', {before}, 'own', {own})")
            before |= own
    return F.expr(f"array({', '.join(steps)})")


def interactions(counts: DataFrame) -> DataFrame:
    """Per part, order and step what the filter removes, from counts per mask.

    ``shapley`` is exact without going through the orders: of the orders of all filters, a
    document that fails ``m`` of them meets each of these first in 120 / m.
    """
    each = counts.select("*", F.explode(_steps()).alias("s")).select("part", "mask", "n", "good", "toxic", "s.*")
    fails = F.col("mask").bitwiseAND(F.col("own")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda condition, value: F.sum(F.when(condition, value).otherwise(0)).cast("long")
    share = F.expr(f"n * ({len(ORDERS)} div greatest(1, bit_count(mask)))")
    return each.groupBy("part", "filter_order", "step").agg(
        total(~gone & ~fails, F.col("n")).alias("kept"),
        total(~gone & fails, F.col("n")).alias("removed"),
        total(gone & fails, F.col("n")).alias("redundant"),
        total(F.col("mask") == F.col("own"), F.col("n")).alias("unique_fails"),
        total(~gone & fails, F.col("good")).alias("good_lost"),
        total(~gone & fails, F.col("toxic")).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The interactions of the five filters on ``docs``, per value of ``lang``.

    Empty texts fail A alone, and E where a smaller id has an empty text too. Repeated rows
    count as often as they occur. An empty table gives an empty result; further columns of
    either table are not read.
    """
    return interactions(mask_counts(failures(docs, limits), labels))
