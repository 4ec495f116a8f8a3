"""Mix sources to target weights by pivotal dependent rounding.

Each document gets a number of copies whose mean is its source's target over the source's
size. The whole part is certain. The fractional parts are rounded dependently: two documents
duel, one gives as much of its mass (probability times size) to the other as makes one of
them integral, at random and without changing either mean. The winner duels on. Documents
duel in small groups, the one open document of each group goes up to a group of such, and
so on: a reduction tree. So of each source no more than one document stays open, and the
words taken miss the target by no more than that document's size.

Only column functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import fresh, stored
from .quality_rules import SEPARATORS, WORD_BREAK


@dataclass(frozen=True)
class Mix:
    """``weights`` go to the sources in the order of their code points, repeating, null last."""

    weights: tuple[int, ...] = (1, 2, 3)
    most_copies: int = 3
    group_size: int = 256  # documents that duel in one group
    seed: int = 7


def n_words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(bare == "", 0).otherwise(F.regexp_count(bare, F.lit(WORD_BREAK)) + 1).cast("long")


def source_targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Per source: ``source``, ``source_size``, ``target`` (words) and ``n`` documents.

    Targets share the sum of all sizes by weight; none exceeds ``most_copies`` times its
    source's size, what is cut off goes to the others by weight. That is one level such
    that each target is the lesser of its bound and weight times level. Sources are few
    beside documents: one row each is ranked and summed.
    """
    totals = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n")
    )
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(w) for w in mix.weights])
    weighted = totals.withColumn("weight", F.get(weights, (rank % len(mix.weights)).cast("int")))
    bounded = weighted.withColumn("bound", mix.most_copies * F.col("source_size"))
    # In the order in which sources reach their bounds: level if exactly those before are bound.
    order = Window.orderBy(F.col("bound") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("bound").over(before), F.lit(0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levelled = bounded.withColumn("level", level)
    fits = F.col("level") * F.col("weight") <= F.col("bound")
    final = F.max(F.when(fits, F.col("level"))).over(whole)  # the first that fits is the highest
    return levelled.withColumn(
        "target", F.least(F.col("bound").cast("double"), F.col("weight") * final)
    ).select("source", "source_size", "n", F.coalesce("target", F.lit(0.0)).alias("target"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``doc_id, source, fingerprint, size, times, source_size, target, copies`` of documents.

    One row for the rows of ``docs`` alike in id, source and text (``fingerprint`` is a hash of
    it); there are ``times`` of them, and each gets as many ``copies``. So reruns agree,
    whatever the order of the rows. A null source is a source of its own. A null or empty text
    has size 0 and gets the whole copies of its source's rate; a source without any word has
    the target 0 and no copies. An empty table gives an empty result.
    """
    units = stored(
        docs.select(
            "source",
            "doc_id",
            F.xxhash64("text").alias("fingerprint"),
            n_words(F.col("text")).alias("size"),
        )
        .groupBy("source", "doc_id", "fingerprint", "size")
        .agg(F.count("*").alias("times"))
    )
    sizes = units.select("source", (F.col("size") * F.col("times")).alias("size"))
    rate = F.coalesce(F.col("target") / F.nullif("source_size", F.lit(0)), F.lit(0.0))
    whole = F.least(F.floor(rate + 1e-9), F.lit(mix.most_copies).cast("long"))
    targets = stored(
        source_targets(sizes, mix)
        .withColumn("whole", whole)
        .withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    )
    rated = _with_targets(units, targets).withColumn(
        "item", F.struct("doc_id", "fingerprint", "size", "times")
    )
    rated = rated.withColumn("mass", (F.col("size") * F.col("times")).cast("double"))
    open_units = (F.col("mass") > 0) & (F.col("p") > 1e-9)
    settled = rated.filter(~open_units).select("source", "item", F.lit(0).alias("extra"))
    longest = targets.agg(F.max("n")).first()[0] or 0
    rounded = _rounded(
        rated.filter(open_units).select("source", "n", "item", "mass", "p"), longest, mix
    )
    decided = _with_targets(settled.unionByName(rounded), targets)
    return decided.select(
        "item.doc_id", "source", "item.fingerprint", "item.size", "item.times",
        "source_size", "target", (F.col("whole") + F.col("extra")).alias("copies"),
    )


# Up to this number of sources their targets are sent to every task; more are joined by a shuffle.
FEW_SOURCES = 10_000


def _with_targets(frame: DataFrame, targets: DataFrame) -> DataFrame:
    few = targets.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    right = targets.withColumnRenamed("source", "target_source")
    same = F.col("source").eqNullSafe(F.col("target_source"))
    return frame.join(F.broadcast(right) if few else right, same).drop("target_source")


def _rounded(units: DataFrame, longest: int, mix: Mix) -> DataFrame:
    """``source, item, extra``: 0 or 1 for every unit, by levels of duels."""
    level, open_units = 0, units.withColumn("groups", F.ceil(F.col("n") / mix.group_size))
    most = -(-longest // mix.group_size)
    results = []
    while True:
        dealt = F.pmod(F.xxhash64("item", F.lit(mix.seed + level)), "groups")
        # Large documents duel first, so that the one left open at the end is small.
        unit = F.struct((-F.col("mass")).alias("order"), "item", "mass", "p")
        duelled = stored(
            open_units.groupBy("source", "groups", dealt.alias("bucket"))
            .agg(F.array_sort(F.collect_list(unit)).alias("units"))
            .withColumn("units", F.transform("units", lambda u: u.dropFields("order")))
            .select("source", "groups", _duels(F.col("units"), mix.seed + level).alias("end"))
        )
        results.append(
            duelled.select("source", F.explode("end.done").alias("done")).select(
                "source", "done.item", "done.extra"
            )
        )
        open_units = duelled.select("source", "groups", "end.open.*")
        if most <= 1:
            break
        level, most = level + 1, -(-most // mix.group_size)
        open_units = open_units.withColumn("groups", F.ceil(F.col("groups") / mix.group_size))
    last = _uniform("item", F.lit(mix.seed)) < F.col("p")
    results.append(open_units.select("source", "item", last.cast("int").alias("extra")))
    rounded = results[0]
    for more in results[1:]:
        rounded = rounded.unionByName(more)
    return rounded


def _uniform(*columns) -> Column:
    """A number from 0 to under 1, the same at every run."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 53)) / float(1 << 53)


def _with(value: Column, use) -> Column:
    """``use(value)``, with the value computed once although used several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _duels(units: Column, seed: int) -> Column:
    """Fold the units of a group: those settled in ``done``, the last one standing in ``open``."""
    nothing = F.array().cast(
        "array<struct<item:struct<doc_id:bigint,fingerprint:bigint,size:bigint,times:bigint>,extra:int>>"
    )
    start = F.struct(F.get(units, F.lit(0)).alias("open"), nothing.alias("done"))
    return F.aggregate(
        F.slice(units, 2, F.size(units)), start, lambda state, unit: _duel(state, unit, seed)
    )


def _duel(state: Column, b: Column, seed: int) -> Column:
    a = state["open"]
    moves = F.struct(
        F.least((1 - a["p"]) * a["mass"], b["p"] * b["mass"]).alias("up"),
        F.least(a["p"] * a["mass"], (1 - b["p"]) * b["mass"]).alias("down"),
        _uniform(a["item"], b["item"], F.lit(seed)).alias("u"),
    )

    def transfer(m: Column) -> Column:
        to_a = m["u"] * (m["up"] + m["down"]) < m["down"]
        mass = F.when(to_a, m["up"]).otherwise(-m["down"])
        return F.struct(
            _clean(a["p"] + mass / a["mass"]).alias("a"), _clean(b["p"] - mass / b["mass"]).alias("b")
        )

    def settle(p: Column) -> Column:
        a_settled = (p["a"] == 0) | (p["a"] == 1)

        def result(unit: Column, mean: Column) -> Column:
            return F.struct(unit["item"].alias("item"), F.round(mean).cast("int").alias("extra"))

        def left(unit: Column, mean: Column) -> Column:
            return F.struct(unit["item"].alias("item"), unit["mass"].alias("mass"), mean.alias("p"))

        return F.struct(
            F.when(a_settled, left(b, p["b"])).otherwise(left(a, p["a"])).alias("open"),
            F.array_append(
                state["done"], F.when(a_settled, result(a, p["a"])).otherwise(result(b, p["b"]))
            ).alias("done"),
        )

    return _with(_with(moves, transfer), settle)


def _clean(p: Column) -> Column:
    return F.when(p < 1e-9, 0.0).when(p > 1 - 1e-9, 1.0).otherwise(p)


def with_copies(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Rows of ``docs`` that the mix takes, with the number of ``copies`` as a last column.

    Should ``docs`` have a column ``copies``, the new one gets underscores in front.
    """
    key, copies = fresh(docs, "fingerprint", "copies")
    units = mixed(docs, mix).where("copies > 0").select(
        F.col("doc_id").alias("u_id"), F.col("source").alias("u_source"),
        F.col("fingerprint").alias("u_key"), F.col("copies").alias("u_copies"),
    )
    same = (
        (F.col(key) == F.col("u_key"))
        & F.col("doc_id").eqNullSafe(F.col("u_id"))
        & F.col("source").eqNullSafe(F.col("u_source"))
    )
    joined = docs.withColumn(key, F.xxhash64("text")).join(units, same)
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("u_copies").alias(copies))
