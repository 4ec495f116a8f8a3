"""Outbound movements and the stock that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .checked import split_checked


def stock_after_outbound(inventory: DataFrame, outbound: DataFrame) -> DataFrame:
    """Every article with the quantity taken out and the quantity left.

    More may be taken out than is there: ``on_hand`` then is negative and
    ``short`` is true. Which order goes short is not decided here. ``oe`` must
    be unique in the inventory, as movements name it and not the article number.
    Movements of no, zero or negative quantity take nothing.
    """
    taken = outbound.filter("qty > 0").groupBy("oe").agg(F.sum("qty").alias("taken"))
    taken_out = F.coalesce("taken", F.lit(0).cast("long"))
    return inventory.join(taken, "oe", "left").select(
        *inventory.columns,
        taken_out.alias("taken_out"),
        (F.col("qty") - taken_out).alias("on_hand"),
        (F.col("qty") < taken_out).alias("short"),
    )


def check_outbound(inventory: DataFrame, outbound: DataFrame) -> DataFrame:
    """The movements with a ``reason`` to refuse them, null where they count.

    A movement names a part of the inventory and a quantity above zero.
    """
    known = inventory.select("oe", F.lit(True).alias("known"))
    return outbound.join(known, "oe", "left").select(
        *outbound.columns,
        F.when(F.col("known").isNull(), "unknown part")
        .when(F.col("qty").isNull(), "no quantity")
        .when(F.col("qty") <= 0, "not positive")
        .alias("reason"),
    )


def moved_stock(inventory: DataFrame, outbound: DataFrame) -> DataFrame:
    """The inventory with its own columns, ``qty`` less what was taken out."""
    kind = inventory.schema["qty"].dataType
    left = stock_after_outbound(inventory, outbound)
    return left.withColumn("qty", F.col("on_hand").cast(kind)).select(*inventory.columns)


def apply_outbound(
    inventory: DataFrame, outbound: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(inventory afterwards, outbound orders, rejects)``."""
    orders, rejects = split_checked(check_outbound(inventory, outbound))
    return moved_stock(inventory, outbound), orders, rejects
