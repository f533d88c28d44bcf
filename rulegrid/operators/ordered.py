"""Running sums, neighbours and runs along an order, safe for a hot group.

A plain window over a group that holds a third of all rows sorts that third in one task. Here rows are cut into blocks
of the order column; blocks are summed first, and only block totals are scanned per group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, keys: list[str], order: str, amount: Column, name: str, block: int = 1 << 12) -> DataFrame:
    """Adds `name`: the sum of `amount` over the rows of the same keys with a smaller `order` (an integer, unique per key).

    A null amount counts as 0. A group is scanned by blocks of `block` order values, so a task sees at most one block.
    """
    cut = rows.withColumns({"__block": F.floor(F.col(order) / block), "__amount": F.coalesce(amount, F.lit(0))})
    totals = cut.groupBy(*keys, "__block").agg(F.sum("__amount").alias("__total"))
    before = F.coalesce(F.sum("__total").over(Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.withColumn("__before", before).drop("__total")
    joined = cut.join(starts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__at"), "__before"), [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__block") == F.col("__at")])
    inside = F.coalesce(F.sum("__amount").over(Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return joined.withColumn(name, F.col("__before") + inside).drop("__block", "__amount", "__at", "__before", *[f"__{k}" for k in keys])


def gaps(rows: DataFrame, keys: list[str], number: str, most: int) -> DataFrame:
    """(keys, after, missing): numbers absent between two present ones of a group, where at most `most` are absent.

    Distinct numbers only; a group is bounded by its largest number.
    """
    present = rows.where(F.col(number).isNotNull()).select(*keys, number).distinct()
    ahead = F.lead(number).over(Window.partitionBy(*keys).orderBy(number))
    holes = present.withColumn("__next", ahead).where((F.col("__next") - F.col(number)).between(2, most + 1))
    return holes.select(*keys, F.col(number).alias("after"), F.explode(F.sequence(F.col(number) + 1, F.col("__next") - 1)).alias("missing"))


def previous(rows: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = 1 << 14) -> DataFrame:
    """Adds `name`: `value` of the row before in the `order` (an integer, unique per key) of the same keys, null for the first.

    Neighbours are found within blocks of `block` order values; the first row of a block looks at the last of the block
    before it, of which there is one row a block. Keys are compared as they stand; a null key is a group of its own.
    """
    cut = rows.withColumns({"__block": F.floor(F.col(order) / block), "__held": F.struct(value.alias("v"))})
    lasts = cut.groupBy(*keys, "__block").agg(F.max_by("__held", order).alias("__last"))
    before = F.lag("__last").over(Window.partitionBy(*keys).orderBy("__block"))
    ends = lasts.withColumn("__before", before).select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__block").alias("__at"), "__before")
    near = cut.withColumn("__near", F.lag("__held").over(Window.partitionBy(*keys, "__block").orderBy(order)))
    joined = near.join(ends, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__block") == F.col("__at")], "left")
    found = joined.withColumn(name, F.coalesce("__near", "__before")["v"])
    return found.drop("__block", "__held", "__near", "__at", "__before", *[f"__{k}" for k in keys])
