"""Running sums, ranks and neighbouring rows of long ordered groups, with no group sorted in one task.

Rows go to ranges of (key, order); each range counts its own rows, the counts of earlier ranges are carried to later ones, and rows know their place
in the group. Windows of neighbouring rows then work on blocks of places, with the rows around a block sent along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petriflow.operators.graph import checkpoint_dir

BLOCK = 1 << 16


def joined(df: DataFrame, small: DataFrame, on: Sequence[str]) -> DataFrame:
    """df with the other columns of `small` for equal `on`, null being equal to null."""
    if not on:
        return df.crossJoin(F.broadcast(small))  # one row
    other = small.select(*[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    same = F.col(on[0]).eqNullSafe(F.col("_on0"))
    for i, c in enumerate(on[1:], 1):
        same = same & F.col(c).eqNullSafe(F.col(f"_on{i}"))
    return df.join(other, same, "left").drop(*[f"_on{i}" for i in range(len(on))])


def placed(df: DataFrame, order: Sequence[str | Column], *key: str, total: str | None = None) -> DataFrame:
    """df with `place`, its rows' numbers from 1 in the order of their key, and `running`, the sum of column `total` up to the row, if one is given.

    Rows equal in all of `order` share a range, so it should tell rows apart. The ranges are written to the checkpoint folder, as a second
    reading might draw other borders; a key has one carried row for each range."""
    checkpoint_dir(df.sparkSession)
    ranges = df.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = [F.count(F.lit(1)).alias("_n"), *([F.sum(total).alias("_t")] if total else [])]
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.groupBy(*key, "_range").agg(*sums)
    carry = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("_n", *(["_t"] if total else []))]
    carried = carried.select(*key, "_range", *carry)
    inner = Window.partitionBy(*key, "_range").orderBy(*order)
    out = ranges.withColumn("_k", F.row_number().over(inner))
    if total:
        out = out.withColumn("_s", F.sum(total).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined(out, carried, [*key, "_range"]).withColumn("place", F.col("_k") + F.col("_n0"))
    if total:
        out = out.withColumn("running", F.col("_s") + F.col("_t0"))
    return out.drop("_range", "_k", "_n0", "_s", "_t0")


def in_blocks(df: DataFrame, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Rows with a `place`, in blocks (`block`) of at least `before` and `after` places; `home` is false for the rows that only surround a block."""
    size = max(block, before, after, 1)
    at, rest = F.floor((F.col("place") - 1) / size), F.pmod(F.col("place") - 1, F.lit(size))
    there = F.array(at, F.when(rest >= size - before, at + 1), F.when(rest < after, at - 1))
    return df.withColumn("block", F.explode(F.filter(there, lambda b: b.isNotNull()))).withColumn("home", F.col("block") == at)


def moving_average(df: DataFrame, col: str, window: int, order: Sequence[str | Column], *key: str, block: int = BLOCK) -> DataFrame:
    """With `moving`: the mean of the last `window` rows in the order of a key, null until there are so many."""
    p = in_blocks(placed(df, order, *key), window - 1, 0, block)
    w = Window.partitionBy(*key, "block").orderBy("place").rowsBetween(1 - window, 0)
    p = p.withColumn("moving", F.when(F.col("place") >= window, F.avg(col).over(w)))
    return p.where("home").drop("place", "block", "home")


def least_from_here(df: DataFrame, value: Column, name: str, block: int = BLOCK) -> DataFrame:
    """Rows with a `place`, with the least value of the row itself and of all later ones; blocks carry one number each."""
    b = df.withColumn("_v", value).withColumn("_block", F.floor((F.col("place") - 1) / block))
    later = Window.orderBy("_block").rowsBetween(1, Window.unboundedFollowing)  # one row for each block
    carried = b.groupBy("_block").agg(F.min("_v").alias("_m")).select("_block", F.min("_m").over(later).alias("_later"))
    inner = F.min("_v").over(Window.partitionBy("_block").orderBy("place").rowsBetween(0, Window.unboundedFollowing))
    out = joined(b.withColumn("_inner", inner), carried, ["_block"])
    return out.withColumn(name, F.least("_inner", "_later")).drop("_v", "_block", "_inner", "_later")
