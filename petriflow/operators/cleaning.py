"""Filters, relabelling, ring and histogram cuts."""

from __future__ import annotations

import warnings
from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petriflow.operators.clusters import enrich
from petriflow.operators.scan import BLOCK, in_blocks, placed


def outside_boxes(cells: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Rows outside all closed boxes (x0, x1, y0, y1)."""
    for x0, x1, y0, y1 in boxes:
        cells = cells.where(~(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)))
    return cells


def trim_outliers(cells: DataFrame, half: float = 1000.0, *key: str) -> DataFrame:
    """Rows within `half` of their label's centroid on both axes; the centroid is taken before trimming."""
    w = Window.partitionBy(*(key or ("label",)))
    out = cells.withColumn("_cx", F.avg("x").over(w)).withColumn("_cy", F.avg("y").over(w))
    return out.where((F.abs(F.col("x") - F.col("_cx")) <= half) & (F.abs(F.col("y") - F.col("_cy")) <= half)).drop("_cx", "_cy")


def closer_than(cells: DataFrame, reach: float) -> DataFrame:
    """Rows nearer than `reach` to their label's centroid."""
    return enrich(cells, "label").where(F.col("dist") < reach)


def slice_times(times: DataFrame, start: int, end: int, step: int = 1) -> DataFrame:
    """Rows of the times whose place in the sorted list of times is in range(start, end, step). An end beyond the last time warns, a start
    beyond it raises ValueError."""
    count = times.agg(F.countDistinct("time")).first()[0]
    if start >= count:
        raise ValueError(f"the slice starts at time {start}, and there are {count}")
    if end > count:
        warnings.warn(f"the slice ends at time {end}, and there are {count}: it ends with the last one", stacklevel=2)
    known = times.select("time").distinct().withColumn("place", F.row_number().over(Window.orderBy("time")) - 1)
    wanted = known.where((F.col("place") >= start) & (F.col("place") < end) & ((F.col("place") - start) % step == 0))
    return times.join(wanted.select("time"), "time", "left_semi")


def remap(cells: DataFrame, changes: dict[int, int]) -> DataFrame:
    """Labels replaced by the mapping, others kept."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(changes.items())])
    return cells.withColumn("label", F.coalesce(table[F.col("label")], F.col("label")))


def relabel(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Labels replaced by a table (time, old, new); all renames of a time happen at once, so chains and swaps need no marks."""
    on = (cells["time"] == changes["time"]) & (cells["label"] == changes["old"])
    kept = [c for c in cells.columns if c != "label"]
    return cells.join(changes, on, "left").select(*[cells[c] for c in kept], F.coalesce(changes["new"], cells["label"]).alias("label"))


def dense_labels(cells: DataFrame) -> DataFrame:
    """Labels renumbered 0, 1, ... in order; the ranking runs over distinct labels only."""
    ranks = cells.select("label").distinct().withColumn("dense_label", (F.dense_rank().over(Window.orderBy("label")) - 1).cast("int"))
    return cells.join(ranks, "label")


def join_close_centroids(cells: DataFrame, near: float = 70.0, keep: int = 1) -> DataFrame:
    """(label, new_label): the smallest smaller label (but `keep`) whose centroid is within `near` on both axes, else itself."""
    c = cells.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    on = f"b.label < a.label and b.label <> {keep} and abs(a.cx - b.cx) < {near} and abs(a.cy - b.cy) < {near}"
    found = c.alias("a").join(c.alias("b"), F.expr(on), "left").groupBy("a.label").agg(F.min("b.label").alias("m"))
    return found.select("label", F.coalesce("m", "label").alias("new_label"))


def rings(cells: DataFrame, width: float = 7.5, *key: str) -> DataFrame:
    """Cells with their ring (from 1) around the centroid of `key`, and the ring's summed intensity over its area."""
    key = key or ("label",)
    out = enrich(cells, *key).withColumn("ring", F.greatest(F.lit(1), F.ceil(F.col("dist") / width)).cast("int"))
    area = F.pi() * width * width * (F.col("ring") * F.col("ring") - (F.col("ring") - 1) * (F.col("ring") - 1))
    return out.withColumn("ring_sum", F.sum("intden").over(Window.partitionBy(*key, "ring"))).withColumn("ring_ratio", F.col("ring_sum") / area)


def ring_filter(cells: DataFrame, width: float, least: float, until: int | None = None) -> DataFrame:
    """Cells of rings denser than `least`, ring by time, up to time `until`; later cells are all kept."""
    early = cells if until is None else cells.where(F.col("time") <= until)
    kept = rings(early, width, "time").where(F.col("ring_ratio") > least).select(*cells.columns)
    return kept if until is None else kept.unionByName(cells.where(F.col("time") > until))


def first_empty_bin(cells: DataFrame, width: float = 7.5, least: float = 100.0, *key: str) -> DataFrame:
    """(key, cut): left edge of the first empty bin at `least` or more in a histogram of distances with int(max / width) bins; null if none."""
    key = key or ("label",)
    e = enrich(cells, *key).select(*key, "dist")
    w = Window.partitionBy(*key)
    e = e.withColumn("lo", F.min("dist").over(w)).withColumn("hi", F.max("dist").over(w)).withColumn("bins", F.greatest(F.lit(1), F.floor(F.col("hi") / width)))
    size = (F.col("hi") - F.col("lo")) / F.col("bins")
    e = e.withColumn("size", size).withColumn("bin", F.when(F.col("size") > 1e-9, F.least(F.col("bins") - 1, F.floor((F.col("dist") - F.col("lo")) / F.col("size")))).otherwise(0))
    seen = e.groupBy(*key, "bin").agg(F.max("lo").alias("lo"), F.max("size").alias("size"))
    seen = seen.withColumn("next", F.lead("bin").over(Window.partitionBy(*key).orderBy("bin")))
    # the first empty bin after this one whose left edge is far enough
    start = F.greatest(F.col("bin") + 1, F.ceil((F.lit(least) - F.col("lo")) / F.col("size") - F.lit(1e-9)))
    gap = F.when((F.col("size") > 1e-9) & (start < F.col("next")), F.col("lo") + start * F.col("size"))
    return seen.groupBy(*key).agg(F.min(gap).alias("cut"))


def cut_at_empty_bin(cells: DataFrame, width: float = 7.5, least: float = 100.0, *key: str) -> DataFrame:
    """Cells up to the first empty bin of their key."""
    key = key or ("label",)
    cuts = first_empty_bin(cells, width, least, *key)
    return enrich(cells, *key).join(cuts, [*key]).where(F.col("cut").isNull() | (F.col("dist") <= F.col("cut")))


def moving_average(df: DataFrame, col: str, window: int, order: list, *key: str) -> DataFrame:
    """With `moving`: the mean of the last `window` rows in order, null until there are so many. A key's rows are sorted in one task, as suits
    series of times; scan.moving_average is for orders of cells."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(1 - window, 0)
    return df.withColumn("moving", F.when(F.count(F.lit(1)).over(w) == window, F.avg(col).over(w)))


def cumulative_derivative(cells: DataFrame, digits: int | None = None, block: int = BLOCK) -> DataFrame:
    """Cells by distance to their label's centroid: cumulative count and its derivative by second-order differences.

    Of cells at one distance the last stands for all, so that steps are positive; digits: distances are rounded to so many."""
    e = enrich(cells, "label")
    e = e if digits is None else e.withColumn("dist", F.round("dist", digits))
    e = e.groupBy("label", "dist").agg(F.count("*").alias("n"))
    e = in_blocks(placed(e, ["dist"], "label", total="n").withColumnRenamed("running", "cumulative"), 1, 1, block)
    w = Window.partitionBy("label", "block").orderBy("place")
    a, b = F.col("dist") - F.lag("dist").over(w), F.lead("dist").over(w) - F.col("dist")
    before, after = F.lag("cumulative").over(w), F.lead("cumulative").over(w)
    c = F.col("cumulative")
    inner = (a * a * after + (b * b - a * a) * c - b * b * before) / (a * b * (a + b))
    slope = F.when(a.isNull(), (after - c) / b).when(b.isNull(), (c - before) / a).otherwise(inner)
    return e.select("label", "dist", "cumulative", slope.alias("derivative"), "home").where("home").drop("home")
