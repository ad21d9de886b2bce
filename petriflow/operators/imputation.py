"""Gap filling, as-of lookups, schedules, imputation and forecasts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from petriflow.functions.numeric import spline


def gap_fill(series: DataFrame) -> DataFrame:
    """Each label's times from first to last; measures of added rows are null."""
    span = series.groupBy("label").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    every = span.select("label", F.explode(F.sequence(F.col("lo").cast("int"), F.col("hi").cast("int"))).alias("time"))
    return every.join(series, ["label", "time"], "left")


def missing_times(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """(label, time) of clusters without cells."""
    return clusters.select("label", "time").distinct().join(cells.select("label", "time").distinct(), ["label", "time"], "left_anti")


def last_alive(wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """As-of lookup: the last time up to the wanted one at which the label was seen; one window over both sides."""
    both = wanted.select("label", "time", F.lit(None).cast("int").alias("at"), F.lit(1).alias("asks")).union(seen.select("label", "time", F.col("time").cast("int").alias("at"), F.lit(0).alias("asks")).distinct())
    w = Window.partitionBy("label").orderBy("time", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("last_time", F.last("at", ignorenulls=True).over(w)).where("asks = 1").select("label", "time", "last_time")


def linear_fill(series: DataFrame, col: str) -> DataFrame:
    """Nulls between known values filled along the line between them."""
    w = Window.partitionBy("label").orderBy("time")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(col).isNotNull(), F.col("time"))
    t0, t1 = F.last(known, True).over(back), F.first(known, True).over(ahead)
    v0, v1 = F.last(col, True).over(back), F.first(col, True).over(ahead)
    return series.withColumn(col, F.coalesce(col, v0 + (v1 - v0) * (F.col("time") - t0) / (t1 - t0)))


def spline_fill(series: DataFrame, *cols: str) -> DataFrame:
    """Columns of each label replaced by the cubic spline through their known values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("time").reset_index(drop=True)
        for c in cols:
            known = pdf[c].notna()
            if known.sum() > 1:
                pdf[c] = spline(pdf["time"][known].to_numpy(float), pdf[c][known].to_numpy(float), pdf["time"].to_numpy(float))
        return pdf

    return series.groupBy("label").applyInPandas(run, series.schema)


def spline_resample(series: DataFrame, col: str) -> DataFrame:
    """(label, at, value): each label's spline on int(last time) evenly spaced times."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=[col]).sort_values("time")
        if len(pdf) < 2:
            return pd.DataFrame({"label": [], "at": [], "value": []})
        t = pdf["time"].to_numpy(float)
        at = np.linspace(t[0], t[-1], max(2, int(t[-1])))
        return pd.DataFrame({"label": int(pdf["label"].iloc[0]), "at": at, "value": spline(t, pdf[col].to_numpy(float), at)})

    return series.select("label", "time", col).groupBy("label").applyInPandas(run, "label int, at double, value double")


def piecewise(t: Column, knots: list[tuple[float, float]]) -> Column:
    """The value at t of the line through the knots; ends are held."""
    xs, ys = zip(*sorted(knots), strict=True)
    value = F.when(t <= xs[0], F.lit(float(ys[0])))
    for x0, x1, y0, y1 in zip(xs, xs[1:], ys, ys[1:], strict=False):
        value = value.when(t <= x1, y0 + (t - x0) * (float(y1 - y0) / float(x1 - x0)))
    return value.otherwise(float(ys[-1]))


def schedule(spark: SparkSession, knots: list[tuple[float, float]], start: int, end: int) -> DataFrame:
    """(t, value): a piecewise-linear schedule at t = start..end; ends are held."""
    return spark.range(start, end + 1).select(F.col("id").cast("int").alias("t")).withColumn("value", piecewise(F.col("t").cast("double"), knots))


def draw(seed: int, *cols: str) -> Column:
    """A number under 2**31 - 1 that the seed and the columns' whole numbers decide: two steps of a multiplicative hash."""
    prime, x = (1 << 31) - 1, F.lit(seed + 1).cast("long")
    for c in cols:
        x = F.pmod((x * 48_271 + F.col(c)) * 69_621, F.lit(prime).cast("long"))
    return F.pmod(x * 48_271, F.lit(prime).cast("long"))


def impute_missing(cells: DataFrame, wanted: DataFrame, seed: int | None = None) -> DataFrame:
    """Cells for wanted (label, time, n_cell, dx, dy): copies of the label's cells at its last time seen, n_cell of them, moved by (dx, dy).

    Without a seed the first by cell_id (round and round if there are too few), else drawn with replacement by hash of seed and place."""
    source = last_alive(wanted, cells).where("last_time is not null").join(wanted, ["label", "time"])
    order = Window.partitionBy("label", "time").orderBy("cell_id")
    pool = cells.withColumn("_k", F.row_number().over(order) - 1).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy("label", "time")))
    sizes = pool.select("label", F.col("time").alias("last_time"), "_of").distinct()
    wanted_places = source.join(sizes, ["label", "last_time"]).where("n_cell > 0")
    places = wanted_places.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n_cell").cast("int") - 1)))
    pick = F.pmod(F.col("_i"), F.col("_of")) if seed is None else draw(seed, "label", "time", "_i") % F.col("_of")
    places = places.withColumn("_k", pick.cast("int"))
    from_ = pool.withColumnRenamed("time", "last_time").drop("_of")
    out = places.drop("_of").join(from_, ["label", "last_time", "_k"])
    return out.select("cell_id", "label", "time", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "intden", "area", "_i").withColumnRenamed("_i", "copy")


def impute_series(cells: DataFrame, selected: tuple[int, ...] = (), seed: int | None = None, smooth: bool = True) -> DataFrame:
    """The cells and those imputed, with `copy` (null for given cells): each time between a label's first and last at which it has no cells gets
    copies of its cells at the last time seen, as many as the series of its sizes says there, moved as its centre moves.

    selected: the labels to impute, all if empty; smooth: series are filled by splines, else along lines; seed: as in impute_missing. Sizes are
    cut to whole numbers and not below zero. Labels seen at one time only have nothing between."""
    sizes = cells.groupBy("label", "time").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    filled = gap_fill(sizes.where(F.col("label").isin(*selected)) if selected else sizes)
    if smooth:
        filled = spline_fill(filled, "n", "cx", "cy")
    else:
        for c in ("n", "cx", "cy"):
            filled = linear_fill(filled, c)
    gone = last_alive(missing_times(filled, cells), sizes)
    before = sizes.select("label", F.col("time").alias("last_time"), F.col("cx").alias("bx"), F.col("cy").alias("by"))
    moved = gone.join(filled, ["label", "time"]).join(before, ["label", "last_time"])
    wanted = moved.select("label", "time", F.greatest(F.lit(0), F.col("n").cast("int")).alias("n_cell"), (F.col("cx") - F.col("bx")).alias("dx"), (F.col("cy") - F.col("by")).alias("dy"))
    return cells.withColumn("copy", F.lit(None).cast("int")).unionByName(impute_missing(cells, wanted, seed), allowMissingColumns=True)


def decay_rate(series: DataFrame) -> DataFrame:
    """ln(first / last) over the time between, of each label's number of cells."""
    s = series.groupBy("label").agg(F.min_by("n_cells", "time").alias("n1"), F.max_by("n_cells", "time").alias("n2"), F.min("time").alias("t1"), F.max("time").alias("t2"))
    return s.where("t2 > t1").select("label", (F.ln(F.col("n1") / F.col("n2")) / (F.col("t2") - F.col("t1"))).alias("rate"))


def death_process(spark: SparkSession, start: int, rate: float, until: float, runs: int, seed: int = 1) -> DataFrame:
    """(run, step, at, alive): exact stochastic simulation of a death process, a run a row of the input, seeded by run."""

    def simulate(batches):
        for pdf in batches:
            for run in pdf["id"].tolist():
                rng, t, n, out = np.random.default_rng((seed, run)), 0.0, start, []
                while n > 0:
                    t += rng.exponential(1 / (rate * n))
                    if t > until:
                        break
                    n -= 1
                    out.append((run, start - n, t, n))
                yield pd.DataFrame(out, columns=["run", "step", "at", "alive"])

    return spark.range(runs).mapInPandas(simulate, "run long, step int, at double, alive int")
