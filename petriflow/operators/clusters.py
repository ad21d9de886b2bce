"""Per-cluster metrics of a cell table (cell_id, label, time, x, y, intden, area)."""

from __future__ import annotations

from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from petriflow.operators.scan import joined, placed

KEY = ("label", "time")


def with_groups(df: DataFrame, groups: DataFrame, *key: str) -> DataFrame:
    """df with the other columns of groups, which has one row a key (null keys are keys); a small side, that need not sort or move df."""
    own = groups.select(*[F.col(k).alias(f"_{k}") for k in key], *[c for c in groups.columns if c not in key])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    return df.join(own, same).drop(*[f"_{k}" for k in key])


def enrich(cells: DataFrame, *key: str, norm: bool = False) -> DataFrame:
    """With centroid (cx, cy) and distance to it; norm: and norm_dist, the distance over the largest in the cluster."""
    key = key or KEY
    out = with_groups(cells, cells.groupBy(*key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")), *key)
    out = out.withColumn("dist", F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2))
    if not norm:
        return out
    out = with_groups(out, out.groupBy(*key).agg(F.max("dist").alias("_far")), *key)
    return out.withColumn("norm_dist", F.when(F.col("_far") > 0, F.col("dist") / F.col("_far")).otherwise(0.0)).drop("_far")


def geometric_mean(c: str) -> Column:
    """Of the positive values."""
    return F.exp(F.avg(F.when(F.col(c) > 0, F.ln(c))))


def intensity(cells: DataFrame, min_cells: int = 2) -> DataFrame:
    """Intensity block of each cluster and time with min_cells or more cells."""
    out = enrich(cells).groupBy(*KEY).agg(
        F.count("*").alias("n_cells"), F.avg("intden").alias("mean_intensity"), geometric_mean("intden").alias("geo_mean_intensity"),
        F.sum("intden").alias("total_intensity"), F.stddev_samp("intden").alias("std_intensity"),
        F.try_divide(F.sum("intden"), F.sum("area")).alias("intensity_per_area"), F.max("dist").alias("max_distance"), F.try_divide(F.covar_pop("dist", "intden"), F.stddev_pop("dist") * F.stddev_pop("intden")).alias("corr_distance"),
    )
    return out.where(F.col("n_cells") >= min_cells)


def radial_profile(cells: DataFrame, n_bins: int = 20) -> DataFrame:
    """Mean intensity in n_bins - 1 half-open rings of normalised distance; empty rings are 0, the farthest cell is in none."""
    rings = enrich(cells, norm=True).where("norm_dist < 1").withColumn("ring", F.floor(F.col("norm_dist") * (n_bins - 1)).cast("int"))
    means = rings.groupBy(*KEY, "ring").agg(F.avg("intden").alias("mean_intensity"))
    every = cells.select(*KEY).distinct().withColumn("ring", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 2))))
    return every.join(means, [*KEY, "ring"], "left").withColumn("mean_intensity", F.coalesce("mean_intensity", F.lit(0.0)))


def pairs_in_time(metrics: DataFrame) -> DataFrame:
    """Each pair of clusters of a time, as aliases a and b with a.label < b.label."""
    return metrics.alias("a").join(metrics.alias("b"), F.expr("a.time = b.time and a.label < b.label"))


def compare(metrics: DataFrame, *cols: str) -> DataFrame:
    """Absolute differences of metric columns between clusters of the same time."""
    diff = [F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")).alias(f"{c}_diff") for c in cols]
    return pairs_in_time(metrics).select("a.time", F.col("a.label").alias("label_a"), F.col("b.label").alias("label_b"), *diff)


def histogram_overlap(cells: DataFrame, col: str = "intden", bins: int = 50) -> DataFrame:
    """Histogram intersection of two clusters of a time; bins span the first one's range, the second counts only inside it."""
    span = cells.groupBy(*KEY).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    ab = pairs_in_time(span).select("a.time", F.col("a.label").alias("la"), F.col("b.label").alias("lb"), F.col("a.lo").alias("lo"), F.col("a.hi").alias("hi"))
    v = cells.select(F.col("time").alias("t"), F.col("label").alias("l"), F.col(col).alias("v"))
    both = ab.join(v, F.expr("time = t and (l = la or l = lb) and v between lo and hi"))
    where = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    key = ["time", "la", "lb"]
    counts = both.groupBy(*key, where.alias("bin")).agg(F.sum((F.col("l") == F.col("la")).cast("int")).alias("p"), F.sum((F.col("l") == F.col("lb")).cast("int")).alias("q"))
    w = Window.partitionBy(*key)
    share = counts.withColumn("p", F.col("p") / F.sum("p").over(w)).withColumn("q", F.try_divide(F.col("q"), F.sum("q").over(w)))
    return share.groupBy(*key).agg(F.sum(F.least(F.col("p"), F.coalesce("q", F.lit(0.0)))).alias("overlap")).withColumnsRenamed({"la": "label_a", "lb": "label_b"})


def summary(cells: DataFrame, *key: str) -> DataFrame:
    """Arithmetic and geometric means of intensity and size, summed size, number of cells and centroid of each cluster."""
    return cells.groupBy(*(key or KEY)).agg(
        F.avg("intden").alias("mean_intensity"), geometric_mean("intden").alias("geo_intensity"), F.avg("area").alias("mean_size"), geometric_mean("area").alias("geo_size"),
        F.sum("area").alias("dimension"), F.count("*").alias("n_cell"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )


def means_join(cells: DataFrame) -> DataFrame:
    """Mean of every measure joined with the summary on cluster and time."""
    means = cells.groupBy(*KEY).agg(*[F.avg(c).alias(f"avg_{c}") for c in ("x", "y", "intden", "area")])
    return means.join(summary(cells).select(*KEY, "n_cell", "dimension"), [*KEY], "inner")


def merge_stats(summaries: DataFrame, *key: str) -> DataFrame:
    """Statistics of clusters taken together: means weighted by cells, geometric means by their logarithms, summed dimension."""
    n = F.col("n_cell")
    geo = lambda c: F.exp(F.sum(n * F.ln(c)) / F.sum(n))
    return summaries.groupBy(*key).agg(
        (F.sum(n * F.col("mean_intensity")) / F.sum(n)).alias("mean_intensity"), geo("geo_intensity").alias("geo_intensity"), (F.sum(n * F.col("mean_size")) / F.sum(n)).alias("mean_size"), geo("geo_size").alias("geo_size"),
        F.sum("dimension").alias("dimension"), F.sum(n).alias("total_cells"), (F.sum(n * F.col("cx")) / F.sum(n)).alias("cx"), (F.sum(n * F.col("cy")) / F.sum(n)).alias("cy"),
    )


def pca_axes(cells: DataFrame, *key: str) -> DataFrame:
    """Aspect ratio and orientation (0 to pi) of the principal axes of each cluster, from its 2 x 2 covariance."""
    out = cells.groupBy(*(key or KEY)).agg(F.count("*").alias("n_cells"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy")).where("n_cells >= 3")
    mid, gap = (F.col("vx") + F.col("vy")) / 2, F.sqrt(((F.col("vx") - F.col("vy")) / 2) ** 2 + F.col("vxy") ** 2)
    aspect = F.when(mid - gap > 0, F.sqrt((mid + gap) / (mid - gap))).otherwise(1.0)
    turn = F.lit(0.5) * F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy"))
    return out.select(*(key or KEY), "n_cells", aspect.alias("aspect_ratio"), F.pmod(turn, F.pi()).alias("orientation"))


def angle_difference(a: Column, b: Column) -> Column:
    """Difference of two axis directions, 0 to pi / 2."""
    d = F.pmod(F.abs(a - b), F.pi())
    return F.least(d, F.pi() - d)


def feature_block(cells: DataFrame) -> DataFrame:
    """Centroid, radius, density, size, eccentricity and orientation of each cluster."""
    e = enrich(cells).groupBy(*KEY).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.max("dist").alias("radius"), F.count("*").alias("size"))
    axes = pca_axes(cells)
    dens = F.col("size") / (F.pi() * F.col("radius") ** 2 + F.lit(1e-10))
    ecc = F.sqrt(1 - 1 / F.col("aspect_ratio") ** 2)
    return e.join(axes, [*KEY]).select(*KEY, "cx", "cy", "radius", "size", dens.alias("density"), ecc.alias("eccentricity"), "orientation")


def gyration(cells: DataFrame) -> DataFrame:
    """Radius of gyration, bounding-box size, and number of cells of each cluster."""
    box = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    return enrich(cells).groupBy(*KEY).agg(F.count("*").alias("n_cells"), F.sqrt(F.avg(F.col("dist") ** 2)).alias("gyration"), box.alias("box_size"))


def temporal_series(cells: DataFrame, times: tuple[int, int] | None = None) -> DataFrame:
    """Per cluster and time: cells, mean intensity, total area, density, centroid and radius."""
    if times:
        cells = cells.where(F.col("time").between(*times))
    out = enrich(cells).groupBy(*KEY).agg(F.count("*").alias("n_cells"), F.avg("intden").alias("mean_intensity"), F.sum("area").alias("total_area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.max("dist").alias("radius"))
    return out.withColumn("density", F.try_divide(F.col("n_cells"), F.col("total_area")))


def temporal_rates(series: DataFrame) -> DataFrame:
    """Mean rates of change of each cluster seen at two times or more."""
    w = Window.partitionBy("label").orderBy("time")
    dt = F.col("time") - F.lag("time").over(w)
    step = lambda c: (F.col(c) - F.lag(c).over(w)) / dt
    grow = (F.log1p("n_cells") - F.lag(F.log1p("n_cells")).over(w)) / dt
    move = F.sqrt((F.col("cx") - F.lag("cx").over(w)) ** 2 + (F.col("cy") - F.lag("cy").over(w)) ** 2) / dt
    steps = series.select("label", grow.alias("g"), step("mean_intensity").alias("i"), step("total_area").alias("a"), move.alias("s"))
    return steps.groupBy("label").agg(F.count("*").alias("n_times"), F.avg("g").alias("growth_rate"), F.avg("i").alias("intensity_rate"), F.avg("a").alias("area_rate"), F.avg("s").alias("speed")).where("n_times >= 2")


def member_stats(members: DataFrame, cols: list[str], *key: str) -> DataFrame:
    """Number, means and population deviations of the members of each cluster."""
    aggs = [f(c).alias(f"{n}_{c}") for c in cols for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))]
    return members.groupBy(*key).agg(F.count("*").alias("n_members"), *aggs)


def sample_counts(nuclei: DataFrame, *key: str) -> DataFrame:
    """Clusters, nuclei, and the centroid of clusters weighted by their nuclei, of each sample (sample, cluster, cx, cy)."""
    per = nuclei.groupBy(*key, "cluster").agg(F.count("*").alias("n"), F.avg("cx").alias("x"), F.avg("cy").alias("y"))
    weighted = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    return per.groupBy(*key).agg(F.count("*").alias("n_clusters"), F.sum("n").alias("n_nuclei"), weighted("x"), weighted("y"))


def normal_plot(df: DataFrame, col: str, ident: str, *key: str) -> DataFrame:
    """Values by rank with the normal quantile of Filliben's estimate of the median of their rank's position; no key is sorted in one task.

    Null values take no part; of one value the quantile is 0."""

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        inverse = NormalDist().inv_cdf
        return pd.Series([inverse(x) for x in p])

    known = df.where(F.col(col).isNotNull()).select(*key, ident, F.col(col).alias("value"))
    n = known.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    ranked = joined(placed(known, ["value", ident], *key), n, list(key))
    last = F.pow(F.lit(0.5), 1 / F.col("_n"))
    p = F.when(F.col("_n") == 1, 0.5).when(F.col("place") == F.col("_n"), last).when(F.col("place") == 1, 1 - last).otherwise((F.col("place") - 0.3175) / (F.col("_n") + 0.365))
    return ranked.withColumn("quantile", quantile(p)).drop("place", "_n")


def plot_fit(plot: DataFrame, *key: str) -> DataFrame:
    """(key, slope, intercept, r) of the line through a probability plot; r tells how well the law fits."""
    found = plot.groupBy(*key).agg(F.regr_slope("value", "quantile").alias("slope"), F.regr_intercept("value", "quantile").alias("intercept"), F.sqrt(F.regr_r2("value", "quantile")).alias("r"))
    return found


def probability_plot(df: DataFrame, col: str, ident: str, *key: str) -> DataFrame:
    """Values by rank with the exponential quantile of their plotting position (rank - 1/2) / n."""
    w = Window.partitionBy(*key)
    p = (F.row_number().over(w.orderBy(col, ident)) - 0.5) / F.count(F.lit(1)).over(w)
    return df.where(F.col(col).isNotNull()).select(*key, ident, F.col(col).alias("value"), (-F.ln(1 - p)).alias("quantile"))
