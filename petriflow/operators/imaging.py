"""Tiles, stencils and quality metrics of images; pixels are rows (r, c, v), more columns may name the image."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def tile_coords(axes: DataFrame) -> DataFrame:
    """Overlapping tiles of each axis (axis, patch, overlap): crop, stitch and inner ranges, half open; the last tile ends with the axis.

    Stitch ranges cover the axis without overlap: each begins where the one before ends, in the middle of their overlap."""
    step = F.col("patch") - F.col("overlap")
    last = F.greatest(F.lit(1), F.col("axis") - F.col("overlap")) - 1
    t = axes.withColumn("start", F.explode(F.expr("sequence(0, greatest(1, axis - overlap) - 1, patch - overlap)"))).withColumn("tile", (F.col("start") / step).cast("int"))
    final = F.col("start") + step > last
    t = t.withColumn("is_last", final & (F.lead("start").over(Window.partitionBy("axis", "patch", "overlap").orderBy("start")).isNull()))
    lo = F.when(F.col("start") + F.col("patch") > F.col("axis"), F.greatest(F.lit(0), F.col("axis") - F.col("patch"))).otherwise(F.col("start"))
    t = t.withColumn("crop_lo", lo).withColumn("crop_hi", F.least(F.col("axis"), F.col("crop_lo") + F.col("patch")))
    half = F.floor(F.col("overlap") / 2)
    t = t.withColumn("stitch_hi", F.when(F.col("is_last"), F.col("axis")).otherwise(F.col("crop_hi") - half))
    before = F.lag("stitch_hi").over(Window.partitionBy("axis", "patch", "overlap").orderBy("start"))
    t = t.withColumn("stitch_lo", F.coalesce(before, F.lit(0)))
    ints = ["tile", "crop_lo", "crop_hi", "stitch_lo", "stitch_hi"]
    out = t.select("axis", "patch", "overlap", *[F.col(c).cast("int").alias(c) for c in ints], "is_last")
    return out.withColumn("inner_lo", F.col("stitch_lo") - F.col("crop_lo")).withColumn("inner_hi", F.col("stitch_hi") - F.col("crop_lo"))


def sequential_grid(axes: DataFrame) -> DataFrame:
    """(length, patch, patches, overlap, step): the fewest patches that cover an axis, spread evenly."""
    n = F.ceil(F.col("length") / F.col("patch"))
    over = F.ceil(F.greatest(F.lit(0), n * F.col("patch") - F.col("length")) / F.greatest(F.lit(1), n - 1))
    ints = [n.cast("int").alias("patches"), over.cast("int").alias("overlap"), (F.least("length", "patch") - over).cast("int").alias("step")]
    return axes.select("length", "patch", *ints)


def cut_patches(pixels: DataFrame, height: int, width: int, patch: int, overlap: int) -> DataFrame:
    """(ty, tx, py, px, v, keep, last_patch): pixels of each tile by place in the tile; keep marks the part that stitching takes."""
    spark = pixels.sparkSession
    y, x = (tile_coords(spark.createDataFrame([(n, patch, overlap)], "axis int, patch int, overlap int")) for n in (height, width))
    name = lambda t, a: t.select(*[F.col(c).alias(f"{a}_{c}") for c in ("tile", "crop_lo", "crop_hi", "stitch_lo", "stitch_hi", "is_last")])
    p = pixels.join(F.broadcast(name(y, "y")), F.expr("r >= y_crop_lo and r < y_crop_hi")).join(F.broadcast(name(x, "x")), F.expr("c >= x_crop_lo and c < x_crop_hi"))
    keep = F.expr("r >= y_stitch_lo and r < y_stitch_hi and c >= x_stitch_lo and c < x_stitch_hi")
    return p.select(F.col("y_tile").alias("ty"), F.col("x_tile").alias("tx"), (F.col("r") - F.col("y_crop_lo")).alias("py"), (F.col("c") - F.col("x_crop_lo")).alias("px"), "v", keep.alias("keep"), F.expr("y_is_last and x_is_last").alias("last_patch"), F.col("y_crop_lo").alias("y0"), F.col("x_crop_lo").alias("x0"))


def stitch(patches: DataFrame) -> DataFrame:
    """(r, c, v) from the kept parts of patches."""
    return patches.where("keep").select((F.col("py") + F.col("y0")).alias("r"), (F.col("px") + F.col("x0")).alias("c"), "v")


def stats(pixels: DataFrame, *key: str) -> DataFrame:
    """Mean, population deviation, least and greatest value of each image."""
    return (pixels.groupBy(*key) if key else pixels).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"))


def _with_stats(pixels: DataFrame, *key: str) -> DataFrame:
    s = stats(pixels, *key)
    return pixels.join(s, [*key]) if key else pixels.join(F.broadcast(s), F.lit(True))


def standardize(pixels: DataFrame, *key: str) -> DataFrame:
    s = _with_stats(pixels, *key)
    return s.withColumn("z", F.when(F.col("std") > 0, (F.col("v") - F.col("mean")) / F.col("std")).otherwise(0.0)).select(*pixels.columns, "z")


def minmax(pixels: DataFrame, *key: str) -> DataFrame:
    s = _with_stats(pixels, *key)
    return s.withColumn("u", F.when(F.col("high") > F.col("low"), (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)).select(*pixels.columns, "u")


def clean_values(pixels: DataFrame) -> DataFrame:
    """NaN and infinite values become 0."""
    return pixels.withColumn("v", F.when(F.isnan("v") | (F.abs("v") == float("inf")), 0.0).otherwise(F.col("v")))


def contrast(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Values clipped to two percentiles and scaled to 0..1."""
    p = pixels.agg(F.percentile("v", F.lit(low)).alias("lo"), F.percentile("v", F.lit(high)).alias("hi"))
    s = pixels.join(F.broadcast(p), F.lit(True))
    u = (F.least(F.greatest("v", "lo"), F.col("hi")) - F.col("lo")) / (F.col("hi") - F.col("lo"))
    return s.withColumn("u", F.when(F.col("hi") > F.col("lo"), u).otherwise(0.0)).select(*pixels.columns, "u")


def sobel(pixels: DataFrame, *key: str) -> DataFrame:
    """(r, c, gx, gy, magnitude): 3 x 3 Sobel gradients; beyond the edge the edge pixel counts again."""
    row, col = Window.partitionBy(*key, "r").orderBy("c"), Window.partitionBy(*key, "c").orderBy("r")

    def near(c: str, w: Window, k: int) -> Column:
        return F.coalesce((F.lead if k > 0 else F.lag)(c).over(w), F.col(c))

    p = pixels.withColumn("dx", near("v", row, 1) - near("v", row, -1)).withColumn("sx", near("v", row, 1) + 2 * F.col("v") + near("v", row, -1))
    p = p.withColumn("gx", near("dx", col, 1) + 2 * F.col("dx") + near("dx", col, -1)).withColumn("gy", near("sx", col, 1) - near("sx", col, -1))
    return p.select(*key, "r", "c", "gx", "gy", F.sqrt(F.col("gx") ** 2 + F.col("gy") ** 2).alias("magnitude"))


def gradient_stats(pixels: DataFrame, *key: str) -> DataFrame:
    """Mean, largest and 95th percentile of the gradient magnitude, and the median direction in degrees where it exceeds 0.1."""
    s = sobel(pixels, *key)
    turn = F.when(F.col("magnitude") > 0.1, F.degrees(F.atan2("gy", "gx")))
    return (s.groupBy(*key) if key else s).agg(F.avg("magnitude").alias("mean_gradient"), F.max("magnitude").alias("max_gradient"), F.percentile("magnitude", F.lit(0.95)).alias("p95_gradient"), F.percentile(turn, F.lit(0.5)).alias("median_direction"))


def tile_variation(pixels: DataFrame, height: int, width: int, size: int = 64) -> DataFrame:
    """(ty, tx, cv): deviation over mean of whole tiles; a ragged edge is left out, and 0 stands where the mean is 0."""
    p = pixels.where((F.col("r") < height // size * size) & (F.col("c") < width // size * size))
    g = p.groupBy(F.floor(F.col("r") / size).cast("int").alias("ty"), F.floor(F.col("c") / size).cast("int").alias("tx")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return g.select("ty", "tx", F.when(F.col("m") != 0, F.col("s") / F.col("m")).otherwise(0.0).alias("cv"))


def local_windows(pixels: DataFrame, height: int, width: int, size: int = 16, stride: int = 8) -> DataFrame:
    """(r, c, mean, std): statistics of the last size x size window that covers each pixel, windows starting every `stride`; 0 where none does."""
    ry, rx = (height - size) // stride * stride, (width - size) // stride * stride
    starts = lambda c: F.expr(f"filter(sequence(greatest(0, cast(ceil(({c} - {size - 1}) / {stride}) as int)) * {stride}, cast(floor({c} / {stride}) as int) * {stride}, {stride}), s -> s <= {ry if c == 'r' else rx})")
    inside = pixels.where((F.col("r") < ry + size) & (F.col("c") < rx + size))
    e = inside.withColumn("wy", F.explode(starts("r"))).withColumn("wx", F.explode(starts("c")))
    win = e.groupBy("wy", "wx").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    last = pixels.withColumn("wy", F.least(F.floor(F.col("r") / stride) * stride, F.lit(ry)).cast("int")).withColumn("wx", F.least(F.floor(F.col("c") / stride) * stride, F.lit(rx)).cast("int"))
    cover = (F.col("r") < F.col("wy") + size) & (F.col("c") < F.col("wx") + size)
    out = last.join(win, ["wy", "wx"], "left")
    return out.select("r", "c", F.when(cover, F.col("mean")).otherwise(0.0).alias("mean"), F.when(cover, F.col("std")).otherwise(0.0).alias("std"))


def profiles(pixels: DataFrame, every: int = 10) -> DataFrame:
    """(axis, place, mean, std) of every tenth row and column."""
    rows = pixels.where(F.col("r") % every == 0).groupBy(F.col("r").alias("place")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).withColumn("axis", F.lit("row"))
    cols = pixels.where(F.col("c") % every == 0).groupBy(F.col("c").alias("place")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std")).withColumn("axis", F.lit("column"))
    return rows.unionByName(cols).select("axis", "place", "mean", "std")


def intensity_metrics(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """Mean, deviation, range and signal-to-noise ratio, and mean and largest tile variation."""
    s = pixels.agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("range"))
    t = tile_variation(pixels, height, width).agg(F.avg("cv").alias("mean_cv"), F.max("cv").alias("max_cv"))
    return s.join(F.broadcast(t), F.lit(True)).withColumn("snr", F.when(F.col("std") > 0, F.col("mean") / F.col("std")).otherwise(0.0))


def signal_background(pixels: DataFrame) -> DataFrame:
    """Mean of values over the 90th and under the 10th percentile, deviation of every tenth pixel, and their ratio."""
    p = pixels.agg(F.percentile("v", F.lit(0.9)).alias("hi"), F.percentile("v", F.lit(0.1)).alias("lo"))
    s = pixels.join(F.broadcast(p), F.lit(True))
    grid = (F.col("r") % 10 == 0) & (F.col("c") % 10 == 0)
    out = s.agg(F.avg(F.when(F.col("v") > F.col("hi"), F.col("v"))).alias("signal"), F.avg(F.when(F.col("v") < F.col("lo"), F.col("v"))).alias("background"), F.stddev_pop(F.when(grid, F.col("v"))).alias("noise"))
    return out.withColumn("snr", F.try_divide(F.col("signal") - F.col("background"), F.col("noise")))


def noise_scatter(pixels: DataFrame, height: int, width: int, most: int = 10_000) -> DataFrame:
    """Up to `most` local (mean, std) pairs, neither 0, picked by a hash of the pixel's place."""
    w = local_windows(pixels, height, width).where("mean <> 0 and std <> 0")
    return w.orderBy((F.col("r") * 7919 + F.col("c") * 104729 + F.col("r") * F.col("c") * 31) % 1009, "r", "c").limit(most)


def _image(pdf: pd.DataFrame) -> np.ndarray:
    out = np.zeros((int(pdf["r"].max()) + 1, int(pdf["c"].max()) + 1))
    out[pdf["r"], pdf["c"]] = pdf["v"]
    return out


def peaks(x: np.ndarray, apart: int = 20) -> list[int]:
    """Local maxima, the higher one where two are nearer than `apart`."""
    at = [i for i in range(1, len(x) - 1) if x[i - 1] < x[i] >= x[i + 1]]
    kept: list[int] = []
    for i in sorted(at, key=lambda k: (-x[k], k)):
        if all(abs(i - k) >= apart for k in kept):
            kept.append(i)
    return sorted(kept)


def fft_profile(pixels: DataFrame, bins: int = 180, *key: str) -> DataFrame:
    """(kind, place, value): mean FFT magnitude, its directional profile, centre row and column, and their peaks; an image a group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mag = np.abs(np.fft.fftshift(np.fft.fft2(_image(pdf))))
        h, w = mag.shape
        y, x = np.mgrid[:h, :w]
        at = np.clip(((np.arctan2(y - h // 2, x - w // 2) + math.pi) / (2 * math.pi) * bins).astype(int), 0, bins - 1).ravel()
        total, count = np.bincount(at, np.log1p(mag).ravel(), bins), np.bincount(at, minlength=bins)
        rows = [("mean", 0, float(mag.mean()))] + [("direction", i, float(t / max(1, c))) for i, (t, c) in enumerate(zip(total, count, strict=True))]
        for kind, line in (("row", mag[h // 2]), ("column", mag[:, w // 2])):
            rows += [(kind, i, float(v)) for i, v in enumerate(line)] + [(f"{kind}_peak", i, float(line[i])) for i in peaks(line)]
        return pd.DataFrame(rows, columns=["kind", "place", "value"])

    group = pixels.groupBy(*key) if key else pixels.groupBy(F.lit(0).alias("_one"))
    return group.applyInPandas(run, "kind string, place int, value double")


def patches_of(spark: SparkSession, images: DataFrame, patch: int, overlap: int) -> DataFrame:
    """Patches of images (path, height, width, pixels array<double>) by slicing rows of the array; one row a patch with its coordinates."""
    axes = images.select("path", "height", "width", "pixels")

    def cut(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                img, starts = np.asarray(r.pixels).reshape(r.height, r.width), []
                for n in (r.height, r.width):
                    s = list(range(0, max(1, n - overlap), patch - overlap))
                    starts.append(sorted({min(k, max(0, n - patch)) for k in s}))
                for i, y in enumerate(starts[0]):
                    for j, x in enumerate(starts[1]):
                        part = img[y : y + patch, x : x + patch]
                        last = i == len(starts[0]) - 1 and j == len(starts[1]) - 1
                        yield pd.DataFrame({"path": [r.path], "y": [y], "x": [x], "h": [part.shape[0]], "w": [part.shape[1]], "last_patch": [last], "pixels": [part.ravel().tolist()]})

    return axes.mapInPandas(cut, "path string, y int, x int, h int, w int, last_patch boolean, pixels array<double>")
