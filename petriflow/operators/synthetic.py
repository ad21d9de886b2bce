"""Seeded synthetic nuclei, clusters and scenarios, and ellipse geometry."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ellipse_geometry(nuclei: DataFrame) -> DataFrame:
    """Area, perimeter (Ramanujan), aspect ratio, roundness and bounding box of ellipses (id, a, b, angle in degrees)."""
    a, b, t = F.col("a"), F.col("b"), F.radians("angle")
    h = ((a - b) / (a + b)) ** 2
    perimeter = F.pi() * (a + b) * (1 + 3 * h / (10 + F.sqrt(4 - 3 * h)))
    area = F.pi() * a * b
    box = lambda u, v: 2 * F.sqrt((a * u(t)) ** 2 + (b * v(t)) ** 2)
    return nuclei.select("id", area.alias("area"), perimeter.alias("perimeter"), (F.greatest("a", "b") / F.least("a", "b")).alias("aspect"), (4 * F.pi() * area / perimeter**2).alias("roundness"), box(F.cos, F.sin).alias("box_w"), box(F.sin, F.cos).alias("box_h"))


def ellipsoid_geometry(nuclei: DataFrame) -> DataFrame:
    """Volume and approximate surface (exponent 1.6) of ellipsoids (id, a, b, c)."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    p = 1.6
    mean = (F.pow(a * b, F.lit(p)) + F.pow(a * c, F.lit(p)) + F.pow(b * c, F.lit(p))) / 3
    return nuclei.select("id", (4.0 / 3.0 * F.pi() * a * b * c).alias("volume"), (4 * F.pi() * F.pow(mean, F.lit(1 / p))).alias("surface"))


def render(nuclei: DataFrame, height: int, width: int, profile: str = "binary") -> DataFrame:
    """(r, c, v): summed intensity of ellipses (id, cx, cy, a, b, angle, level) over the pixels of their bounding boxes.

    profile: binary, gaussian (falls with distance), ring (bright edge) or uniform; pixels that nothing covers have no row."""
    t = F.radians("angle")
    reach = F.greatest("a", "b")
    span = lambda mid, n: F.sequence(F.greatest(F.lit(0), F.floor(mid - reach)).cast("int"), F.least(F.lit(n - 1), F.ceil(mid + reach)).cast("int"))
    inside = nuclei.where((F.col("cx") + reach >= 0) & (F.col("cx") - reach <= width - 1) & (F.col("cy") + reach >= 0) & (F.col("cy") - reach <= height - 1))
    p = inside.withColumn("r", F.explode(span(F.col("cy"), height))).withColumn("c", F.explode(span(F.col("cx"), width)))
    dx, dy = F.col("c") - F.col("cx"), F.col("r") - F.col("cy")
    u, v = dx * F.cos(t) + dy * F.sin(t), dy * F.cos(t) - dx * F.sin(t)
    q = (u / F.col("a")) ** 2 + (v / F.col("b")) ** 2
    shape = {"binary": F.lit(1.0), "uniform": F.lit(1.0), "gaussian": F.exp(q * -2.0), "ring": F.exp(-8.0 * (F.sqrt("q") - 0.8) ** 2)}
    lit = p.withColumn("q", q).where("q <= 1")
    value = F.col("level") * (shape["gaussian"] if profile == "gaussian" else shape[profile])
    return lit.groupBy("r", "c").agg(F.sum(value).alias("v"))


def to_microns(points: DataFrame, scale: dict[str, float]) -> DataFrame:
    """Pixel coordinates (the columns of scale) in microns."""
    return points.withColumns({c: F.col(c) * float(s) for c, s in scale.items()})


def to_pixels(points: DataFrame, scale: dict[str, float]) -> DataFrame:
    """Micron coordinates in whole pixels, cut towards zero."""
    return points.withColumns({c: (F.col(c) / float(s)).cast("int") for c, s in scale.items()})


def inside(points: DataFrame, size: dict[str, int]) -> DataFrame:
    """With `inside`: whether each coordinate is in [0, size)."""
    return points.withColumn("inside", reduce(and_, ((F.col(c) >= 0) & (F.col(c) < s) for c, s in size.items())))


def neighbourhood(points: DataFrame, radius: int, size: dict[str, int]) -> DataFrame:
    """(id, n_<axis>...): the pixels inside the space within `radius` pixels of each point, a row each."""
    out = points
    for c, s in size.items():
        out = out.withColumn(f"n_{c}", F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - radius), F.least(F.lit(s - 1), F.col(c) + radius))))
    apart = sum(((F.col(f"n_{c}") - F.col(c)) ** 2 for c in size), F.lit(0))
    return out.where(apart <= radius**2).select("id", *[f"n_{c}" for c in size])


def grid(spark: SparkSession, size: dict[str, int], spacing: dict[str, int]) -> DataFrame:
    """The points of a regular grid over the space, `spacing` apart on each axis."""
    if sorted(size) != sorted(spacing) or min(spacing.values()) <= 0:
        raise ValueError("spacing must be positive and match the axes")
    out = spark.range(1)
    for c in size:
        out = out.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(size[c] - 1), F.lit(spacing[c]))))
    return out.drop("id")


def merge_pairs(clusters: DataFrame, near: float = 20.0) -> DataFrame:
    """Pairs of clusters of a sample whose truncated centroids are nearer than `near`."""
    c = clusters.select("sample", "cluster", F.col("cx").cast("int").alias("x"), F.col("cy").cast("int").alias("y"))
    d = F.sqrt((F.col("a.x") - F.col("b.x")) ** 2 + (F.col("a.y") - F.col("b.y")) ** 2)
    return c.alias("a").join(c.alias("b"), F.expr("a.sample = b.sample and a.cluster < b.cluster")).where(d < near).select("a.sample", F.col("a.cluster").alias("first"), F.col("b.cluster").alias("second"))


def simulate(spark: SparkSession, clusters: int, nuclei: int, steps: int, seed: int = 1) -> DataFrame:
    """(cluster, time, nucleus, status, x, y, a, b, age, lineage): seeded life of nuclei: death, division, logistic growth, motion."""

    def run(batches):
        for pdf in batches:
            for k in pdf["id"].tolist():
                rng = np.random.default_rng((seed, k))
                home = rng.uniform(0, 1000, 2)
                alive = [{"id": i, "x": home[0] + rng.normal(0, 30), "y": home[1] + rng.normal(0, 30), "a": rng.uniform(4, 8), "b": rng.uniform(3, 6), "age": 0, "line": [i]} for i in range(nuclei)]
                out, fresh = [], nuclei
                for t in range(steps):
                    now = []
                    for n in alive:
                        n["age"] += 1
                        size = n["a"] * n["b"]
                        if n["age"] > 30 or size < 8 or rng.random() < 0.02 + 0.002 * n["age"]:
                            out.append((k, t, n["id"], "dead", n["x"], n["y"], n["a"], n["b"], n["age"], n["line"]))
                            continue
                        if size > 40 and rng.random() < 0.15:
                            out.append((k, t, n["id"], "divided", n["x"], n["y"], n["a"], n["b"], n["age"], n["line"]))
                            for side in (-1, 1):
                                now.append({"id": fresh, "x": n["x"] + side * n["a"] / 2, "y": n["y"], "a": n["a"] * 0.7, "b": n["b"] * 0.7, "age": 0, "line": [*n["line"], fresh]})
                                fresh += 1
                            continue
                        grow = 1 + 0.1 * (1 - size / 80)
                        n["a"], n["b"] = n["a"] * math.sqrt(grow), n["b"] * math.sqrt(grow)
                        n["x"], n["y"] = min(1000, max(0, n["x"] + rng.normal(0, 2))), min(1000, max(0, n["y"] + rng.normal(0, 2)))
                        now.append(n)
                    out += [(k, t, n["id"], "alive", n["x"], n["y"], n["a"], n["b"], n["age"], list(n["line"])) for n in now]
                    alive = now
                yield pd.DataFrame(out, columns=["cluster", "time", "nucleus", "status", "x", "y", "a", "b", "age", "lineage"])

    return spark.range(clusters).mapInPandas(run, "cluster long, time int, nucleus long, status string, x double, y double, a double, b double, age int, lineage array<long>")


def scenario(spark: SparkSession, name: str, points: int = 1000, seed: int = 1) -> DataFrame:
    """(time, id, x, y, truth): the split, merge or density scenario over five steps."""
    apart, one = [(2.0, 0.0, 0.5), (-2.0, 0.0, 0.5)], [(0.0, 0.0, 0.5)]
    by_time = {"split": lambda t: one if t < 2 else apart, "merge": lambda t: apart if t < 2 else one, "density": lambda t: [(0.0, 0.0, 0.3), (5.0, 5.0, 0.7), (-5.0, -5.0, 1.0)]}[name]

    def run(batches):
        for pdf in batches:
            for t in pdf["id"].tolist():
                rng, centres = np.random.default_rng((seed, t)), by_time(t)
                per = points // len(centres)
                for k, (x, y, s) in enumerate(centres):
                    yield pd.DataFrame({"time": t, "id": np.arange(k * per, (k + 1) * per), "x": rng.normal(x, s, per), "y": rng.normal(y, s, per), "truth": k})

    return spark.range(5).mapInPandas(run, "time int, id long, x double, y double, truth int")


def gaussian_sources(spark: SparkSession, sources: list[tuple[float, float, float, int]], seed: int = 1) -> DataFrame:
    """(source, id, x, y): points of normal sources (x, y, variance, points); each point is drawn from its own seed."""
    rows = spark.createDataFrame([(i, *s) for i, s in enumerate(sources)], "source int, mx double, my double, variance double, n int")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                rng = np.random.default_rng((seed, r.source))
                yield pd.DataFrame({"source": r.source, "id": np.arange(r.n), "x": rng.normal(r.mx, math.sqrt(r.variance), r.n), "y": rng.normal(r.my, math.sqrt(r.variance), r.n)})

    return rows.mapInPandas(run, "source int, id long, x double, y double")


def drifting_centres(spark: SparkSession, sequences: int, centres: int, steps: int, split: float = 0.2, merge: float = 0.1, seed: int = 1) -> DataFrame:
    """(seq, time, label, x, y): centres that drift, split and merge at random; a sequence a row of the input."""

    def run(batches):
        for pdf in batches:
            for s in pdf["id"].tolist():
                rng = np.random.default_rng((seed, s))
                c, out = rng.uniform(-10, 10, (centres, 2)), []
                for t in range(steps):
                    out += [(s, t, i, float(x), float(y)) for i, (x, y) in enumerate(c)]
                    c = c + rng.normal(0, 0.2, c.shape)
                    if rng.random() < split:
                        i = rng.integers(len(c))
                        c = np.vstack([c, c[i] + rng.normal(0, 1, 2)])
                    if len(c) > 1 and rng.random() < merge:
                        i, j = rng.choice(len(c), 2, replace=False)
                        c[i] = (c[i] + c[j]) / 2
                        c = np.delete(c, j, axis=0)
                yield pd.DataFrame(out, columns=["seq", "time", "label", "x", "y"])

    return spark.range(sequences).mapInPandas(run, "seq long, time int, label int, x double, y double")
