"""Shape of clusters through their convex hulls."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.functions.numeric import hull, polygon
from petriflow.operators.clusters import angle_difference, pairs_in_time, pca_axes


def morphology(cells: DataFrame) -> DataFrame:
    """Hull area and perimeter, circularity, density, compactness, gyration of each cluster and time with three cells or more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf[["x", "y"]].to_numpy(float)
        if len(p) < 3:
            return pd.DataFrame(columns=["label", "time", "n_cells", "hull_area", "hull_perimeter", "circularity", "density", "compactness", "gyration", "hull_points"])
        v = hull(p)
        area, perimeter = polygon(v)
        row = {
            "label": int(pdf["label"].iloc[0]), "time": int(pdf["time"].iloc[0]), "n_cells": len(p), "hull_area": area, "hull_perimeter": perimeter,
            "circularity": 4 * math.pi * area / perimeter**2 if perimeter else 0.0, "density": len(p) / area if area else 0.0, "compactness": area / perimeter if perimeter else 0.0,
            "gyration": float(np.sqrt(((p - p.mean(axis=0)) ** 2).sum(axis=1).mean())), "hull_points": len(v),
        }
        return pd.DataFrame([row])

    kinds = dict(cells.dtypes)
    schema = f"label {kinds['label']}, time {kinds['time']}, n_cells int, hull_area double, hull_perimeter double, circularity double, density double, compactness double, gyration double, hull_points int"
    return cells.select("label", "time", "x", "y").groupBy("label", "time").applyInPandas(run, schema)


def compare_shapes(cells: DataFrame) -> DataFrame:
    """Shapes of two clusters of a time: ratios of area and density, differences of the rest, and the distance of their centres."""
    centre = cells.groupBy("label", "time").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    shape = morphology(cells).join(pca_axes(cells).drop("n_cells"), ["label", "time"]).join(centre, ["label", "time"])
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    return pairs_in_time(shape).select(
        "a.time", a("label").alias("label_a"), b("label").alias("label_b"), F.try_divide(a("hull_area"), b("hull_area")).alias("relative_area"), F.try_divide(a("density"), b("density")).alias("relative_density"),
        *[(a(c) - b(c)).alias(f"{n}_diff") for c, n in (("circularity", "circularity"), ("compactness", "compactness"), ("aspect_ratio", "aspect"))],
        angle_difference(a("orientation"), b("orientation")).alias("angle_diff"), F.sqrt((a("cx") - b("cx")) ** 2 + (a("cy") - b("cy")) ** 2).alias("centre_distance"),
    )
