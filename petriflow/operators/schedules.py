"""Parameters of the clustering that change over the times of a recording, and the clustering that follows them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from petriflow.operators.cleaning import trim_outliers
from petriflow.operators.density import dealt, gradient_labels
from petriflow.operators.imputation import piecewise

# fixed values: knots (times, values) of the parameters for the first recording
FIRST = {
    "width": ([1, 2, 10, 20, 30, 40, 60, 80, 100, 118], [10, 20, 5.5, 5.25, 4.75, 4.75, 4.5, 4.4, 3.5, 3]),
    "largest": ([1, 2, 10, 20, 30, 40, 60, 80, 100, 118], [0.8, 0.8, 0.6, 0.6, 0.6, 0.6, 0.8, 0.8, 0.8, 0.8]),
    "similar": ([1, 2, 10, 20, 30, 40, 60, 80, 100, 118], [0.5, 0.7, 0.6, 0.5, 0.4, 0.4, 0.4, 0.3, 0.1, 0.1]),
    "min_points": ([1, 2, 10, 20, 30, 40, 60, 80, 100, 118], [325, 400, 200, 150, 75, 40, 25, 25, 7, 3]),
    "eps": ([1, 2, 10, 20, 30, 40, 60, 80, 100, 118], [260, 260, 300, 300, 300, 300, 250, 250, 200, 200]),
    "merge": ([0, 40, 48, 65, 72, 90, 97, 98, 100, 118], [0, 0, 200, 300, 400, 500, 700, 850, 850, 1000]),
    "spread": ([0, 1, 118], [-750, 4000, 4000]),
}
# fixed values: those for the second recording
SECOND = {
    "width": ([1, 20, 60, 80, 100, 118], [4.8, 4, 2, 1, 0.05, 0.01]),
    "largest": ([1, 20, 60, 80, 100, 118], [0.6, 0.6, 0.8, 0.8, 0.8, 0.9]),
    "similar": ([1, 20, 60, 80, 100, 118], [0.6, 0.5, 0.03, 0.02, 0.02, 0.02]),
    "min_points": ([1, 20, 60, 80, 100, 118], [100, 95, 50, 15, 5, 3]),
    "eps": ([1, 20, 60, 80, 100, 118], [500, 450, 300, 300, 250, 250]),
}
Knots = dict[str, tuple[list[float], list[float]]]


def place(time: Column, knots: tuple[list[float], list[float]]) -> Column:
    """Where time 1, 2, ... reads a schedule: as many even places as its last knot says lie between its ends, and each time takes the next."""
    start, end = knots[0][0], knots[0][-1]
    return start + (time.cast("double") - 1) * (end - start) / float(end - 1)


def parameters(table: DataFrame, knots: Knots, time: Column | str = "time", suffix: str = "") -> DataFrame:
    """The table with a column for each parameter at its time; times before or after a schedule's ends hold these. No join: expressions of the time."""
    t = F.col(time) if isinstance(time, str) else time
    return table.select("*", *(piecewise(place(t, k), list(zip(*k, strict=True))).alias(f"{name}{suffix}") for name, k in knots.items()))


def scheduled_clusters(points: DataFrame, knots: Knots, *key: str, time: str = "time", first: int = 1, angle: float = 150.0) -> DataFrame:
    """(key, time, id, x, y, cluster): gradient clusters of each time with that time's parameters; -1 for points in none.

    first: the time of the schedule that the points' time 1 has. A key and time is one task; min_points are cut to whole numbers."""
    kinds = dict(points.dtypes)
    by = [*key, time]
    names = ["eps", "min_points", "width", "largest", "similar"]
    asked = parameters(points.select(*by, "id", "x", "y").where("x is not null and y is not null"), {n: knots[n] for n in names}, F.col(time) + (first - 1), "_now")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        now = {n: float(pdf[f"{n}_now"].iloc[0]) for n in names}
        label = gradient_labels(pdf[["x", "y"]].to_numpy(float), now["eps"], int(now["min_points"]), angle, now["width"], now["largest"], now["similar"])
        return pdf[[*by, "id", "x", "y"]].assign(cluster=label)

    return dealt(asked, *by).groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in [*by, "id"]) + ", x double, y double, cluster int")


def cleaned_clusters(points: DataFrame, knots: Knots, half: float = 1000.0, time: str = "time", first: int = 1, angle: float = 150.0) -> DataFrame:
    """scheduled_clusters without points in no cluster and those over `half` from their cluster's centre on an axis."""
    found = scheduled_clusters(points, knots, time=time, first=first, angle=angle).where("cluster >= 0")
    return trim_outliers(found, half, time, "cluster")
