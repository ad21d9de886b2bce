"""Queen contiguity: points whose Voronoi cells, cut off at the frame around a key's points, share an edge or a corner.

Coincident points stand at one place and have one cell, so they are contiguous to each other and to the same places. Links are kept between
places, named by their smallest id, and a crowd of coincident points is never multiplied out. Points without coordinates take no part.

A cell is drawn from its nearest places first. Places further away than twice the cell's farthest corner can't touch it, which settles most
cells; the others look at all places within that reach, and keep those whose bisector touches the cell drawn so far. What is left of these in
each part of about BLOCK places is cut once more when the parts come together, so no task holds all places of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.operators.graph import checkpoint_dir
from petriflow.operators.spatial import at_level, frames, nearest

#: Nearest places that a cell is first drawn from.
NEAR = 24
#: Places of a part in the second look.
BLOCK = 4096
#: Distances under this share of the frame's longer side count as none.
TIE = 1e-9
#: Half-planes that a cell takes in at a time.
STEP = 16


def corners(normals: np.ndarray, bounds: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Corners (b, c, 2) of b areas, each where its half-planes normal . p <= bound meet; NaN for crossings outside. Normals of zero bind nothing."""
    i, j = np.triu_indices(normals.shape[1], 1)
    (ax, ay), (bx, by) = (np.moveaxis(normals[:, k], 2, 0) for k in (i, j))
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        det = ax * by - ay * bx
        det = np.where(np.abs(det) > 1e-12, det, np.nan)
        p = np.stack([(bounds[:, i] * by - bounds[:, j] * ay) / det, (ax * bounds[:, j] - bx * bounds[:, i]) / det], axis=2)
        outside = (p @ np.swapaxes(normals, 1, 2) > bounds[:, None] + tie[:, None, None]).any(axis=2)
    p[outside] = np.nan
    return p


def half_planes(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit normals and bounds of the points nearer to the origin than to q (..., 2); missing places (NaN) bind nothing."""
    d = np.hypot(q[..., 0], q[..., 1])
    known = d > 0
    return np.where(known[..., None], q / np.where(known, d, 1)[..., None], 0.0), np.where(known, d / 2, np.inf)


FRAME = np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])


def touching(normals: np.ndarray, bounds: np.ndarray, p: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Whether each half-plane's line touches the area with corners p."""
    reach = np.nanmax(np.nan_to_num(p @ np.swapaxes(normals, 1, 2), nan=-np.inf), axis=1)
    return (reach >= bounds - tie[:, None]) & np.isfinite(bounds)


def contiguous(q: np.ndarray, frame: np.ndarray, tie: float) -> np.ndarray:
    """Whether each of the places q, relative to the cell's own, touches the cell in the frame (distances to its four sides).

    The cell takes in the STEP half-planes that cut it deepest, and drops those that it no longer touches, until none cuts it."""
    normals, bounds = half_planes(q)
    ties = np.array([tie])
    active = np.zeros(0, int)
    while True:
        n, h = np.concatenate([normals[active], FRAME]), np.concatenate([bounds[active], frame])
        p = corners(n[None], h[None], ties)
        active = active[touching(n[None], h[None], p, ties)[0][: len(active)]]
        p = p[0][~np.isnan(p[0, :, 0])]
        depth = (normals @ p.T).max(axis=1) - bounds
        deepest = np.argsort(-depth)[:STEP]
        new = np.setdiff1d(deepest[depth[deepest] > tie], active)
        if not len(new):
            return depth >= -tie
        active = np.concatenate([active, new])


def _relative(pdf: pd.DataFrame, width: int) -> np.ndarray:
    out = np.full((len(pdf), width, 2), np.nan)
    for axis, c in enumerate(("xs", "ys")):
        for row, (own, others) in enumerate(zip(pdf[c[0]], pdf[c], strict=True)):
            out[row, : len(others), axis] = others
            out[row, :, axis] -= own
    return out


def _sides(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([pdf["x1"] - pdf["x"], pdf["x"] - pdf["x0"], pdf["y1"] - pdf["y"], pdf["y"] - pdf["y0"]], axis=1)


def _first_look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of the nearest places: those that touch, the corners, and how far others could be that touch it too (null: none)."""
    for whole in batches:
        for pdf in (whole.iloc[k : k + 128] for k in range(0, len(whole), 128)):
            q, tie = _relative(pdf, NEAR), pdf["span"].to_numpy() * TIE
            normals, bounds = half_planes(q)
            p = corners(np.concatenate([normals, np.broadcast_to(FRAME, (len(pdf), 4, 2))], axis=1), np.concatenate([bounds, _sides(pdf)], axis=1), tie)
            touch = touching(normals, bounds, p, tie)
            reach = 2 * np.nanmax(np.hypot(p[..., 0], p[..., 1]), axis=1) + 2 * tie
            some = np.array([len(js) < NEAR for js in pdf["js"]])
            settled = some | (2 * bounds[:, -1] > reach)
            js = [np.asarray(j)[t[: len(j)]] for j, t in zip(pdf["js"], touch, strict=True)]
            real = [c[~np.isnan(c[:, 0])] for c in p]
            yield pdf.drop(columns=["js", "xs", "ys"]).assign(js=js, reach=np.where(settled, np.nan, reach), us=[c[:, 0] for c in real], vs=[c[:, 1] for c in real])


def _closer_look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of each row that touch the cell which the row's places leave."""
    for pdf in batches:
        kept = {c: [] for c in ("js", "xs", "ys")}
        for row, (x, y, sides, span) in enumerate(zip(pdf["x"], pdf["y"], _sides(pdf), pdf["span"], strict=True)):
            js, xs, ys = (np.asarray(pdf[c].iloc[row]) for c in ("js", "xs", "ys"))
            t = contiguous(np.stack([xs - x, ys - y], axis=1), sides, span * TIE)
            for c, a in zip(kept, (js, xs, ys), strict=True):
                kept[c].append(a[t])
        yield pdf.assign(**kept)


def places(points: DataFrame, *key: str) -> DataFrame:
    """(key, id, x, y, n, total): the places of points (id, x, y, v), named by their smallest id, with number and sum of v of the points there."""
    return points.where("x is not null and y is not null").groupBy(*key, "x", "y").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.sum("v").alias("total")).select(*key, "id", "x", "y", "n", "total")


def queen_links(points: DataFrame, *key: str) -> DataFrame:
    """(key, i, j): ordered pairs of contiguous places, each named by its smallest id."""
    spots = places(points, *key).select(*key, "id", "x", "y", F.lit(0.0).alias("v"))
    size = spots.groupBy(*key).agg(F.max("x").alias("x1"), F.max("y").alias("y1"), F.count("*").alias("n"))
    frame = frames(spots, *key).join(size, [*key]) if key else frames(spots).crossJoin(size)  # one row each
    box = ["x0", "x1", "y0", "y1", "span", "levels", "n"]
    kind = dict(spots.dtypes)

    def placed(p: DataFrame) -> DataFrame:
        return p.join(frame, [*key]) if key else p.crossJoin(F.broadcast(frame))  # one row

    def packed(pairs: DataFrame, *by: str) -> DataFrame:
        """Rows of a cell with the places to look at, nearest first."""
        around = F.sort_array(F.collect_list(F.struct("d", "j", "xj", "yj")))
        g = pairs.groupBy(*key, F.col("i"), F.col("xi").alias("x"), F.col("yi").alias("y"), *by).agg(around.alias("o"))
        return g.select(*key, "i", "x", "y", F.col("o.j").alias("js"), F.col("o.xj").alias("xs"), F.col("o.yj").alias("ys"))

    head = ", ".join([*(f"`{c}` {kind[c]}" for c in key), f"i {kind['id']}", "x double", "y double"])
    sides = "x0 double, x1 double, y0 double, y1 double, span double, levels int, n long"
    ids = f"js array<{kind['id']}>"
    near = nearest(spots, NEAR, *key)
    first = placed(packed(near)).select(*key, "i", "x", "y", "js", "xs", "ys", *box).mapInPandas(_first_look, f"{head}, {sides}, {ids}, reach double, us array<double>, vs array<double>")
    checkpoint_dir(points.sparkSession)
    first = first.checkpoint()  # read twice

    # the finest level whose cells are as wide as the reach: what can touch lies in the 3 x 3 cells around
    level = F.greatest(F.lit(0), F.least(F.col("levels"), F.floor(F.log2(F.col("span") / F.col("reach"))).cast("int")))
    cx, cy = at_level(F.col("level"))
    around = F.explode(F.array(*[F.lit(k) for k in (-1, 0, 1)]))
    open_ = first.where("reach is not null").withColumn("level", level).select("*", cx, cy).withColumn("dx", around).withColumn("dy", around)
    open_ = open_.select(*key, "i", F.col("x").alias("xi"), F.col("y").alias("yi"), "reach", F.arrays_zip("us", "vs").alias("corners"), "level", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), "span", "n")
    every = placed(spots).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels")))).select(*key, "level", *at_level(F.col("level")), F.col("id").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    dx, dy = F.col("xj") - F.col("xi"), F.col("yj") - F.col("yi")
    pairs = open_.join(every, [*key, "level", "cx", "cy"]).where("i <> j").withColumn("d", F.hypot(dx, dy)).where("d <= reach")
    meets = F.exists("corners", lambda c: c["us"] * dx + c["vs"] * dy >= F.col("d") * (F.col("d") / 2 - F.col("span") * TIE))
    part = F.pmod(F.xxhash64("j"), F.ceil(F.col("n") / BLOCK))
    pairs = pairs.where(meets).select(*key, "i", "xi", "yi", "j", "xj", "yj", "d", part.alias("part"))
    columns = f"{head}, {ids}, xs array<double>, ys array<double>, {sides}"

    def looked(rows: DataFrame) -> DataFrame:
        return placed(rows).select(*key, "i", "x", "y", "js", "xs", "ys", *box).mapInPandas(_closer_look, columns)

    left = looked(packed(pairs, "part")).withColumn("o", F.explode(F.arrays_zip("js", "xs", "ys")))
    left = left.select(*key, "i", F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("o.js").alias("j"), F.col("o.xs").alias("xj"), F.col("o.ys").alias("yj"))
    last = looked(packed(left.withColumn("d", F.hypot(dx, dy))))
    found = first.where("reach is null").select(*key, "i", "js").union(last.select(*key, "i", "js"))
    return found.select(*key, "i", F.explode("js").alias("j"))


def spatial_lag(points: DataFrame, *key: str) -> DataFrame:
    """(key, id, v, n_neighbours, lag): mean value of each point's contiguous points, its own place's others included; null without any."""
    p = places(points, *key)
    beside = queen_links(points, *key).join(p.select(*key, F.col("id").alias("j"), "n", "total"), [*key, "j"])
    beside = beside.groupBy(*key, F.col("i").alias("id")).agg(F.sum("n").alias("m"), F.sum("total").alias("t"))
    spot = p.join(beside, [*key, "id"], "left").withColumnRenamed("id", "place").na.fill({"m": 0, "t": 0.0})
    number = F.col("m") + F.col("n") - 1
    out = points.select(*key, "id", "x", "y", "v").join(spot, [*key, "x", "y"])
    return out.select(*key, "id", "v", number.alias("n_neighbours"), F.try_divide(F.col("t") + F.col("total") - F.col("v"), number).alias("lag"))


def queen_moran(points: DataFrame, *key: str) -> DataFrame:
    """(key, n, moran_i, expected): Moran's I with each point's weights shared evenly by its contiguous points."""
    lag = spatial_lag(points.where("v is not null"), *key)
    s = lag.groupBy(*key).agg(
        F.count("*").alias("n"), F.count("lag").alias("linked"), F.avg("v").alias("m"), F.var_pop("v").alias("m2"), F.avg(F.when(F.col("lag").isNotNull(), F.col("v"))).alias("mv"), F.avg("lag").alias("ml"),
        F.covar_pop("v", "lag").alias("c"),
    )
    # the mean of (v - m) * (lag - m) over the points that have neighbours
    cross = F.col("c") + (F.col("mv") - F.col("m")) * (F.col("ml") - F.col("m"))
    return s.select(*key, "n", F.try_divide(cross, F.col("m2")).alias("moran_i"), F.try_divide(F.lit(-1.0), F.col("n") - 1).alias("expected"))
