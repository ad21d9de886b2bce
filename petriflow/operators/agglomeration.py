"""Ward's hierarchy by reciprocal nearest neighbours, and BIRCH's clustering features.

Ward: a part is told by its size and centre, from which the Lance-Williams update of Ward's distance follows. Parts that are each other's
nearest can all be joined at once and in any order, as Ward's distance is reducible. A key of many parts has rounds over cells of PARTS parts or
fewer: a task follows chains of nearest neighbours as far as no part beyond its cell's border can be nearer, and the next round's cells are larger and
have other borders. Once a key has PARTS parts or fewer, one task follows the chains to the end.

BIRCH: points go to tiles, the points of a tile to SALTS trees of clustering features, and the features of these trees to one tree for each tile,
so no task holds more than the features of one tile. Sums of features are exact, however they were merged.

After F. Murtagh, "A survey of recent advances in hierarchical clustering algorithms" (1983), and T. Zhang, R. Ramakrishnan and M. Livny,
"BIRCH: an efficient data clustering method for very large databases" (1996).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petriflow.operators.density import dealt
from petriflow.operators.graph import checkpoint_dir
from petriflow.operators.spatial import at_level, frames, leaves, nearest, nearest_to

PARTS = 4096
TILE = 64
SALTS = 16


def chain_merges(size: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, height) of all merges of parts in order of their names: a < b, and the union is called a. No matrix is held."""
    size, xy = size.astype(float).copy(), xy.astype(float).copy()
    alive = np.ones(len(size), bool)
    pairs, heights, chain = [], [], []
    for _ in range(len(size) - 1):
        while True:
            if not chain:
                chain.append(int(np.flatnonzero(alive)[0]))
            at = chain[-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                d = 2 * size[at] * size / (size[at] + size) * ((xy - xy[at]) ** 2).sum(axis=1)
            d[~alive] = np.inf
            d[at] = np.inf
            to = int(d.argmin())
            if len(chain) > 1 and d[chain[-2]] <= d[to]:
                break
            chain.append(to)
        a, b = sorted((chain.pop(), chain.pop()))
        pairs.append((a, b))
        heights.append(np.sqrt(d[a] if np.isfinite(d[a]) else d[b]))
        xy[a] = (size[a] * xy[a] + size[b] * xy[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
    p = np.array(pairs, np.int64).reshape(-1, 2)
    return p[:, 0], p[:, 1], np.array(heights)


def sure_merges(size: np.ndarray, xy: np.ndarray, box: tuple[float, float, float, float], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, height) of the merges inside a box (x0, y0, x1, y1) that hold whatever parts of `least` points or more lie beyond it, as in chain_merges,
    and (part, size, xy) of the parts then left.

    A part whose nearest is no nearer than the border may be is stuck, and so is one whose nearest is stuck: neither changes by other merges."""
    size, xy = size.astype(float).copy(), xy.astype(float).copy()
    alive, stuck = np.ones(len(size), bool), np.zeros(len(size), bool)
    pairs, heights, chain, todo = [], [], [], list(range(len(size)))[::-1]
    while chain or todo:
        if not chain:
            at = todo.pop()
            if alive[at] and not stuck[at]:
                chain.append(at)
            continue
        at = chain[-1]
        d = 2 * size[at] * size / (size[at] + size) * ((xy - xy[at]) ** 2).sum(axis=1)
        d[~alive] = np.inf
        d[at] = np.inf
        to = int(d.argmin())
        gap = max(0.0, min(xy[at, 0] - box[0], xy[at, 1] - box[1], box[2] - xy[at, 0], box[3] - xy[at, 1]))
        back = len(chain) > 1 and d[chain[-2]] <= d[to]
        if not d[to] < 2 * size[at] * least / (size[at] + least) * gap**2 or (stuck[to] and not back):
            stuck[chain] = True
            chain = []
        elif not back:
            chain.append(to)
        else:
            a, b = sorted((chain.pop(), chain.pop()))
            pairs.append((a, b))
            heights.append(np.sqrt(d[to]))
            xy[a] = (size[a] * xy[a] + size[b] * xy[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            todo.append(a)
    p, left = np.array(pairs, np.int64).reshape(-1, 2), np.flatnonzero(alive)
    return p[:, 0], p[:, 1], np.array(heights), left, size[left], xy[left]


def _merge_in_cells(large: DataFrame, turn: int, parts: int, *key: str) -> DataFrame:
    """(key, a, b, height, x, y, size): a round's sure merges of parts (id, x, y, size, least) in cells of `parts` of them or fewer, and, with b null, the
    parts left. Cells are laid out anew by the turn, as what lies at a border stays."""
    kinds = dict(large.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in key)
    shift = (turn * 0.618033988749895 + 0.31) % 1
    frame = frames(large, *key).select(*key, *((F.col(f"{c}0") - F.col("span") * s).alias(f"{c}0") for c, s in (("x", shift), ("y", 1 - shift))), (F.col("span") * 2).alias("span"), (F.col("levels") + 1).alias("levels"))
    placed = large.join(frame, [*key]) if key else large.crossJoin(F.broadcast(frame))  # one row
    cell = [*key, "level", "cx", "cy"]
    leaf = leaves(placed, parts, *key)
    every = placed.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("levels"))))
    held = every.select(*key, "level", *at_level(F.col("level")), "id", "x", "y", "size", "least", "x0", "y0", "span").join(leaf, cell)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        level, cx, cy, x0, y0, span, least = pdf[["level", "cx", "cy", "x0", "y0", "span", "least"]].iloc[0].tolist()
        side, edge = span / 2.0**level, span * 1e-12
        box = (x0 + cx * side + edge, y0 + cy * side + edge, x0 + (cx + 1) * side - edge, y0 + (cy + 1) * side - edge)
        a, b, height, left, size, xy = sure_merges(pdf["size"].to_numpy(), pdf[["x", "y"]].to_numpy(), box, least)
        ids = pdf["id"].to_numpy()
        out = pdf.loc[np.concatenate([a, left]), [*key]].reset_index(drop=True)
        out["a"], out["b"] = ids[np.concatenate([a, left])], pd.Series([*ids[b], *[None] * len(left)], dtype=object)
        out["height"] = np.concatenate([height, np.full(len(left), np.nan)])
        for c, v in (("x", xy[:, 0]), ("y", xy[:, 1]), ("size", size)):
            out[c] = np.concatenate([np.full(len(a), np.nan), v])
        return out

    return dealt(held, *cell).groupBy(*cell).applyInPandas(run, f"{head}a {kinds['id']}, b {kinds['id']}, height double, x double, y double, size double")


def ward_merges(points: DataFrame, *key: str, parts: int = PARTS, look: int = 8) -> DataFrame:
    """(key, a, b, height): the merges of each key's points (id, x, y) by Ward's linkage; part b joins part a, parts are called by their smallest
    id, so each id but the smallest is b once. Points without coordinates take no part; coincident ones merge first, at height 0.

    Rounds over cells join what they surely can. Where such a round joins nothing, a part's nearest is sought among its `look` nearest centres, and is
    sure where none beyond them can be nearer for its size; pairs that are surely each other's nearest are joined, and twice as many are looked at
    where there are none."""
    checkpoint_dir(points.sparkSession)
    kinds = dict(points.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in key)
    p = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(*key, "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    first = p.groupBy(*key, "x", "y").agg(F.min("id").alias("id"), F.count("*").cast("double").alias("size"))
    same = p.withColumnRenamed("id", "b").join(first, [*key, "x", "y"]).where("b <> id")
    done = [same.select(*key, F.col("id").alias("a"), "b", F.lit(0.0).alias("height"))]
    now = first.select(*key, "id", "x", "y", "size").checkpoint()
    turn = 0
    while True:
        counts = now.groupBy(*key).agg(F.count("*").alias("n"), F.min("size").alias("least")).where(F.col("n") > parts)
        if counts.isEmpty():
            break
        large = now.join(counts, [*key]) if key else now.crossJoin(F.broadcast(counts))  # one row
        turn += 1
        found = _merge_in_cells(large, turn, parts, *key).checkpoint()
        merged = found.where("b is not null").select(*key, "a", "b", "height")
        if not merged.isEmpty():
            done.append(merged)
            left = found.where("b is null").select(*key, F.col("a").alias("id"), "x", "y", "size")
            now = left.unionByName(now.join(counts, [*key], "left_anti")) if key else left
            continue
        near = nearest(large.withColumn("v", F.col("size")), look, *key)
        square = 2 * F.col("vi") * F.col("vj") / (F.col("vi") + F.col("vj")) * F.col("d") ** 2
        one = F.struct(square.alias("square"), F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
        best = near.groupBy(*key, "i").agg(F.min(one).alias("best"), F.max("d").alias("reach"), F.count("*").alias("seen"), F.first("vi").alias("size"))
        best = best.join(counts, [*key]) if key else best.crossJoin(F.broadcast(counts))  # one row
        beyond = 2 * F.col("size") * F.col("least") / (F.col("size") + F.col("least")) * F.col("reach") ** 2
        sure = best.where((F.col("best.square") <= beyond) | (F.col("seen") == F.col("n") - 1)).select(*key, "best.*")
        pairs = sure.groupBy(*key, "a", "b").agg(F.count("*").alias("sides"), F.min("square").alias("square")).where("sides = 2").drop("sides").checkpoint()
        if pairs.isEmpty():
            look *= 2
            continue
        done.append(pairs.select(*key, "a", "b", F.sqrt("square").alias("height")))
        named = now.join(pairs.select(*key, F.col("b").alias("id"), "a"), [*key, "id"], "left").withColumn("id", F.coalesce("a", "id"))
        total = F.sum("size")
        now = named.groupBy(*key, "id").agg((F.sum(F.col("x") * F.col("size")) / total).alias("x"), (F.sum(F.col("y") * F.col("size")) / total).alias("y"), total.alias("size")).checkpoint()

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        a, b, height = chain_merges(pdf["size"].to_numpy(), pdf[["x", "y"]].to_numpy())
        out = pdf.loc[a, [*key]].reset_index(drop=True)
        out["a"], out["b"], out["height"] = pdf["id"].to_numpy()[a], pdf["id"].to_numpy()[b], height
        return out

    last = now.groupBy(*key).applyInPandas(finish, f"{head}a {kinds['id']}, b {kinds['id']}, height double")
    for d in done:
        last = last.union(d.select(last.columns))
    return last


def ward_clusters(points: DataFrame, count: int, *key: str, parts: int = PARTS) -> DataFrame:
    """(key, id, cluster): the clusters of each key left when all but the count - 1 highest merges are done (ties: of larger names first), named
    by their smallest id; as many as there are points, if fewer; null without coordinates."""
    checkpoint_dir(points.sparkSession)
    merges = ward_merges(points, *key, parts=parts).checkpoint()
    # a rank of at most count - 1 is pushed below the shuffle, so a task sorts few merges of each other task
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("height"), F.desc("b")))
    high = merges.select(*key, "b", rank.alias("rank")).where(F.col("rank") < count).drop("rank")
    kept = merges.join(high, [*key, "b"], "left_anti")
    known = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(*key, "id")
    up = known.join(kept.select(*key, F.col("b").alias("id"), "a"), [*key, "id"], "left").select(*key, "id", F.coalesce("a", "id").alias("cluster")).checkpoint()
    while True:
        step = up.select(*key, F.col("id").alias("cluster"), F.col("cluster").alias("next"))
        after = up.join(step, [*key, "cluster"]).select(*key, "id", F.col("next").alias("cluster"), (F.col("next") != F.col("cluster")).alias("moved")).checkpoint()
        up = after.drop("moved")
        if after.where("moved").isEmpty():
            return points.select(*key, "id").join(up, [*key, "id"], "left")


class FeatureTree:
    """A tree of clustering features (number, sum, sum of squares): a leaf entry takes what leaves its radius at most `threshold`; a node of more than
    `branching` entries is split by its two farthest centres."""

    def __init__(self, threshold: float, branching: int):
        self.limit, self.branching = threshold**2, branching
        self.root = (np.zeros((0, 4)), None)

    def add(self, feature: np.ndarray) -> None:
        parts = self._add(self.root, feature)
        self.root = parts[0] if len(parts) == 1 else (np.array([f.sum(axis=0) for f, _ in parts]), list(parts))

    def _add(self, node, feature):
        rows, below = node
        near = -1
        if len(rows):
            near = int(((rows[:, 1:3] / rows[:, :1] - feature[1:3] / feature[0]) ** 2).sum(axis=1).argmin())
        if below is None:
            if near >= 0:
                both = rows[near] + feature
                if both[3] / both[0] - ((both[1:3] / both[0]) ** 2).sum() <= self.limit:
                    rows[near] = both
                    return [node]
            rows = np.vstack([rows, feature])
        else:
            parts = self._add(below[near], feature)
            if len(parts) == 1:
                rows[near] += feature
                below[near] = parts[0]
                return [(rows, below)]
            rows = np.vstack([np.delete(rows, near, axis=0), [f.sum(axis=0) for f, _ in parts]])
            below = below[:near] + below[near + 1 :] + list(parts)
        if len(rows) <= self.branching:
            return [(rows, below)]
        centre = rows[:, 1:3] / rows[:, :1]
        d = ((centre[:, None] - centre) ** 2).sum(axis=2)
        i, j = np.unravel_index(d.argmax(), d.shape)
        left = d[i] <= d[j]
        left[j] = False
        side = lambda s: (rows[s], None if below is None else [b for b, take in zip(below, s, strict=True) if take])
        return [side(left), side(~left)]

    def leaves(self) -> np.ndarray:
        found, todo = [np.zeros((0, 4))], [self.root]
        while todo:
            rows, below = todo.pop()
            if below is None:
                found.append(rows)
            else:
                todo += below[::-1]
        return np.concatenate(found)


def birch_features(points: DataFrame, threshold: float = 0.5, branching: int = 50, *key: str) -> DataFrame:
    """(key, feature, n, sx, sy, ss, x, y): clustering features of radius `threshold` or less, with their centres; feature numbers them by key.

    Tiles are TILE thresholds wide, and no feature reaches over a tile's border. A tile's points go to SALTS trees by a hash of the id and
    in order of ids, so the features depend on the points alone and not on how they are stored; a task holds one tree. Squares are taken from
    the tile's corner inside the trees, so that far places lose no digits. Points without coordinates take no part."""
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    kinds = dict(points.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in key)
    side = threshold * TILE
    p = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    p = p.select(*key, "id", F.floor(F.col("x") / side).alias("tx"), F.floor(F.col("y") / side).alias("ty"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"), "x", "y")
    p = p.select(*key, "tx", "ty", "salt", "id", F.lit(1.0).alias("n"), (F.col("x") - F.col("tx") * side).alias("sx"), (F.col("y") - F.col("ty") * side).alias("sy"))
    p = p.withColumn("ss", F.col("sx") ** 2 + F.col("sy") ** 2)

    def grow(by: list[str]):
        def run(batches):
            group, tree = None, None

            def leaves() -> pd.DataFrame:
                out = pd.DataFrame(tree.leaves(), columns=["n", "sx", "sy", "ss"])
                for c, v in zip(by, group, strict=True):
                    out[c] = [v] * len(out)
                return out[[*by, "n", "sx", "sy", "ss"]]

            for pdf in batches:
                for names, rows in zip(pdf[by].itertuples(index=False, name=None), pdf[["n", "sx", "sy", "ss"]].to_numpy(float), strict=True):
                    if names != group:
                        if tree is not None:
                            yield leaves()
                        group, tree = names, FeatureTree(threshold, branching)
                    tree.add(rows)
            if tree is not None:
                yield leaves()

        return run

    sums = "n double, sx double, sy double, ss double"
    tile = [*key, "tx", "ty"]
    small = p.repartition(*tile, "salt").sortWithinPartitions(*tile, "salt", "id").mapInPandas(grow([*tile, "salt"]), f"{head}tx long, ty long, salt long, {sums}")
    merged = small.repartition(*tile).sortWithinPartitions(*tile, "salt", "sx", "sy", "n").mapInPandas(grow(tile), f"{head}tx long, ty long, {sums}")
    x0, y0 = F.col("tx") * side, F.col("ty") * side
    f = merged.select(
        *key,
        F.xxhash64("tx", "ty", "sx", "sy", "n").alias("feature"),
        F.col("n").cast("long").alias("n"),
        (F.col("sx") + F.col("n") * x0).alias("sx"),
        (F.col("sy") + F.col("n") * y0).alias("sy"),
        (F.col("ss") + 2 * (x0 * F.col("sx") + y0 * F.col("sy")) + F.col("n") * (x0 * x0 + y0 * y0)).alias("ss"),
        (F.col("sx") / F.col("n") + x0).alias("x"),
        (F.col("sy") / F.col("n") + y0).alias("y"),
    )
    return f


def birch_clusters(points: DataFrame, threshold: float = 0.5, branching: int = 50, *key: str) -> DataFrame:
    """(key, id, cluster, x, y): the nearest feature of each point and its centre; a point without coordinates has none."""
    checkpoint_dir(points.sparkSession)
    f = birch_features(points, threshold, branching, *key).checkpoint()
    known = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    at = nearest_to(known.withColumn("v", F.lit(0.0)), f.select(*key, F.col("feature").alias("id"), "x", "y", F.lit(0.0).alias("v")), 1, *key, itself=True)
    at = at.select(*key, F.col("i").alias("id"), F.col("j").alias("cluster"), F.col("xj").alias("x"), F.col("yj").alias("y"))
    return points.select(*key, "id").join(at, [*key, "id"], "left")
