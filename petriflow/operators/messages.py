"""Affinity propagation on sparse similarities.

An edge (i, k, s) says how well k would stand for i; an edge (k, k, s) how willing k is. Responsibilities and availabilities are two columns of the
edges. A round is a window over the edges of each i, then a sum for each k joined back to its edges, so a popular k costs a partial sum
and no task holds its edges. Keys whose edges fit one task (IN_TASK) do the same rounds on arrays.

After B. Frey and D. Dueck, "Clustering by passing messages between data points" (2007).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petriflow.operators.graph import checkpoint_dir
from petriflow.operators.spatial import nearest, nearest_to

#: Edges of a key whose rounds one task does: some 100 bytes an edge, with the tables that they come in.
IN_TASK = 1 << 24
#: Rounds between two looks at the exemplars; between them nothing is written.
STRIDE = 5


def neighbour_similarities(points: DataFrame, k: int, *key: str, preference: float | None = None) -> DataFrame:
    """(key, i, k, s): minus the squared distance to each of a point's k nearest, and the preference of the point itself, the median of its key's
    similarities if none is given. A relative 1e-9 that hangs on the pair's ids alone tells equal similarities apart."""
    near = nearest(points.withColumn("v", F.lit(0.0)), k, *key).select(*key, "i", F.col("j").alias("k"), (-(F.col("d") ** 2)).alias("s"))
    known = points.where("x is not null and y is not null").select(*key, F.col("id").alias("i"), F.col("id").alias("k"))
    if preference is not None:
        own = known.withColumn("s", F.lit(float(preference)))
    else:
        middle = near.groupBy(*key).agg(F.percentile_approx("s", 0.5, 1 << 16).alias("s"))
        own = known.join(middle, [*key], "left") if key else known.crossJoin(F.broadcast(middle))  # one row
        own = own.withColumn("s", F.coalesce("s", F.lit(0.0)))
    every = near.union(own.select(near.columns))
    part = F.pmod(F.xxhash64("i", "k"), F.lit(1 << 20)) / float(1 << 20)
    return every.withColumn("s", F.col("s") * (1 + 1e-9 * part))


#: Edges of a task that one step of a round looks at.
STEP = 1 << 18


def settle_messages(i: np.ndarray, k: np.ndarray, s: np.ndarray, n: int, damping: float, rounds: int, settle: int, step: int = STEP) -> np.ndarray:
    """Which of n nodes are exemplars; edges in any order, one of each (i, i) at most. A round goes through the edges in steps of whole nodes i, so that it
    holds no more than the messages besides the edges: some 32 bytes an edge."""
    order = np.argsort(i, kind="stable")
    i, k, s = i[order].astype(np.int32), k[order].astype(np.int32), s[order].astype(float)
    del order
    start = np.flatnonzero(np.diff(i, prepend=-1))
    ends = np.append(start, len(i))
    cut = np.unique(np.append(np.searchsorted(start, np.arange(0, len(i), step)), len(start)))
    steps = [(a, b) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
    own = i == k
    me, self_ = k[own], np.zeros(n)
    r, a = np.zeros(len(i)), np.zeros(len(i))
    before, same = np.zeros(n, bool), 0
    for _ in range(rounds):
        total = np.zeros(n)
        for x, y in steps:
            at = slice(ends[x], ends[y])
            first = start[x:y] - ends[x]
            row = np.repeat(np.arange(y - x), np.diff(ends[x : y + 1]))
            v = a[at] + s[at]
            most = np.maximum.reduceat(v, first)[row]
            top = v == most
            second = np.maximum.reduceat(np.where(top, -np.inf, v), first)[row]
            ties = np.add.reduceat(top.astype(np.int64), first)[row] > 1
            other = np.where(top & ~ties, second, most)
            other = np.where(np.isinf(other), s[at] - 1, other)
            r[at] = damping * r[at] + (1 - damping) * (s[at] - other)
            np.add.at(total, k[at], np.where(own[at], 0, np.maximum(r[at], 0)))  # one by one, in order, as from all edges at once
        self_[me] = r[own]
        for x, y in steps:
            at = slice(ends[x], ends[y])
            plus = np.where(own[at], 0, np.maximum(r[at], 0))
            a[at] = damping * a[at] + (1 - damping) * np.where(own[at], total[k[at]], np.minimum(0, self_[k[at]] + total[k[at]] - plus))
        now = np.zeros(n, bool)
        now[me] = r[own] + a[own] > 0
        same = same + 1 if (now == before).all() and now.any() else 0
        before = now
        if same >= settle:
            break
    return before


def exemplars(edges: DataFrame, *key: str, damping: float = 0.5, rounds: int = 200, settle: int = 15, in_task: int = IN_TASK) -> DataFrame:
    """(key, k): the exemplars of each key, when they were the same for `settle` rounds or after `rounds` of them; a node without other edges is one.

    Keys of more than in_task edges share rounds over one table, a shuffle by i and one by k in each, until the exemplars of all of them stay."""
    checkpoint_dir(edges.sparkSession)
    kinds = dict(edges.dtypes)
    head = "".join(f"{c} {kinds[c]}, " for c in key)
    edges = edges.select(*key, "i", "k", F.col("s").cast("double").alias("s")).checkpoint()
    large = edges.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > in_task).drop("n")

    def whole(names: tuple, t: pa.Table) -> pa.Table:
        i, k = (t.column(c).to_numpy() for c in ("i", "k"))
        nodes = np.unique(np.concatenate([np.unique(i), np.unique(k)]))
        chosen = nodes[settle_messages(np.searchsorted(nodes, i), np.searchsorted(nodes, k), t.column("s").to_numpy(), len(nodes), damping, rounds, settle)]
        return pa.table({c: pa.array([v.as_py()] * len(chosen), v.type) for c, v in zip(key, names, strict=True)} | {"k": chosen})

    if large.isEmpty():
        return edges.groupBy(*key).applyInArrow(whole, f"{head}k {kinds['k']}")
    small = edges.join(large, [*key], "left_anti") if key else edges.limit(0)
    now = (edges.join(large, [*key], "left_semi") if key else edges).withColumn("r", F.lit(0.0)).withColumn("a", F.lit(0.0))
    of_i, own = Window.partitionBy(*key, "i"), F.col("i") == F.col("k")
    seen, same = None, 0
    for done in range(1, rounds + 1):
        v, most = F.col("a") + F.col("s"), F.col("most")
        now = now.withColumn("v", v).withColumn("most", F.max("v").over(of_i))
        top = F.col("v") == most
        now = now.withColumn("second", F.max(F.when(~top, F.col("v"))).over(of_i)).withColumn("ties", F.sum(top.cast("int")).over(of_i))
        other = F.coalesce(F.when(top & (F.col("ties") == 1), F.col("second")).otherwise(most), F.col("s") - 1)
        now = now.select(*key, "i", "k", "s", (damping * F.col("r") + (1 - damping) * (F.col("s") - other)).alias("r"), "a")
        plus = F.when(own, 0.0).otherwise(F.greatest(F.col("r"), F.lit(0.0)))
        sums = now.groupBy(*key, "k").agg(F.sum(plus).alias("total"), F.coalesce(F.max(F.when(own, F.col("r"))), F.lit(0.0)).alias("self"))
        fresh = F.when(own, F.col("total")).otherwise(F.least(F.lit(0.0), F.col("self") + F.col("total") - plus))
        now = now.join(sums, [*key, "k"]).select(*key, "i", "k", "s", "r", (damping * F.col("a") + (1 - damping) * fresh).alias("a"))
        if done % STRIDE == 0 or done == rounds:
            now = now.checkpoint()
            chosen = now.where(own & (F.col("r") + F.col("a") > 0)).select(*key, "k")
            mark = tuple(chosen.agg(F.count("*"), F.bit_xor(F.xxhash64(*key, "k"))).first())
            same = same + STRIDE if mark == seen and mark[0] else 0
            seen = mark
            if same >= settle:
                break
    if not key:
        return chosen
    return small.groupBy(*key).applyInArrow(whole, f"{head}k {kinds['k']}").union(chosen)


def affinity_clusters(points: DataFrame, k: int, *key: str, preference: float | None = None, in_task: int = IN_TASK, rounds: int = 200) -> DataFrame:
    """(key, id, cluster): the exemplar of each point, for similarities to its k nearest; exemplars stand for themselves, the others go to the nearest
    one, ties to the smaller id. A point without coordinates has none, nor have those of a key whose messages chose no exemplar."""
    chosen = exemplars(neighbour_similarities(points, k, *key, preference=preference), *key, in_task=in_task, rounds=rounds).withColumnRenamed("k", "id").checkpoint()
    known = points.where("x is not null and y is not null").select(*key, "id", "x", "y", F.lit(0.0).alias("v"))
    at = nearest_to(known.join(chosen, [*key, "id"], "left_anti"), known.join(chosen, [*key, "id"], "left_semi"), 1, *key)
    of = at.select(*key, F.col("i").alias("id"), F.col("j").alias("cluster")).union(chosen.select(*key, "id", F.col("id").alias("cluster")))
    return points.select(*key, "id").join(of, [*key, "id"], "left")
