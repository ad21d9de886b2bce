"""Linking of clusters across times, merging, assignment, tracking metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from petriflow.functions.numeric import assign
from petriflow.operators.clusters import merge_stats


def link_nearest(clusters: DataFrame, reach: float, size_gap: float) -> DataFrame:
    """(time, label, previous): the nearest cluster of the time before within reach whose size differs by less than size_gap."""
    a, b = clusters.alias("a"), clusters.alias("b")
    d = F.sqrt((F.col("a.cx") - F.col("b.cx")) ** 2 + (F.col("a.cy") - F.col("b.cy")) ** 2)
    p = a.join(b, F.expr("a.time = b.time + 1")).withColumn("d", d).where((F.col("d") < reach) & (F.abs(F.col("a.n_cell") - F.col("b.n_cell")) < size_gap))
    best = p.select("a.time", "a.label", F.col("b.label").alias("previous"), "d").withColumn("k", F.row_number().over(Window.partitionBy("time", "label").orderBy("d", "previous"))).where("k = 1")
    return clusters.select("time", "label").join(best.select("time", "label", "previous", "d"), ["time", "label"], "left")


def _fold(pdf: pd.DataFrame, reach: float, size_gap: float) -> pd.DataFrame:
    """Greedy one-to-one links in order of label, time after time; unmatched clusters get new numbers."""
    out, known, top = [], {}, -1
    for time, now in pdf.sort_values(["time", "label"]).groupby("time", sort=True):
        free, current = dict(known), {}
        for row in now.itertuples():
            options = [(float(np.hypot(row.cx - x, row.cy - y)), k) for k, (x, y, n) in free.items() if abs(row.n_cell - n) < size_gap]
            options = [o for o in options if o[0] < reach]
            if options:
                link = min(options)[1]
                del free[link]
            else:
                top += 1
                link = top
            current[link] = (row.cx, row.cy, row.n_cell)
            out.append((row.seq, time, row.label, link))
        known = current
    return pd.DataFrame(out, columns=["seq", "time", "label", "track"])


def link_greedy(clusters: DataFrame, reach: float, size_gap: float) -> DataFrame:
    """(seq, time, label, track): an ordered fold over the times of each sequence, sequences in parallel."""
    clusters = clusters if "seq" in clusters.columns else clusters.withColumn("seq", F.lit(0))
    kinds = dict(clusters.dtypes)
    return clusters.groupBy("seq").applyInPandas(lambda pdf: _fold(pdf, reach, size_gap), f"seq {kinds['seq']}, time {kinds['time']}, label {kinds['label']}, track long")


def merge_boxes(clusters: DataFrame, near: float) -> DataFrame:
    """(time, label, merged): clusters within `near` on both axes merge, centroids weighted by cells, until no pair is left; `merged` is the
    smallest label of those together."""
    kinds = dict(clusters.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = [[r.cx, r.cy, r.n_cell, [r.label]] for r in pdf.sort_values("label").itertuples()]
        again = True
        while again:
            again = False
            for i in range(len(groups)):
                for j in range(i + 1, len(groups)):
                    a, b = groups[i], groups[j]
                    if abs(a[0] - b[0]) < near and abs(a[1] - b[1]) < near:
                        n = a[2] + b[2]
                        groups[i] = [(a[0] * a[2] + b[0] * b[2]) / n, (a[1] * a[2] + b[1] * b[2]) / n, n, a[3] + b[3]]
                        del groups[j]
                        again = True
                        break
                if again:
                    break
        rows = [(pdf["time"].iloc[0], m, min(g[3])) for g in groups for m in g[3]]
        return pd.DataFrame(rows, columns=["time", "label", "merged"])

    return clusters.groupBy("time").applyInPandas(run, f"time {kinds['time']}, label {kinds['label']}, merged {kinds['label']}")


def merged_boxes(summaries: DataFrame, near: float) -> DataFrame:
    """(time, merged, n_merged, ...): statistics of the clusters of a summary that merge_boxes puts together, with how many they were."""
    of = summaries.join(merge_boxes(summaries, near), ["time", "label"])
    number = of.groupBy("time", "merged").agg(F.count("*").alias("n_merged"))
    return merge_stats(of, "time", "merged").join(number, ["time", "merged"])


def assign_optimal(clusters: DataFrame, slack: float = 1.5) -> DataFrame:
    """(time, label, previous, distance): least-cost one-to-one links with the time before; those of slack times the median or more go."""
    a = clusters.select("time", "label", "cx", "cy", F.lit(0).alias("side"))
    b = clusters.select((F.col("time") + 1).alias("time"), "label", "cx", "cy", F.lit(1).alias("side"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        now, then = (pdf[pdf["side"] == s].sort_values("label") for s in (0, 1))
        if not len(now) or not len(then):
            return pd.DataFrame({"time": [], "label": [], "previous": [], "distance": []})
        cost = np.hypot(now["cx"].to_numpy()[:, None] - then["cx"].to_numpy(), now["cy"].to_numpy()[:, None] - then["cy"].to_numpy())
        pairs = assign(cost)
        limit = slack * float(np.median([cost[p] for p in pairs]))
        kept = [p for p in pairs if cost[p] < limit or limit == 0]
        return pd.DataFrame({"time": int(now["time"].iloc[0]), "label": [int(now["label"].iloc[i]) for i, _ in kept], "previous": [int(then["label"].iloc[j]) for _, j in kept], "distance": [float(cost[p]) for p in kept]})

    kinds = dict(clusters.dtypes)
    return a.union(b).groupBy("time").applyInPandas(run, f"time {kinds['time']}, label {kinds['label']}, previous {kinds['label']}, distance double")


def ari(found: DataFrame, truth: str, predicted: str, *key: str) -> DataFrame:
    """Adjusted Rand index of two labellings in each key."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    cell = found.groupBy(*key, truth, predicted).agg(F.count("*").alias("n"))
    both = cell.groupBy(*key).agg(two("n").alias("s"), F.sum("n").alias("total"))
    rows = cell.groupBy(*key, truth).agg(F.sum("n").alias("n")).groupBy(*key).agg(two("n").alias("a"))
    cols = cell.groupBy(*key, predicted).agg(F.sum("n").alias("n")).groupBy(*key).agg(two("n").alias("b"))
    j = both.join(rows, [*key]).join(cols, [*key])
    expect = F.try_divide(F.col("a") * F.col("b"), F.col("total") * (F.col("total") - 1) / 2.0)
    span = (F.col("a") + F.col("b")) / 2.0 - expect
    return j.select(*key, F.when(span == 0, 1.0).otherwise((F.col("s") - expect) / span).alias("ari"))


def centre_error(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(time, error): mean distance of predicted centres (cx, cy) to the nearest true centre (tx, ty) of the time."""
    d = F.sqrt((F.col("cx") - F.col("tx")) ** 2 + (F.col("cy") - F.col("ty")) ** 2)
    near = predicted.join(truth.select("time", "tx", "ty"), "time").groupBy("time", "label").agg(F.min(d).alias("d"))
    return near.groupBy("time").agg(F.avg("d").alias("error"))


def stability(clusters: DataFrame, *key: str) -> DataFrame:
    """1 / (1 + population deviation of the number of clusters over time)."""
    per = clusters.groupBy(*key, "time").agg(F.countDistinct("label").alias("k"))
    return (per.groupBy(*key) if key else per).agg((1 / (1 + F.stddev_pop("k"))).alias("stability"), F.avg("k").alias("mean_clusters"))


def score_times(found: DataFrame, *key: str) -> DataFrame:
    """(key, time, ari, n_clusters, n_true, error) of labelled points (key, time, x, y, cluster, truth): agreement, numbers of clusters, and the
    mean distance of the clusters' centroids to the nearest true one."""
    by = [*key, "time"]
    centre = lambda c, x, y: found.groupBy(*by, c).agg(F.avg("x").alias(x), F.avg("y").alias(y))
    d = F.sqrt((F.col("cx") - F.col("tx")) ** 2 + (F.col("cy") - F.col("ty")) ** 2)
    near = centre("cluster", "cx", "cy").join(centre("truth", "tx", "ty"), by).groupBy(*by, "cluster").agg(F.min(d).alias("d"))
    error = near.groupBy(*by).agg(F.avg("d").alias("error"), F.count("*").alias("n_clusters"))
    true = found.groupBy(*by).agg(F.countDistinct("truth").alias("n_true"))
    return ari(found, "truth", "cluster", *by).join(error, by).join(true, by)


def overall_scores(scores: DataFrame, *key: str) -> DataFrame:
    """(key, mean_ari, number_accuracy, mean_error, stability) over the times."""
    right = F.avg((F.col("n_clusters") == F.col("n_true")).cast("double"))
    return (scores.groupBy(*key) if key else scores).agg(F.avg("ari").alias("mean_ari"), right.alias("number_accuracy"), F.avg("error").alias("mean_error"), (1 / (1 + F.stddev_pop("n_clusters"))).alias("stability"))
