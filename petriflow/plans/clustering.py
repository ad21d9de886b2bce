"""Queries of hierarchical, sparse spectral and temporal clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from petriflow.operators import agglomeration, hierarchy, messages, spectrum, temporal
from petriflow.plans.catalog import C, r, tidy
from petriflow.plans.registry import register
from petriflow.plans.views import POINTS_SQL, cells, points
from petriflow.streaming import tracker

MOVED = """mv AS (SELECT a.label, a.time, a.cell_id AS id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM cells a JOIN cells b ON a.label = b.label AND a.time = b.time + 1),
 m1 AS (SELECT label, time, id, min(d) AS d FROM mv GROUP BY ALL)"""


def cell_points(s, d) -> DataFrame:
    return cells(s, d).select("label", "time", F.col("cell_id").alias("id"), "x", "y")


@register("hdbscan")
def _(s, d):
    return hierarchy.hdbscan(points(s, d), 5)


@register("hdbscan_by_time")
def _(s, d):
    return hierarchy.hdbscan(cell_points(s, d), 5, "time")


@register("ward_clusters")
def _(s, d):
    return agglomeration.ward_clusters(points(s, d), 7)


@register("ward_merges")
def _(s, d):
    return tidy(agglomeration.ward_merges(points(s, d), "label"))


@register("birch_sums", f"""WITH {POINTS_SQL} SELECT label, count(*) AS n, {r(sx="sum(x)", sy="sum(y)", ss="sum(x*x+y*y)")}, 0::BIGINT AS wide FROM points GROUP BY label""")
def _(s, d):
    f = agglomeration.birch_features(points(s, d), 0.5, 50, "label")
    wide = F.col("ss") / F.col("n") - F.col("x") ** 2 - F.col("y") ** 2 > 0.25 + 1e-9
    return tidy(f.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "ss")], F.sum(wide.cast("long")).alias("wide")))


@register("birch_clusters")
def _(s, d):
    return agglomeration.birch_clusters(points(s, d))


@register("affinity_propagation")
def _(s, d):
    return messages.affinity_clusters(points(s, d), 20)


@register("spectral_sparse")
def _(s, d):
    return spectrum.spectral_clusters(points(s, d), 10, count=6)


@register("spectrum_numbers")
def _(s, d):
    return spectrum.cluster_numbers(spectrum.laplacian_spectrum(points(s, d), 10, 12))


@register("track_points")
def _(s, d):
    return tracker.follow_batch(cell_points(s, d).withColumnRenamed("label", "seq"))


@register("temporal_affinity", f"""{C}, {MOVED}, s AS (SELECT label, time, quantile_cont(d, 0.5) AS s FROM m1 GROUP BY ALL)
 SELECT label, time, id, {r(d="d", affinity="CASE WHEN s > 0 THEN exp(-d*d/(2*s*s)) WHEN d = 0 THEN 1 ELSE 0 END")} FROM m1 JOIN s USING (label, time)""")
def _(s, d):
    return tidy(temporal.temporal_affinity(cell_points(s, d), "label"))


@register("temporal_similarity", f"""{C}, {MOVED}, m3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM mv) WHERE k <= 3),
 s AS (SELECT label, time, 1.4 * quantile_cont(d, 0.5) AS s, quantile_cont(d, 0.95) AS most FROM m3 GROUP BY ALL)
 SELECT label, time, id, {r(similarity="avg(exp(-(least(d, most)/most)*(least(d, most)/most)/(2*s*s)))")} FROM m3 JOIN s USING (label, time) WHERE s > 0 GROUP BY ALL""")
def _(s, d):
    return tidy(temporal.temporal_similarity(cell_points(s, d), "label"))


@register("temporal_weight", f"""{C}, {MOVED}, s AS (SELECT label, time, quantile_cont(d, 0.5) AS moved FROM m1 GROUP BY ALL),
 pr AS (SELECT a.label, a.time, a.cell_id AS id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM cells a JOIN cells b ON a.label = b.label AND a.time = b.time AND a.cell_id <> b.cell_id),
 la AS (SELECT label, time, id, max(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d) AS k FROM pr) WHERE k <= 20 GROUP BY ALL),
 sc AS (SELECT label, time, quantile_cont(d, 0.5) AS scale FROM la GROUP BY ALL)
 SELECT s.label, s.time, {r(weight="CASE WHEN a.scale + b.scale <> 0 THEN exp(-2*moved/(a.scale+b.scale)) END")} FROM s JOIN sc a ON a.label = s.label AND a.time = s.time JOIN sc b ON b.label = s.label AND b.time = s.time - 1""")
def _(s, d):
    return tidy(temporal.temporal_weight(cell_points(s, d), 20, "label"))


_FEATURES = """ce AS (SELECT label, time, cluster, count(*) AS size, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, var_samp(y) AS b, covar_samp(x, y) AS c FROM pt GROUP BY ALL),
 ra AS (SELECT label, time, cluster, max(sqrt((x-cx)*(x-cx)+(y-cy)*(y-cy))) AS radius FROM pt JOIN ce USING (label, time, cluster) GROUP BY ALL),
 fe AS (SELECT label, time, cluster, size, cx, cy, radius, CASE WHEN size < 2 THEN 0 ELSE greatest((a+b)/2 - sqrt((a-b)*(a-b)/4+c*c), 0) / ((a+b)/2 + sqrt((a-b)*(a-b)/4+c*c) + 1e-10) END AS shape,
  CASE WHEN size < 2 THEN 0 ELSE atan2(2*c, a-b)/2 END AS angle FROM ce JOIN ra USING (label, time, cluster))"""


@register("feature_similarity", f"""{C}, pt AS (SELECT label, time, cell_id % 3 AS cluster, x, y FROM cells), {_FEATURES}
 SELECT f.label, f.time, f.cluster, p.cluster AS previous, {r(similarity="0.4*exp(-sqrt((f.cx-p.cx)*(f.cx-p.cx)+(f.cy-p.cy)*(f.cy-p.cy))/(f.radius+1e-10)) + 0.3*least(f.size, p.size)/greatest(f.size, p.size) + 0.2*exp(-abs(f.shape-p.shape)) + 0.1*exp(-abs(f.angle-p.angle))")}
 FROM fe f JOIN fe p ON p.label = f.label AND p.time = f.time - 1""")
def _(s, d):
    p = cell_points(s, d).withColumn("cluster", F.col("id") % 3)
    return tidy(temporal.feature_similarity(p, "label"))


@register("density_valleys", f"""{C}, pt AS (SELECT label, time, 0 AS cluster, x, y FROM cells), {_FEATURES},
 tt AS (SELECT p.label, p.time, (x-cx)*cos(angle)+(y-cy)*sin(angle) AS t FROM pt p JOIN fe USING (label, time)), en AS (SELECT label, time, min(t) AS lo, max(t) AS hi, stddev_pop(t) AS s FROM tt GROUP BY ALL HAVING stddev_pop(t) > 0),
 sp AS (SELECT label, time, g.i AS g, lo + g.i*(hi-lo)/199 AS place, sum(exp(-power((lo + g.i*(hi-lo)/199 - t)/(s*0.25), 2)/2)) AS f FROM tt JOIN en USING (label, time) CROSS JOIN range(200) g(i) GROUP BY ALL),
 de AS (SELECT *, 1 - f/least(max(f) OVER (PARTITION BY label, time ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), max(f) OVER (PARTITION BY label, time ORDER BY g ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS depth FROM sp),
 k AS (SELECT DISTINCT label, time FROM cells) SELECT k.label, k.time, {r(score="coalesce(max(depth), 0)")} FROM k LEFT JOIN de ON de.label = k.label AND de.time = k.time GROUP BY ALL""")
def _(s, d):
    return tidy(temporal.valleys(cell_points(s, d), "label", "time").select("label", "time", "score"))


@register("valley_splits")
def _(s, d):
    p = cell_points(s, d).withColumn("cluster", F.lit(0))
    return temporal.split_at_valleys(p, 5, 0.6, "label", "time").select("label", "time", "id", "part")
