"""Queries of Queen contiguity."""

from __future__ import annotations

from petriflow.operators import contiguity
from petriflow.plans.catalog import P, r, tidy
from petriflow.plans.registry import register
from petriflow.plans.views import points

# two cells meet where their bisector is in the frame and no third place is nearer: an interval on the bisector, bounded by places and sides
QUEEN = """bo AS (SELECT label, min(x) x0, max(x) x1, min(y) y0, max(y) y1, greatest(max(x)-min(x), max(y)-min(y))*1e-9 AS tie FROM points GROUP BY label),
 pq AS (SELECT a.label, a.id AS i, b.id AS j, a.x, a.y, b.x-a.x AS qx, b.y-a.y AS qy, sqrt((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y)) AS d FROM points a JOIN points b ON a.label = b.label AND a.id <> b.id),
 li AS (SELECT q.label, i, j, ((c.x-q.x)*(-qy)+(c.y-q.y)*qx)/d AS s, (((c.x-q.x)*(c.x-q.x)+(c.y-q.y)*(c.y-q.y)) - (qx*(c.x-q.x)+qy*(c.y-q.y)))/2 AS b FROM pq q JOIN points c ON c.label = q.label AND c.id <> i AND c.id <> j
  UNION ALL SELECT q.label, i, j, -qy/d, x1-x-qx/2 FROM pq q JOIN bo USING (label) UNION ALL SELECT q.label, i, j, qy/d, x-x0+qx/2 FROM pq q JOIN bo USING (label)
  UNION ALL SELECT q.label, i, j, qx/d, y1-y-qy/2 FROM pq q JOIN bo USING (label) UNION ALL SELECT q.label, i, j, -qx/d, y-y0+qy/2 FROM pq q JOIN bo USING (label)),
 iv AS (SELECT label, i, j, max(CASE WHEN s < 0 THEN b/s END) AS lo, min(CASE WHEN s > 0 THEN b/s END) AS hi, min(CASE WHEN s = 0 THEN b END) AS level FROM li GROUP BY ALL),
 qn AS (SELECT label, i, j FROM iv JOIN bo USING (label) WHERE lo <= hi + tie AND coalesce(level, 0) >= -tie)"""
LAG = "lg AS (SELECT label, id, v, count(*) AS n_neighbours, avg(w) AS lag FROM (SELECT p.label, p.id, p.v, o.v AS w FROM points p JOIN qn ON qn.label = p.label AND i = p.id JOIN points o ON o.label = p.label AND o.id = j) GROUP BY ALL)"


@register("queen_links", f"{P}, {QUEEN} SELECT label, i, j FROM qn")
def _(s, d):
    return contiguity.queen_links(points(s, d), "label")


@register("spatial_lag", f"{P}, {QUEEN}, {LAG} SELECT label, id, n_neighbours, {r(v='v', lag='lag')} FROM lg")
def _(s, d):
    return tidy(contiguity.spatial_lag(points(s, d), "label"))


@register("queen_moran", f"""{P}, {QUEEN}, {LAG}, ms AS (SELECT label, count(*) AS n, avg(v) AS m, var_pop(v) AS m2 FROM points GROUP BY label)
 SELECT label, n, {r(moran_i='avg((v-m)*(lag-m))/any_value(m2)', expected='-1.0/(n-1)')} FROM lg JOIN ms USING (label) GROUP BY label, n""")
def _(s, d):
    return tidy(contiguity.queen_moran(points(s, d), "label"))
