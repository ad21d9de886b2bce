"""Queries of parameters that change over time, the clustering that follows them, and the whole imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from petriflow.operators import imputation, schedules
from petriflow.plans.catalog import C, r, tidy
from petriflow.plans.registry import register
from petriflow.plans.views import cells

_ROWS = ", ".join(f"('{n}{suffix}', {x}, {float(y)})" for suffix, knots in (("", schedules.FIRST), ("_new", schedules.SECOND)) for n, (xs, ys) in knots.items() for x, y in zip(xs, ys, strict=True))
_NAMES = [*schedules.FIRST, *(f"{n}_new" for n in schedules.SECOND)]


@register("parameter_schedules", f"""{C}, k(name, x, y) AS (VALUES {_ROWS}), e AS (SELECT name, min(x) AS x0, max(x) AS x1 FROM k GROUP BY name),
 t AS (SELECT time, name, x0 + (time - 1.0::DOUBLE) * (x1 - x0) / (x1 - 1.0) AS u FROM (SELECT DISTINCT time FROM cells) CROSS JOIN e),
 s AS (SELECT name, x AS xa, y AS ya, lead(x) OVER w AS xb, lead(y) OVER w AS yb FROM k WINDOW w AS (PARTITION BY name ORDER BY x)),
 v AS (SELECT time, name, ya::DOUBLE + (u - xa) * (yb::DOUBLE - ya) / (xb - xa) AS v FROM t JOIN s USING (name) WHERE xb IS NOT NULL AND u >= xa AND (u < xb OR (u = xb AND xb = (SELECT max(x) FROM k WHERE k.name = s.name))))
 SELECT time, {r(**{n: f"max(CASE WHEN name = '{n}' THEN v END)" for n in _NAMES})} FROM v GROUP BY time""")
def _(s, d):
    times = cells(s, d).select("time").distinct()
    return tidy(schedules.parameters(schedules.parameters(times, schedules.FIRST), schedules.SECOND, suffix="_new"))


@register("scheduled_clusters")
def _(s, d):
    # the days stand for the recording's last 31 times
    p = cells(s, d).select("time", F.col("cell_id").alias("id"), "x", "y")
    return schedules.scheduled_clusters(p, schedules.SECOND, first=88)


@register("impute_series", f"""{C}, ok AS (SELECT * FROM cells WHERE (label*7+time) % 5 <> 0), h AS (SELECT label, time, count(*)::DOUBLE AS n, avg(x) AS cx, avg(y) AS cy FROM ok GROUP BY ALL),
 sp AS (SELECT label, min(time) lo, max(time) hi FROM h GROUP BY label), ev AS (SELECT label, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS time FROM sp),
 b AS (SELECT ev.label, ev.time, (SELECT max(time) FROM h q WHERE q.label = ev.label AND q.time <= ev.time) t0, (SELECT min(time) FROM h q WHERE q.label = ev.label AND q.time >= ev.time) t1 FROM ev),
 f AS (SELECT b.label, b.time, t0, p.n + (q.n - p.n) * (b.time - t0) / (t1 - t0) AS n, (q.cx - p.cx) * (b.time - t0) / (t1 - t0) AS dx, (q.cy - p.cy) * (b.time - t0) / (t1 - t0) AS dy
  FROM b JOIN h p ON p.label = b.label AND p.time = t0 JOIN h q ON q.label = b.label AND q.time = t1 WHERE t0 < b.time),
 pl AS (SELECT *, CAST(unnest(range(0, CAST(trunc(n) AS BIGINT))) AS INTEGER) AS copy FROM f),
 po AS (SELECT *, row_number() OVER (PARTITION BY label, time ORDER BY cell_id) - 1 AS k, count(*) OVER (PARTITION BY label, time) AS of FROM ok)
 SELECT cell_id, label, time, CAST(NULL AS INTEGER) AS copy, {r(x="x", y="y")} FROM ok
 UNION ALL SELECT cell_id, pl.label, pl.time, copy, {r(x="x + dx", y="y + dy")} FROM pl JOIN po ON po.label = pl.label AND po.time = t0 AND po.k = copy % of""")
def _(s, d):
    ok = cells(s, d).where("(label * 7 + time) % 5 <> 0")
    return tidy(imputation.impute_series(ok, smooth=False), "cell_id", "label", "time", "copy", "x", "y")
