"""Robust statistics on lineitem; an order stands for an edge, a line for a sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import robust
from ..session import table

G = ["l_returnflag", "l_linestatus"]


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


def _report(spark, sf):
    disc = F.col("l_discount")
    got = robust.run_report(_lines(spark, sf), disc >= 0.05, F.col("l_tax") > 0.04, "l_quantity", "l_quantity")
    return got.withColumns({"mean_matched": F.round("mean_matched", 4), "worst": F.round("worst", 4)})


def _percentiles(spark, sf):
    lines = _lines(spark, sf)
    rms = lines.groupBy(*G).agg(F.round(F.sqrt(F.avg(F.col("l_quantity") ** 2)), 4).alias("rms"))
    return robust.percentiles(lines, G, "l_extendedprice", p50=0.5, p95=0.95).join(rms, G).select(*G, "n", "rms", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


def _energy(spark, sf):
    lines = _lines(spark, sf)
    pixels = lines.groupBy((F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 30).alias("y")).agg(F.max("l_quantity").alias("v"))
    pixels = pixels.withColumns({"cx": F.expr("x div 10"), "cy": F.expr("y div 10")})
    got = robust.cell_energy(pixels, ["cx", "cy"], "x", "y", "v")
    return got.select("cx", "cy", *[F.round(c, 4).alias(c) for c in ("mean", "variance", "gradient", "laplacian")])


QUERIES = {
    "median_mad_by_group": lambda spark, sf: robust.median_mad(_lines(spark, sf), G, "l_extendedprice").select(*G, F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"), "n"),
    "upper_median": lambda spark, sf: robust.upper_median(_lines(spark, sf), G, "l_extendedprice"),
    "p95_floor_index": lambda spark, sf: robust.p95_floor(_lines(spark, sf), G, "l_extendedprice"),
    "robust_step": lambda spark, sf: robust.robust_step(_lines(spark, sf), G, "l_quantity", "l_tax").select(*G, F.round("step_x", 4).alias("step_x"), F.round("step_y", 4).alias("step_y"), "inliers", F.round("rms", 4).alias("rms")),
    "axis_summary": lambda spark, sf: robust.axis_summary(_lines(spark, sf), ["l_orderkey"], "l_quantity", F.col("l_discount") >= 0.03).select("l_orderkey", F.round("median", 4).alias("median"), "accepted", "reliable"),
    "report_counts": _report,
    "weighted_means": lambda spark, sf: _lines(spark, sf).groupBy("l_suppkey").agg(F.round(robust.weighted_mean("l_discount", "l_quantity"), 4).alias("mean_discount"), F.round(robust.weighted_mean("l_tax", "l_quantity"), 4).alias("mean_tax")),
    "weighted_sample_rms": lambda spark, sf: _lines(spark, sf).groupBy("l_suppkey").agg(F.round(robust.weighted_rms("l_discount", "l_quantity"), 6).alias("rms")),
    "rms_by_edge_and_total": lambda spark, sf: robust.rms_report(_lines(spark, sf), ["l_suppkey"], "l_quantity").select("l_suppkey", F.round("rms", 4).alias("rms"), "max_residual", "n"),
    "coverage_cells": lambda spark, sf: robust.coverage(_lines(spark, sf), ["l_orderkey"], F.col("l_quantity"), F.col("l_discount"), 51.0, 0.11),
    "reliability_scale": lambda spark, sf: robust.reliability(_lines(spark, sf).select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("scale", 6).alias("scale")),
    "linear_percentiles": _percentiles,
    "endpoint_totals": lambda spark, sf: robust.endpoint_totals(_lines(spark, sf), "l_orderkey", "l_partkey", "l_quantity").withColumn("features", F.round("features", 4)),
    "window_max_confidence": lambda spark, sf: robust.window_confidence(_lines(spark, sf), "l_partkey", F.col("l_discount"), 1 - F.abs(F.col("l_quantity") / 25.5 - 1)).select("l_partkey", F.round("confidence", 6).alias("confidence")),
    "cell_statistics": _energy,
    "edge_quality": lambda spark, sf: robust.edge_quality(_lines(spark, sf).withColumn("wanted", F.col("l_orderkey") % 6), ["l_orderkey"], "l_quantity", "wanted").select("l_orderkey", "n", "p95", F.round("rms", 4).alias("rms"), "greatest", "complete"),
}
_G = "l_returnflag, l_linestatus"
ORACLES = {
    "median_mad_by_group": f"with m as (select {_G}, median(l_extendedprice) as med from lineitem group by all) select {_G}, round(med, 4) as median, round(median(abs(l_extendedprice - med)), 4) as mad, count(*) as n from lineitem join m using ({_G}) group by {_G}, med",
    "upper_median": f"with s as (select {_G}, list_sort(list(l_extendedprice)) as v from lineitem group by all) select {_G}, len(v)::bigint as n, v[len(v) // 2 + 1] as upper_median from s",
    "p95_floor_index": f"with s as (select {_G}, list_sort(list(l_extendedprice)) as v from lineitem group by all) select {_G}, len(v)::bigint as n, v[((len(v) - 1) * 95) // 100 + 1] as p95 from s",
    "robust_step": f"""
with m as (select {_G}, median(l_quantity) as mx, median(l_tax) as my from lineitem group by all),
r as (select {_G}, l_quantity as x, l_tax as y, sqrt((l_quantity - mx) ** 2 + (l_tax - my) ** 2) as r from lineitem join m using ({_G})),
c as (select {_G}, median(r) as mr from r group by all), d as (select {_G}, median(abs(r - mr)) as mad from r join c using ({_G}) group by all),
i as (select r.* from r join c using ({_G}) join d using ({_G}) where r <= greatest(0.005, mr + 3 * 1.4826 * mad)),
f as (select {_G}, median(x) as sx, median(y) as sy, count(*) as inliers from i group by all)
select {_G}, round(sx, 4) as step_x, round(sy, 4) as step_y, inliers, round(sqrt(avg((x - sx) ** 2 + (y - sy) ** 2)), 4) as rms from i join f using ({_G}) group by {_G}, sx, sy, inliers""",
    "axis_summary": """
with g as (select l_orderkey, l_quantity as v from lineitem where l_discount >= 0.03), m as (select l_orderkey, median(v) as med from g group by all)
select l_orderkey, round(med, 4) as median, count(*) as accepted, count(*) >= 2 and bool_and(abs(v - med) <= greatest(3.0, 0.1 * abs(med))) and bool_and(sign(v) = sign(med)) as reliable
from g join m using (l_orderkey) group by l_orderkey, med""",
    "report_counts": """select count(*) as edges, count_if(l_discount >= 0.05)::bigint as matched, count_if(l_discount >= 0.05 and l_tax > 0.04)::bigint as strong,
round(avg(case when l_discount >= 0.05 then l_quantity end), 4) as mean_matched, round(max(l_quantity), 4) as worst from lineitem""",
    "weighted_means": "select l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 4) as mean_discount, round(sum(l_tax * l_quantity) / sum(l_quantity), 4) as mean_tax from lineitem group by all",
    "weighted_sample_rms": "select l_suppkey, round(sqrt(sum(l_quantity * l_discount ** 2) / sum(l_quantity)), 6) as rms from lineitem group by all",
    "rms_by_edge_and_total": "select l_suppkey, round(sqrt(avg(l_quantity ** 2)), 4) as rms, max(l_quantity) as max_residual, count(*) as n from lineitem group by grouping sets ((l_suppkey), ())",
    "coverage_cells": """with c as (select l_orderkey, 1 << (least(greatest(floor(l_discount * 4 / 0.11), 0), 3) * 4 + least(greatest(floor(l_quantity * 4 / 51.0), 0), 3))::int as b from lineitem)
select l_orderkey, bit_or(b)::int as mask, bit_count(bit_or(b))::int as cells from c group by all""",
    "reliability_scale": "select l_orderkey, l_linenumber, round(least(1.0, greatest(0.001, l_extendedprice / (select median(l_extendedprice) from lineitem))), 6) as scale from lineitem",
    "linear_percentiles": f"select {_G}, count(*) as n, round(sqrt(avg(l_quantity ** 2)), 4) as rms, round(quantile_cont(l_extendedprice, 0.5), 4) as p50, round(quantile_cont(l_extendedprice, 0.95), 4) as p95 from lineitem group by all",
    "endpoint_totals": "with e as (select l_orderkey, l_partkey, max(l_quantity) as q from lineitem group by all) select l_orderkey, count(*) as endpoints, round(sum(q), 4) as features from e group by all",
    "window_max_confidence": "select l_partkey, round(max(l_discount * (1 - abs(l_quantity / 25.5 - 1))), 6) as confidence from lineitem group by all",
    "cell_statistics": """with p as (select l_partkey % 40 as x, l_suppkey % 30 as y, max(l_quantity) as v from lineitem group by 1, 2), c as (select *, x // 10 as cx, y // 10 as cy from p),
n as (select c.*, r.v as r, d.v as d, l.v as l, u.v as u from c left join c r on r.x = c.x + 1 and r.y = c.y and r.cx = c.cx left join c d on d.x = c.x and d.y = c.y + 1 and d.cy = c.cy left join c l on l.x = c.x - 1 and l.y = c.y and l.cx = c.cx left join c u on u.x = c.x and u.y = c.y - 1 and u.cy = c.cy)
select cx, cy, round(avg(v), 4) as mean, round(var_pop(v), 4) as variance, round(avg((r - v) ** 2 + (d - v) ** 2), 4) as gradient, round(avg((r + l + u + d - 4 * v) ** 2), 4) as laplacian from n group by 1, 2""",
    "edge_quality": """with s as (select l_orderkey, list_sort(list(l_quantity)) as v, max(l_orderkey % 6) as wanted from lineitem group by 1) select l_orderkey, len(v)::bigint as n, v[((len(v) - 1) * 95) // 100 + 1] as p95, round(sqrt(list_avg(list_transform(v, lambda x: x * x))), 4) as rms, v[-1] as greatest, len(v) >= wanted as complete from s""",
}
