"""Edge queries: lines are samples of edges, a customer's orders are a capture."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edges, matrices
from ..session import table
from .shared import duck, times, turn, view

SAMPLES = """select l_orderkey, l_linenumber, (l_quantity - 45) * 20e0 as axis_step, l_extendedprice % 97 - 48 as cross_step, cast(l_suppkey % 9 - 5 as int) as r0, cast(l_partkey % 40 as int) as inliers,
(l_partkey % 10) * 0.1e0 as ratio, l_tax * 50 as residual from {lineitem}"""
_SAMPLED = f"select *, case when r0 > 0 then r0 else 0 end as reason from ({SAMPLES}) x"
EDGES = """select l_orderkey * 10 + l_linenumber as edge, l_linenumber % 2 = 0 as horizontal, l_quantity * 7 - 200 as dx, l_extendedprice % 61 - 30 as dy, -150e0 as expected_x, 10e0 as expected_y,
cast(l_partkey % 50 as int) as matches, cast(l_partkey % 40 as int) as inliers, (l_suppkey % 10) * 0.1e0 as ratio, cast(l_partkey % 5 as int) as reason, 200e0 + l_linenumber as width, 120e0 as height,
l_tax * 1000 as angle_a, l_discount * 1000 as angle_b, (l_linenumber - 2) * 20e0 as fov_a, 60e0 as fov_b from {lineitem}"""
LOOPS = """with g as (select o_orderkey, o_orderkey % 16 as cell, cast(floor(o_orderkey / 16) as bigint) as capture, (o_custkey % 19) * 0.004e0 as a, floor(o_totalprice) * 1e0 as w from {orders})
select capture, cell as "from", cell + 1 as "to", a as angle, w as weight from g where cell % 4 < 3 union all select capture, cell as "from", cell + 4 as "to", a * 0.5e0 as angle, w * 0.9e0 as weight from g where cell < 12"""
PULLS = 'select l_partkey as "from", l_partkey + l_linenumber as "to", l_linenumber * -9.5e0 - l_discount * 10 as dx, 1e0 + l_quantity * 0.1e0 as w from {lineitem}'
POINTS = 'select l_orderkey as "from", cast(l_linenumber % 2 as bigint) as "to", l_quantity as sx, l_discount * 900 as sy, l_tax * 3000 as tx, l_quantity * 2 as ty from {lineitem}'
HOLDOUT = 'select l_orderkey as capture, l_linenumber as edge, cast(l_quantity as int) % 8 as cells, case when l_linenumber % 5 > 0 then l_tax end as p95, l_discount as rms from {lineitem}'
LINES = """select o_orderkey as "from", o_orderkey + 1 as "to", o_custkey % 50 as line, case when o_orderkey % 3 > 0 and o_custkey % 50 > 5 then round(o_totalprice, 2) end as step from {orders}"""


def _edges(spark, sf):
    c = F.col
    df = view(spark, sf, EDGES)
    ok = edges.accepted(c("horizontal"), c("dx"), c("dy"), c("expected_x"), c("expected_y"), c("matches"), c("inliers"), c("ratio"), c("width"), c("height"))
    step = edges.nominal_step(edges.expected_step(c("angle_a"), c("angle_b"), c("fov_a"), c("fov_b"), c("width")), c("width"), F.lit(0.3))
    return df.select("edge", ok.alias("accepted"), edges.reason_label(c("reason"), c("matches"), c("inliers")).alias("reason"), F.round(step, 4).alias("step"))


def _spark(sql):
    return sql.replace('"', "`")


def _weak(spark, sf):
    points = view(spark, sf, _spark(POINTS))
    own = points.select("from", "to").distinct().withColumn("worst_loop", (F.col("from") % 7 * 12).cast("double"))
    return edges.thin_support(points, own, 51.0, 91.0).select("from", "to", "unique", "removed")


def _turned(spark, sf):
    """Edges that turn about an axis of their own."""
    v = F.array(F.col("angle") * 0.3, F.col("angle"), F.col("weight") % 7 * 0.001)
    return view(spark, sf, _spark(LOOPS)).withColumn("_v", v).withColumn("rotation", matrices.rotation(F.col("_v"))).drop("_v")


def _relaxed(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 10.0).alias("x"))
    return edges.relaxed(nodes, view(spark, sf, _spark(PULLS)), 5).select("id", F.round("x", 5).alias("x"))


def _synthesized(spark, sf):
    rows = view(spark, sf, _spark(LINES))
    return edges.synthesized(rows.select("from", "to", "line"), rows.where("step is not null").select("from", "to", "step"), 100.0).select("from", "to", "line", F.round("step", 4).alias("step"), "source")


QUERIES = {
    "overlap_status": lambda spark, sf: edges.overlap_status(view(spark, sf, _SAMPLED), 1000.0).select("l_orderkey", "l_linenumber", F.round("overlap", 6).alias("overlap"), "status"),
    "overlap_estimate": lambda spark, sf: edges.overlap_estimate(view(spark, sf, _SAMPLED), ["l_orderkey"], 1000.0).select("l_orderkey", "accepted", F.round("step", 4).alias("step"), F.round("overlap", 6).alias("overlap")),
    "edge_acceptance": _edges,
    "central_pairs": lambda spark, sf: edges.central_pairs(table(spark, sf, "nation").select(F.col("n_nationkey").alias("grid"), (1 + F.col("n_nationkey") % 5).cast("long").alias("rows"), (1 + F.col("n_nationkey") * 3 % 7).cast("long").alias("columns")), "grid").select("grid", "axis", "from", "to", F.col("place").cast("long").alias("place")),
    "loop_weights": lambda spark, sf: edges.loop_weights(_turned(spark, sf), ["capture"], 4, 1000.0).select("capture", "from", "to", F.round("worst_loop", 4).alias("worst_loop"), "ambiguous", F.round("scaled", 4).alias("scaled")),
    "thin_support": _weak,
    "relaxed_places": _relaxed,
    "synthesized_edges": _synthesized,
    "chosen_edges": lambda spark, sf: edges.chosen(view(spark, sf, HOLDOUT), "capture", "cells", "p95", "rms", "edge").select("capture", F.col("representative.edge").alias("representative"), F.col("worst.edge").alias("worst")),
}
_T = f"""s as ({duck(_SAMPLED)}), t as (select *, 1 - abs(axis_step) / 1000 as overlap, abs(cross_step) <= abs(axis_step) * 0.15 + 2 as ok_c, axis_step < 0 as ok_d from s),
u as (select *, case when reason = 0 and inliers >= 12 and ratio >= 0.25 and residual <= 3 and ok_d and overlap between 0.05 and 0.95 and ok_c then 'accepted' when not ok_c then 'rejected-cross-axis-motion' when not ok_d then 'rejected-grid-direction'
  when overlap < 0.05 or overlap > 0.95 then 'rejected-overlap-range' when residual > 3 then 'rejected-reprojection-residual' when inliers < 12 or ratio < 0.25 then 'rejected-insufficient-inliers' else 'rejected-homography' end as status from t)"""


def _relaxed_sql() -> str:
    now, ctes = "x0", ["x0 as (select p_partkey as id, p_partkey * 10.0::double as x from part)", f"""e as (select "from" as f, "to" as t, dx, w from ({duck(PULLS)}))""", "b as (select t as id, f as other, -dx as off, w from e union all select f, t, dx, w from e)"]
    for k in range(1, 6):
        ctes.append(f"x{k} as (select n.id, case when n.id = 0 or sum(b.w) is null then any_value(n.x) else any_value(n.x) * 0.35::double + sum((o.x + b.off) * b.w) / sum(b.w) * (1 - 0.35::double) end as x from {now} n left join (b join {now} o on o.id = b.other) on b.id = n.id group by n.id)")
        now = f"x{k}"
    return f"with {', '.join(ctes)} select id, round(x, 5) as x from {now}"


ORACLES = {
    "overlap_status": f"with {_T} select l_orderkey, l_linenumber, round(overlap, 6) as overlap, status from u",
    "overlap_estimate": f"""with {_T}, g as (select * from u where status = 'accepted'), m as (select l_orderkey, median(axis_step) as med from g group by 1),
a as (select l_orderkey, med, count(*) as accepted, count(*) >= 2 and bool_and(abs(axis_step - med) <= greatest(3.0, 0.1 * abs(med))) and bool_and(sign(axis_step) = sign(med)) as fine from g join m using (l_orderkey) group by 1, 2)
select l_orderkey, accepted, case when fine then round(med, 4) end as step, case when fine then round(1 - abs(med) / 1000, 6) end as overlap from a""",
    "edge_acceptance": f"""with e as ({duck(EDGES)}), p as (select *, abs(dx - expected_x) <= greatest(24.0, width * 0.4::double) and abs(dy - expected_y) <= greatest(18.0, height * 0.35::double) as prior,
  case when horizontal then dx else dy end as al, case when horizontal then dy else dx end as ac, case when horizontal then width else height end as ex, case when horizontal then height else width end as ce, case when horizontal then expected_x else expected_y end as wa from e)
select edge, matches >= 16 and inliers >= 16 and ratio >= 0.25 and (prior or (abs(al) >= 8 and abs(al) <= ex * 0.95::double and abs(ac) <= greatest(18.0, ce * 0.45::double) and (abs(wa) < 1e-6 or sign(al) = sign(wa)))) as accepted,
  case when reason = 1 then 'NO_DESCRIPTORS' when reason = 2 then 'TOO_FEW_MUTUAL_RATIO_MATCHES' when reason = 3 then 'RANSAC_FAILED' when matches > 0 and inliers < 10 then 'LOW_INLIER_SUPPORT' else 'REGISTRATION_FAILED' end as reason,
  round(case when fov_a > 0 and abs(angle_b - angle_a) > 0 then -(abs(angle_b - angle_a) / ((fov_a + fov_b) * 0.5::double) * width) else -(width * (1 - 0.3::double)) end, 4) as step from p""",
    "central_pairs": """with g as (select n_nationkey as grid, (1 + n_nationkey % 5)::bigint as rs, (1 + n_nationkey * 3 % 7)::bigint as cs from nation), k as (select *, unnest(range(rs * cs)) as id, unnest(['horizontal', 'vertical']) as axis from g),
a as (select grid, rs, cs, axis, unnest(range(rs * cs)) as id from g, (values ('horizontal'), ('vertical')) x(axis)), c as (select *, id // cs as r, id % cs as c from a),
f as (select * from c where (axis = 'horizontal' and c < cs - 1) or (axis = 'vertical' and r < rs - 1)),
s as (select *, case when axis = 'horizontal' then rs > 1 and cs > 2 and r = greatest(0, least(10, rs - 3)) and c between greatest(0, least(10, cs - 3)) and greatest(0, least(10, cs - 3)) + 1
  else rs > 2 and cs > 1 and c = greatest(0, least(10, cs - 3)) and r between greatest(0, least(10, rs - 3)) and greatest(0, least(10, rs - 3)) + 1 end as seed,
  ((r + case when axis = 'vertical' then 0.5::double else 0 end - (rs - 1) * 0.5::double) / rs) as y, ((c + case when axis = 'horizontal' then 0.5::double else 0 end - (cs - 1) * 0.5::double) / cs) as x from f),
d as (select *, row_number() over (partition by grid, axis order by seed desc, case when seed then 0 else x * x + y * y end, id) as place from s)
select grid, axis, id as "from", id + case when axis = 'horizontal' then 1 else cs end as "to", place from d where place <= 12""",
    "loop_weights": f"""with v as (select *, angle * 0.3::double as ax, weight % 7 * 0.001::double as az, sqrt(ax * ax + angle * angle + az * az) as t from ({duck(LOOPS)})),
e as (select *, case when t = 0 then [1::double, 0, 0, 0, 1, 0, 0, 0, 1] else {turn(["ax", "angle", "az"])} end as m from v), l0 as (select t.m as tm, r.m as rm, b.m as bm, l.m as lm, t.capture, t."from" as cell, t."from" as f1, t."to" as t1, t.weight as w1, r."from" as f2, r."to" as t2, r.weight as w2, b."from" as f3, b."to" as t3, b.weight as w3, l."from" as f4, l."to" as t4, l.weight as w4
  from e t join e r on r.capture = t.capture and r."from" = t."to" and r."to" = t."to" + 4 join e b on b.capture = t.capture and b."from" = t."from" + 4 and b."to" = t."from" + 5 join e l on l.capture = t.capture and l."from" = t."from" and l."to" = t."from" + 4 where t."to" = t."from" + 1), l1 as (select *, {times("tm", "rm")} as way, {times("lm", "bm")} as back from l0), l2 as (select *, [back[1], back[4], back[7], back[2], back[5], back[8], back[3], back[6], back[9]] as home from l1), l3 as (select *, {times("way", "home")} as c from l2),
l as (select *, atan2(sqrt((c[8] - c[6]) ** 2 + (c[3] - c[7]) ** 2 + (c[4] - c[2]) ** 2), c[1] + c[5] + c[9] - 1) * 1000 as residual from l3),
i as (select capture, cell, residual, unnest([{{'w': w1, 'f': f1, 't': t1}}, {{'w': w2, 'f': f2, 't': t2}}, {{'w': w3, 'f': f3, 't': t3}}, {{'w': w4, 'f': f4, 't': t4}}]) as e from l),
k as (select capture, cell, residual, e.w as w, e.f as f, e.t as t, row_number() over (partition by capture, cell order by e.w, e.f, e.t) as rank from i),
n as (select *, nth_value(w, 1) over q >= nth_value(w, 2) over q * 0.85::double as tied from k window q as (partition by capture, cell order by rank rows between unbounded preceding and unbounded following)),
j as (select capture, f, t, max(residual) as worst, bool_or(residual > 12 and not tied and rank = 1) as weak, bool_or(residual > 12 and tied) as unclear from n group by 1, 2, 3)
select e.capture, e."from", e."to", round(worst, 4) as worst_loop, coalesce(unclear, false) and not coalesce(weak, false) as ambiguous, round(weight * case when coalesce(weak, false) then 0.05::double else 1 end, 4) as scaled from e left join j on j.capture = e.capture and j.f = e."from" and j.t = e."to\"""",
    "thin_support": f"""with p as (select distinct * from ({duck(POINTS)})), s as (select "from", "to", count(*) as uniq, count(distinct least(greatest(floor(sy * 8 / 91), 0), 7)) as sr, count(distinct least(greatest(floor(sx * 8 / 51), 0), 7)) as sc, least((max(sx) - min(sx)) / 51, (max(sy) - min(sy)) / 91) as st,
  count(distinct least(greatest(floor(ty * 8 / 91), 0), 7)) as tr, count(distinct least(greatest(floor(tx * 8 / 51), 0), 7)) as tc, least((max(tx) - min(tx)) / 51, (max(ty) - min(ty)) / 91) as tt from p group by 1, 2)
select "from", "to", uniq as "unique", "from" % 7 * 12 >= 48 and uniq < 16 and (sr <= 1 or sc <= 1) and st <= 0.125 and (tr <= 1 or tc <= 1) and tt <= 0.125 as removed from s""",
    "relaxed_places": _relaxed_sql(),
    "synthesized_edges": f"""with l as ({duck(LINES)}), m as (select line, median(step) as ml from l group by 1), a as (select median(step) as ma from l)
select "from", "to", line, round(coalesce(step, ml, ma), 4) as step, case when step is not null then 'visual' when ml is not null then 'line' else 'all' end as source from l join m using (line), a""",
    "chosen_edges": f"""with h as ({duck(HOLDOUT)}) select capture, (first(edge order by -cells, coalesce(p95, 'inf'::double), rms, edge))::int as representative, (first(edge order by coalesce(p95, '-inf'::double) desc, rms desc, edge))::int as worst from h group by capture""",
}
