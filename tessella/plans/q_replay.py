"""Queries of replays, of steps made from rotations and of runs on the output: orders are the edges of 4 x 4 grids, lines are runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match, matrices, poses, replay, runs
from ..session import dealt, once
from .shared import duck, ticked, times, turn, view

C = F.col
#: Sixteen orders a capture; the planted edges turn by even steps, off by a little, and one in 23 by 60 to 140 pixels more.
CAPTURES = """with g as (select o_orderkey % 16 as cell, cast(floor(o_orderkey / 16) as bigint) as capture, o_custkey as k, floor(o_totalprice) * 1e0 as w from {orders}),
e as (select capture, cell * 2 as edge, cell as "from", cell + 1 as "to", k, w, 0.3e0 as across, 0e0 as down from g where cell % 4 < 3 union all select capture, cell * 2 + 1, cell, cell + 4, k, w * 0.9e0, 0e0, 0.2e0 from g where cell < 12)
select capture, edge, "from", "to", k % 5 > 0 as shaky, 1 + w % 9 as weight, down + (k % 19 - 9) * 0.0002e0 as vx, across + (k % 17 - 8) * 0.0002e0 + case when k % 23 = 0 then 0.06e0 + k % 9 * 0.01e0 else 0e0 end as vy, (k % 13 - 6) * 0.0002e0 as vz from e"""
#: Grids with holes: edges of some cells only, none across in some captures.
HOLES = f'select capture, "from", "to", weight, vx, vy, vz from ({CAPTURES}) x where edge % 2 + "from" + floor(weight) < 14 and (edge % 2 = 1 or capture % 7 > 0)'
CELLS = 'select distinct cast(floor(o_orderkey / 16) as bigint) as capture, cast(floor(o_orderkey % 16 / 4) as bigint) as "row", o_orderkey % 4 as "column" from {orders}'
#: A run of up to 50 pixels a line, in the picture of its supplier.
RUNS = "select l_suppkey as id, l_partkey % 60 as y, l_orderkey % 80 as x0, l_orderkey % 80 + cast(l_quantity as bigint) - 3 as x1 from {lineitem}"
CAMERAS = "select s_suppkey as id, 90e0 + s_suppkey % 5 as f, 61.37e0 as cx, 29.71e0 as cy, s_suppkey % 7 * 0.19e0 - 0.61e0 as yaw from {supplier}"


def _turned(spark, sf, sql):
    rows = view(spark, sf, ticked(sql))
    # dealt, as a table of one file would leave the arithmetic to one task
    rows = once(dealt(rows, "capture"), rows.columns, F.array("vx", "vy", "vz").alias("_v"))
    return once(rows, [k for k in rows.columns if k not in ("_v", "vx", "vy", "vz")], matrices.rotation(C("_v")).alias("rotation"))


def _pruned(spark, sf):
    edges = _turned(spark, sf, CAPTURES)
    kept, trials = replay.pruned(edges, ["capture"], 1000.0)
    had = kept.select("capture", "edge", F.lit(0).cast("long").alias("place"), F.lit("kept").alias("decision"), "residual")
    return had.unionByName(trials.select("capture", "edge", "place", "decision", "residual")).withColumn("residual", F.round("residual", 4))


def _stored(spark, sf):
    """Captures whose stored correspondences are unchanged, replayed without their first edge; the hash itself is returned."""
    lines = view(spark, sf, ticked(CAPTURES)).select("capture", "from", "to", F.array(*[F.floor(C(v) * 1e6).cast("long") for v in ("vx", "vy", "vz")]).alias("points"))
    hashes = match.stored(lines, ["capture"])
    same = replay.verified(lines, hashes, ["capture"]).select("capture").distinct()
    edges = _turned(spark, sf, CAPTURES).join(same, "capture")
    out = replay.replayed(edges, ["capture"], 1000.0, edges.groupBy("capture").agg(F.min("edge").alias("edge")))
    found = out.groupBy("capture").agg(F.count_if("used").alias("used"), F.count_if("bridge").alias("bridges"), F.round(F.sum("residual"), 3).alias("residual"))
    return found.join(hashes, "capture").select("capture", "edges", "sha256", "used", "bridges", "residual")


def _steps(spark, sf):
    got = poses.robust_steps(_turned(spark, sf, HOLES).withColumn("down", C("to") - C("from") > 1), ["capture", "down"])
    return got.select("capture", "down", F.transform("vector", lambda v: F.round(F.round(v, 8) + 0.0, 8)).alias("vector"), "samples", F.round("rms", 7).alias("rms"))


def _lacking(spark, sf):
    cells = view(spark, sf, ticked(CELLS)).withColumns({"columns": F.lit(4).cast("long"), "placed": C("row") == 0})
    got = poses.synthesized(cells, _turned(spark, sf, HOLES), ["capture"], {"horizontal": 0.5, "vertical": 0.35}, {"horizontal": [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]})
    return got.select("capture", "from", "to", "axis", "source", "samples", F.round("weight", 8).alias("weight"), F.transform("rotation", lambda v: F.round(F.round(v, 6) + 0.0, 6)).alias("rotation"))


def _projected(spark, sf):
    cameras = view(spark, sf, CAMERAS).withColumn("_v", F.array(F.lit(0.0), C("yaw"), F.lit(0.0)))
    return runs.projected(view(spark, sf, RUNS), cameras.withColumn("rotation", matrices.rotation(C("_v"))).select("id", "f", "cx", "cy", "rotation"), (-1.07, 1.03, -0.31, 0.29), 211, 83)


QUERIES = {"edges_pruned": _pruned, "captures_replayed": _stored, "rotation_steps": _steps, "rotations_synthesized": _lacking, "runs_projected": _projected}
_RUNS = f"""with r as ({duck(RUNS)}), k as ({duck(CAMERAS)}), p as (select id, y, unnest(range(x0, x1 + 1)) as x from r where x0 <= x1),
d as (select id, (x - cx) / f as a, (cy - y) / f as b, yaw as t from p join k using (id)), w as (select id, cos(t) * a + sin(t) as wx, b as wy, cos(t) - sin(t) * a as wz from d),
s as (select id, atan2(wx, wz) as yaw, asin(wy / sqrt(wx * wx + wy * wy + wz * wz)) as pitch from w),
o as (select distinct id, least(floor((0.29::double - pitch) / 0.6::double * 83), 82)::bigint as y, least(floor((yaw + 1.07::double) / 2.1::double * 211), 210)::bigint as x from s where yaw between -1.07::double and 1.03::double and pitch between -0.31::double and 0.29::double),
i as (select *, x - row_number() over (partition by id, y order by x) as g from o)
select id, y, min(x) as x0, max(x) as x1 from i group by id, y, g"""


def _steps_sql(keys: str) -> str:
    """CTEs that end in f (keys, mx, my, mz, samples, rms) from v (keys, vx, vy, vz)."""
    mid = "median(vx) as mx, median(vy) as my, median(vz) as mz"
    return f"""c as (select {keys}, {mid} from v group by {keys}), r as (select v.*, sqrt((vx - mx) ** 2 + (vy - my) ** 2 + (vz - mz) ** 2) as off from v join c using ({keys})),
m as (select {keys}, median(off) as mo from r group by {keys}), a as (select {keys}, median(abs(off - mo)) as mad from r join m using ({keys}) group by {keys}),
n as (select r.* from r join m using ({keys}) join a using ({keys}) where off <= greatest(0.005::double, mo + 3 * 1.4826::double * mad)), f0 as (select {keys}, {mid}, count(*) as samples from n group by {keys}),
f1 as (select *, sqrt(mx * mx + my * my + mz * mz) as t from f0), f as (select * exclude (t), {turn(["mx", "my", "mz"])} as rot from f1)"""


_STEPS = f"""with v0 as ({duck(HOLES)}), v as (select capture, "to" - "from" > 1 as down, vx, vy, vz from v0), {_steps_sql("capture, down")},
x as (select capture, down, vx, vy, vz, sqrt(vx * vx + vy * vy + vz * vz) as t from n), y as (select *, {turn(["vx", "vy", "vz"])} as m1 from x),
z as (select y.*, [rot[1], rot[4], rot[7], rot[2], rot[5], rot[8], rot[3], rot[6], rot[9]] as back from y join f using (capture, down)), q as (select *, {times("back", "m1")} as d from z),
e as (select capture, down, sqrt(avg(atan2(sqrt((d[8] - d[6]) ** 2 + (d[3] - d[7]) ** 2 + (d[4] - d[2]) ** 2), d[1] + d[5] + d[9] - 1) ** 2)) as rms from q group by 1, 2)
select capture, down, list_transform([mx, my, mz], lambda v: round(round(v, 8) + 0.0, 8)) as vector, samples, round(rms, 7) as rms from f join e using (capture, down)"""
_LACKING = f"""with e0 as ({duck(HOLES)}), c0 as ({duck(CELLS)}), cells as (select *, "row" * 4 + "column" as tile, "row" = 0 as placed from c0),
p as (select a.capture, a.tile as f, b.tile as t, x.axis, case x.axis when 'horizontal' then a."row" else a."column" end as line, a.placed and b.placed as both from cells a, (values ('horizontal', 1), ('vertical', 4)) x(axis, step), cells b
  where b.capture = a.capture and b.tile = a.tile + x.step and (x.axis = 'vertical' or a."column" < 3)),
s as (select p.capture, axis, line, vx, vy, vz from e0 join p on p.capture = e0.capture and p.f = e0."from" and p.t = e0."to"), v as (select * from s union all select capture, axis, -1, vx, vy, vz from s), {_steps_sql("capture, axis, line")},
u as (select * from f where sqrt(mx * mx + my * my + mz * mz) > 1e-6 and sqrt(mx * mx + my * my + mz * mz) < case axis when 'horizontal' then 0.5::double else 0.35::double end), h as (select capture, median(weight) as w from e0 group by 1)
select p.capture, p.f as "from", p.t as "to", p.axis, case when u.rot is not null then 'line' when o.rot is not null then 'axis' when p.axis = 'horizontal' then 'nominal' else 'none' end as source, case when u.rot is not null then u.samples else o.samples end as samples,
  round(greatest(1e-5, least(0.01::double, coalesce(w, 1) * 0.001::double)), 8) as weight,
  list_transform(coalesce(u.rot, o.rot, case when p.axis = 'horizontal' then [1::double, 0, 0, 0, 1, 0, 0, 0, 1] end), lambda x: round(round(x, 6) + 0.0, 6)) as rotation
from p left join u on u.capture = p.capture and u.axis = p.axis and u.line = p.line left join u o on o.capture = p.capture and o.axis = p.axis and o.line = -1 left join h on h.capture = p.capture
where not p.both and not exists (select 1 from e0 where e0.capture = p.capture and e0."from" = p.f and e0."to" = p.t)"""
#: Replays are iterative; tests compare them with plain loops.
ORACLES = {"runs_projected": _RUNS, "rotation_steps": _STEPS, "rotations_synthesized": _LACKING}
