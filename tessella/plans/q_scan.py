"""Scan plan and estimate queries: an order is a request."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scan
from .shared import duck, view

# every kind of refusal occurs
REQUESTS = """select o_orderkey as request, (o_orderkey % 7 - 3) * 0.1e0 as pan, (o_custkey % 5 - 2) * 0.1e0 as tilt, case when o_orderkey % 41 = 0 then 0e0 else 1e0 end as zoom,
60e0 as fov_x, 40e0 as fov_y, 180e0 as mech_pan, 90e0 as mech_tilt, 10e0 + o_custkey % 4 as target_x, 8e0 + o_orderkey % 3 as target_y, 180e0 as target_mech_pan,
case when o_orderkey % 43 = 0 then 80e0 else 90e0 end as target_mech_tilt, 0.1e0 as roi_left, 0.2e0 as roi_top, case when o_orderkey % 47 = 0 then 0.1e0 else 0.3e0 + o_custkey % 3 * 0.2e0 end as roi_right, 0.6e0 as roi_bottom,
case when o_orderkey % 53 = 0 then 1e0 else 0.25e0 end as overlap_x, 0.25e0 as overlap_y, case when o_orderkey % 4 = 0 then cast(o_custkey % 6 as bigint) end as grid_rows, case when o_orderkey % 4 = 0 then cast(5 as bigint) end as grid_columns,
case o_orderkey % 3 when 0 then 'snake' when 1 then 'row' else 'column' end as traversal, cast(1000 as bigint) as bytes_per_tile, cast(12 + o_orderkey % 2 * 12 as bigint) as maximum_tiles from {orders}"""
SIZES = """select o_orderkey, 1 + o_custkey % 30 as nrows, o_orderkey % 40 as ncolumns, (o_custkey % 200) * 1e0 as fov, 4000 as w, 3000 as h, (o_orderkey % 11) * 0.1e0 as ox, 0.3e0 as oy from {orders}"""
MEMORY = "select o_orderkey, o_orderkey * 7 % 200000 as total, o_orderkey * 5 % 210000 as available, o_custkey % 12 as jobs, o_orderkey % 2 = 0 as mobile from {orders}"


def _sizes(spark, sf):
    c = F.col
    wide, high = scan.output_size(c("nrows"), c("ncolumns"), c("fov"), c("w"), c("h"), c("ox"), c("oy"))
    return view(spark, sf, SIZES).select("o_orderkey", wide.alias("width"), high.alias("height"))


def _memory(spark, sf):
    c = F.col
    return view(spark, sf, MEMORY).select("o_orderkey", scan.job_budget(c("total"), c("jobs")).alias("each"), scan.safe_memory(c("total"), c("available"), c("mobile")).alias("safe"))


QUERIES = {
    "scan_plan": lambda spark, sf: scan.plan(view(spark, sf, REQUESTS), "request").select("request", "sequence", "row", "column", F.round("pan", 6).alias("pan"), F.round("tilt", 6).alias("tilt")),
    "scan_refusals": lambda spark, sf: scan.sized(view(spark, sf, REQUESTS)).where("error is not null").select("request", "error"),
    "output_size": _sizes,
    "memory_budget": _memory,
}
_S = f"""r as ({duck(REQUESTS)}), s as (select *, target_x * (1 - overlap_x) as sx, target_y * (1 - overlap_y) as sy,
  case when not (roi_right > roi_left) then 'roi' when target_mech_tilt <> mech_tilt then 'mechanical' when zoom <= 0 then 'pose' when overlap_x >= 1 then 'overlap' when grid_rows <= 0 then 'grid' end as e0 from r),
n as (select *, case when e0 is null then ceil(greatest((roi_bottom - roi_top) * fov_y - target_y, 0) / sy)::bigint + 1 end as nr, case when e0 is null then ceil(greatest((roi_right - roi_left) * fov_x - target_x, 0) / sx)::bigint + 1 end as nc from s),
m as (select *, coalesce(grid_rows, nr) as rs, coalesce(grid_columns, nc) as cs from n),
p as (select *, pan + ((roi_left + roi_right) / 2 - 0.5) * fov_x * 2 / mech_pan as mp, tilt - ((roi_top + roi_bottom) / 2 - 0.5) * fov_y * 2 / mech_tilt as mt, sx * 2 / target_mech_pan as nx, sy * 2 / target_mech_tilt as ny,
  coalesce(e0, case when rs < nr or cs < nc then 'grid-too-small' when rs * cs > maximum_tiles then 'resource-limit' end) as e1 from m),
z as (select *, coalesce(e1, case when abs(mp) + (cs - 1) / 2 * nx > 1 or abs(mt) + (rs - 1) / 2 * ny > 1 then 'mechanical-range' end) as error from p)"""
ORACLES = {
    "scan_plan": f"""with {_S}, t as (select *, unnest(range(rs * cs)) as sequence from z where error is null),
u as (select *, case when traversal = 'column' then sequence % rs else sequence // cs end as row, case when traversal = 'column' then sequence // rs when traversal = 'snake' and (sequence // cs) % 2 = 1 then cs - 1 - sequence % cs else sequence % cs end as col from t)
select request, sequence, row, col as "column", round(mp + (col - (cs - 1) / 2) * nx, 6) as pan, round(mt + ((rs - 1) / 2 - row) * ny, 6) as tilt from u""",
    "scan_refusals": f"with {_S} select request, error from z where error is not null",
    "output_size": f"""with s as ({duck(SIZES)}), a as (select *, radians(fov) as f from s), b as (select *, 2 * atan(tan(f / 2) * h / w) as vf, w / (2 * tan(f / 2)) as p, ncolumns >= 1 and fov > 1 and fov < 179 and ox < 1 as ok from a)
select o_orderkey, case when ok then ceil(w + (ncolumns - 1) * p * f * (1 - ox))::bigint end as width, case when ok then ceil(h + (nrows - 1) * p * vf * (1 - oy))::bigint end as height from b""",
    "memory_budget": f"""with m as ({duck(MEMORY)}), s as (select *, greatest(least(jobs, greatest(least(total // 128, 8), 1)), 1) as slots, total > 0 and available > 0 and available <= total as valid from m)
select o_orderkey, greatest(least(total // slots, 131072), 128)::bigint as each, case when valid then greatest(least(floor(case when mobile then available / 3 else available * 3 / 4 end), 131072), 128) when mobile then 128 else 512 end::bigint as safe from s""",
}
