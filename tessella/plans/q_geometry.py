"""Geometry queries: orders are pixels, suppliers are cameras."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import geometry
from ..session import table
from .shared import duck, view

CONE = 0.6
PIXELS = "select o_orderkey as pixel, o_orderkey * 37 % 1009 / 1009e0 * 6e0 - 3e0 as yaw, o_custkey * 53 % 503 / 503e0 * 2e0 - 1e0 as pitch from {orders}"
CAMERAS = "select s_suppkey as camera, s_suppkey % 16 * 0.375e0 - 2.6e0 as yaw, s_nationkey * 0.05e0 - 0.6e0 as pitch, 900e0 as f, 800e0 as width, 600e0 as height from {supplier}"


def _round_trip(spark, sf):
    x, y, z = geometry.ray(F.col("yaw"), F.col("pitch"))
    yaw, pitch = geometry.angles(3 * x, 3 * y, 3 * z)
    return view(spark, sf, PIXELS).select("pixel", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"), F.round(yaw, 6).alias("yaw"), F.round(pitch, 6).alias("pitch"))


QUERIES = {
    "pixel_to_source": lambda spark, sf: geometry.footprints(view(spark, sf, PIXELS), view(spark, sf, CAMERAS), CONE, shown=[F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), F.round("edge", 6).alias("edge")]),
    "ray_round_trip": _round_trip,
    "yaw_unwrap_bounds": lambda spark, sf: geometry.unwrapped_bounds(table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 0.37 % 0.8 + F.col("l_suppkey") % 7 - math.pi).alias("yaw")), ["l_suppkey"], "yaw", F.col("l_suppkey") % 7 - 3.0).select("l_suppkey", F.round("yaw_min", 6).alias("yaw_min"), F.round("yaw_max", 6).alias("yaw_max")),
}
_P = f"p as ({duck(PIXELS)})"
_RAY = "cos(pitch) * sin(yaw) as {0}x, -sin(pitch) as {0}y, cos(pitch) * cos(yaw) as {0}z"
ORACLES = {
    "pixel_to_source": f"""with {_P}, c as ({duck(CAMERAS)}),
pr as (select pixel, {_RAY.format("p")} from p), cr as (select *, {_RAY.format("c")} from c),
s as (select pixel, camera, px * cos(yaw) - pz * sin(yaw) as x, py * cos(pitch) + (px * sin(yaw) + pz * cos(yaw)) * sin(pitch) as y, (px * sin(yaw) + pz * cos(yaw)) * cos(pitch) - py * sin(pitch) as z
  from pr join cr on px * cx + py * cy + pz * cz >= {math.cos(CONE)!r}), u as (select pixel, camera, 900 * x / z + 400 as u, 900 * y / z + 300 as v from s where z > 1e-5)
select pixel, camera, round(u, 4) as u, round(v, 4) as v, round(least(u, 800 - u) / 800 * 2 * least(v, 600 - v) / 600 * 2, 6) as edge from u where u >= 0 and v >= 0 and u < 800 and v < 600""",
    "ray_round_trip": f"""with {_P}, r as (select pixel, yaw, pitch, {_RAY.format("")} from p)
select pixel, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(atan2(x, z), 6) as yaw, round(atan2(-y, sqrt(x * x + z * z)), 6) as pitch from r""",
    "yaw_unwrap_bounds": f"""with l as (select l_suppkey, l_orderkey * 0.37::double % 0.8::double + l_suppkey % 7 - {math.pi!r}::double as yaw, l_suppkey % 7 - 3.0::double as o from lineitem),
t as (select l_suppkey, o, yaw - o + {math.pi!r}::double as a, {2 * math.pi!r}::double as w from l)
select l_suppkey, round(min(((a % w) + w) % w - {math.pi!r}::double + o), 6) as yaw_min, round(max(((a % w) + w) % w - {math.pi!r}::double + o), 6) as yaw_max from t group by l_suppkey""",
}
