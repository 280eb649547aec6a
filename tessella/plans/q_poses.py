"""Queries of forests, homographies, rotations, ownership and inverse warps: lines are edges of captures and cells of pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import homographies, matrices, poses, seams
from .q_matrices import WARPS
from .shared import duck, times, turn, view

C = F.col
#: Captures of eight orders, nine tiles each; an edge's homography is a shear, a scale and a shift.
EDGES = """select cast(floor(l_orderkey / 8) as bigint) as capture, l_orderkey * 10 + l_linenumber as edge, max(l_partkey) % 9 as a, max(l_suppkey) % 9 as b, cast(max(l_quantity) as int) as inliers, 0.3e0 + max(l_discount) as ratio, max(l_tax) * 10 as residual,
1e0 + max(l_tax) * 0.9737173e0 as p, max(l_discount) * 0.1013327e0 as s, max(l_quantity) * 1.0371713e0 as tx, 1e0 - min(l_tax) * 0.9737173e0 as q, min(l_quantity) * -0.5039173e0 as ty from {lineitem} group by l_orderkey, l_linenumber"""
#: Matches of 20 tiles and their neighbours: a planted homography, and two in five that are off by 60 to 900 pixels.
MATCHES = """select l_suppkey as edge, l_quantity * 19 + l_linenumber as sx, l_partkey % 700 * 1e0 as sy, l_orderkey % 5 < 2 as bad, 60 + l_partkey % 29 * 30 as off,
1 + l_suppkey % 7 * 0.01e0 as h0, l_suppkey % 5 * 0.004e0 as h1, l_suppkey % 90 * 1e0 as h2, l_suppkey % 3 * -0.003e0 as h3, 1 - l_suppkey % 4 * 0.01e0 as h4, l_suppkey % 40 - 20e0 as h5, l_suppkey % 6 * 0.00001e0 as h6, l_suppkey % 8 * -0.00001e0 as h7 from {lineitem}"""
#: A picture of cells for each supplier, up to seven sources a cell.
CELLS = "select l_suppkey as picture, l_partkey % 12 as y, l_orderkey % 15 as x, cast(l_linenumber as bigint) as source, min(l_extendedprice % 64) * 0.015625e0 as cost from {lineitem} group by l_suppkey, l_partkey % 12, l_orderkey % 15, l_linenumber"
#: Grids of an order's customer: a pose for each of 4 x 6 cells, off the even grid by a little.
GRIDS = 'select cast(floor(o_orderkey / 24) as bigint) as grid, cast(floor(o_orderkey % 24 / 6) as int) as "row", cast(o_orderkey % 6 as int) as "column", o_custkey % 50 * 0.004e0 as lean from {orders}'


def _spark(sql: str) -> str:
    return sql.replace('"', "`")


def _edges(spark, sf):
    e = view(spark, sf, EDGES).withColumnsRenamed({"a": "from", "b": "to", "tx": "dx", "ty": "dy"})
    zero, one = F.lit(0.0), F.lit(1.0)
    return e.withColumn("score", poses.confidence(C("inliers"), C("ratio"), C("residual"))).withColumn("h", F.array("p", "s", "dx", zero, "q", "dy", zero, zero, one))


def _forest(spark, sf):
    return poses.rooted(_edges(spark, sf), ["capture"]).where("parent is not null").select("capture", "edge", "parent", "tile")


def _transforms(spark, sf):
    return poses.propagated(_edges(spark, sf), ["capture"]).select("capture", "tile", "root", F.transform("transform", lambda v: F.round(v, 3) + 0.0).alias("transform"))


def _homographies(spark, sf):
    p = view(spark, sf, MATCHES)
    w = C("h6") * C("sx") + C("h7") * C("sy") + 1
    shift = F.when(C("bad"), C("off")).otherwise(0.0)
    p = p.select("edge", "sx", "sy", ((C("h0") * C("sx") + C("h1") * C("sy") + C("h2")) / w + shift).alias("tx"), ((C("h3") * C("sx") + C("h4") * C("sy") + C("h5")) / w - shift).alias("ty"))
    got = homographies.robust(p, ["edge"])
    return got.select("edge", "reason", "matches", "inliers", F.transform("homography", lambda v: F.round(v + 0.0, 5)).alias("homography"), (C("residual") < 1e-6).alias("exact"))


def _ownership(spark, sf):
    return seams.regularised(view(spark, sf, CELLS), ["picture"], 0.25)


def _inverse(spark, sf):
    rows = view(spark, sf, WARPS).withColumn("p", matrices.warp_inverse(C("offsets"), 3, C("width"), C("height"), C("x"), C("y")))
    return rows.select("id", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


def _centred(spark, sf):
    """A tilted grid whose central cell looks up: relative rotations stay, the centre looks ahead."""
    cells = view(spark, sf, _spark(GRIDS))
    across, down = F.array(F.lit(0.0), F.lit(0.3) + C("lean"), F.lit(0.0)), F.array(F.lit(0.2), F.lit(0.0), C("lean") * 0.1)
    turned = poses.recentred(poses.analytic(cells, ["grid"], across, down), ["grid"])
    return turned.select("grid", "row", "column", F.transform("rotation", lambda v: F.round(F.round(v, 6) + 0.0, 6)).alias("rotation"))


QUERIES = {
    "spanning_forest": _forest,
    "tile_transforms": _transforms,
    "edge_homographies": _homographies,
    "owners_smoothed": _ownership,
    "warp_inverses": _inverse,
    "poses_recentred": _centred,
}
_FOREST = f"""with recursive raw as ({duck(EDGES)}), e as (select *, inliers * ratio / (1 + greatest(residual, 0)) as score from raw where a <> b),
r(capture, edge, score, node) as (select capture, edge, score, a from e union
  select r.capture, r.edge, r.score, case when x.a = r.node then x.b else x.a end from r join e x on x.capture = r.capture and (x.score > r.score or (x.score = r.score and x.edge > r.edge)) and r.node in (x.a, x.b)),
f as (select * from e where not exists (select 1 from r where r.capture = e.capture and r.edge = e.edge and r.node = e.b)),
g(capture, tile, node) as (select distinct capture, unnest([a, b]), unnest([a, b]) from f union select g.capture, g.tile, case when f.a = g.node then f.b else f.a end from g join f on f.capture = g.capture and g.node in (f.a, f.b)),
h as (select capture, tile, min(node) as root from g group by all),
t(capture, tile, root, edge, parent, m) as (select capture, tile, root, -1::bigint, -1::bigint, [1::double, 0, 0, 0, 1, 0, 0, 0, 1] from h where tile = root union all
  select t.capture, case when f.a = t.tile then f.b else f.a end, t.root, f.edge, t.tile, {times("t.m", "(case when f.a = t.tile then [1 / p, -s / (p * q), (s * ty - q * tx) / (p * q), 0, 1 / q, -ty / q, 0, 0, 1] else [p, s, tx, 0, q, ty, 0, 0, 1] end)")}
  from t join f on f.capture = t.capture and t.tile in (f.a, f.b) and f.edge <> t.edge)"""


def _inverse_sql() -> str:
    """The eight rounds one after the other."""
    at = lambda r, q, k: f"offsets[(j + {r}) * 3 + i + {q} + 1][{k}]"
    mix = lambda k: f"({at(0, 0, k)} * (1 - u) + {at(0, 1, k)} * u) * (1 - v) + ({at(1, 0, k)} * (1 - u) + {at(1, 1, k)} * u) * v"
    cell = "least(floor(gx), 1)::int as i, least(floor(gy), 1)::int as j, gx - least(floor(gx), 1) as u, gy - least(floor(gy), 1) as v"
    ctes = [f"w as ({duck(WARPS).replace('array(', 'list_value(')})", "n0 as (select *, x as px, y as py, false as done from w)"]
    for k in range(8):
        ctes.append(f"a{k} as (select *, greatest(0, least(px, 999)) * 2 / 999 as gx, greatest(0, least(py, 799)) * 2 / 799 as gy from n{k}), b{k} as (select *, {cell} from a{k}), c{k} as (select *, x - ({mix(1)}) as qx, y - ({mix(2)}) as qy from b{k})")
        ctes.append(f"n{k + 1} as (select id, offsets, x, y, case when done then px else qx end as px, case when done then py else qy end as py, done or sqrt((qx - px) ** 2 + (qy - py) ** 2) <= 0.002::double as done from c{k})")
    ctes.append(f"z as (select *, px * 2 / 999 as gx, py * 2 / 799 as gy, px between 0 and 999 and py between 0 and 799 as seen from n8), o as (select *, {cell} from z where seen), k as (select id, sqrt((px + {mix(1)} - x) ** 2 + (py + {mix(2)} - y) ** 2) <= 0.02::double as fine from o)")
    return f"with {', '.join(ctes)} select z.id, case when fine then round(px, 4) end as x, case when fine then round(py, 4) end as y from z left join k on k.id = z.id"


_CENTRED = f"""with g as ({duck(GRIDS)}), h as (select *, "column" * (0.3::double + lean) as ay, "row" * 0.2::double as dx, "row" * lean * 0.1::double as dz from g),
k as (select *, case when ay = 0 then [1::double, 0, 0, 0, 1, 0, 0, 0, 1] else [cos(ay), 0, sin(ay), 0, 1, 0, -sin(ay), 0, cos(ay)] end as across, sqrt(dx * dx + dz * dz) as t from h),
n as (select *, case when t = 0 then [1::double, 0, 0, 0, 1, 0, 0, 0, 1] else {turn(["dx", "0", "dz"])} end as down from k), p as (select grid, "row", "column", {times("across", "down")} as m from n),
z as (select grid, max("row") // 2 as "row", max("column") // 2 as "column" from p group by grid), c as (select p.grid, [m[1], m[4], m[7], m[2], m[5], m[8], m[3], m[6], m[9]] as i from p join z on z.grid = p.grid and z."row" = p."row" and z."column" = p."column")
select p.grid, "row", "column", list_transform({times("c.i", "p.m")}, lambda v: round(round(v, 6) + 0.0, 6)) as rotation from p join c on c.grid = p.grid"""
ORACLES = {
    "spanning_forest": f"{_FOREST} select capture, edge, parent, tile from t where edge >= 0",
    "tile_transforms": f"{_FOREST} select capture, tile, root, list_transform(m, lambda v: round(v, 3) + 0.0) as transform from t",
    "edge_homographies": f"""with m as ({duck(MATCHES)}) select edge, 0 as reason, count(*)::int as matches, count_if(not bad)::int as inliers, list_transform([h0, h1, h2, h3, h4, h5, h6, h7, 1], lambda v: round(v + 0.0, 5)) as homography, true as exact
from m group by edge, h0, h1, h2, h3, h4, h5, h6, h7""",
    "warp_inverses": _inverse_sql(),
    "poses_recentred": _CENTRED,
}
