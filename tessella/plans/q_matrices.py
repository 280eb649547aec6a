"""Matrix, sampling and warp queries: lines give entries, angles and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blend, matrices
from .shared import duck, view

ENTRIES = """select l_orderkey * 10 + l_linenumber as id, array(1e0 + l_tax, l_discount, l_quantity * 0.01e0, l_discount * -1, 1e0 - l_tax, 0.3e0, l_tax * 0.5e0, l_discount * 0.5e0, 1e0) as a,
array(l_quantity * 0.1e0, 1e0, l_tax, 2e0, l_discount, 0.5e0, l_tax, 1e0, 3e0) as b, array(l_tax, l_discount - 0.05e0, l_quantity * 0.02e0 - 0.5e0) as r, l_quantity * 10.0317e0 as x, l_tax * 1000.0731e0 as y from {lineitem} where l_linenumber <= 2"""
POINTS = "select l_orderkey * 10 + l_linenumber as id, (l_partkey % 70) + l_discount * 5 as x, (l_suppkey % 46) + l_tax * 10 as y from {lineitem} where l_linenumber <= 2"
WARPS = """select o_orderkey as id, 1000 as width, 800 as height, array(array(0e0, 0e0), array(o_custkey % 7 * 1e0, 2e0), array(0e0, o_orderkey % 90 * 1e0), array(1e0, 1e0), array(3e0, o_custkey % 60 * 1e0), array(2e0, 0e0), array(0e0, 1e0), array(1e0, 2e0), array(o_orderkey % 40 * 1e0, 0e0)) as offsets,
o_orderkey % 1000 * 1e0 as x, o_custkey % 800 * 1e0 as y from {orders}"""
C, SIDE = F.col, 64


def _rounded(cols):
    return F.transform(cols, lambda v: F.round(v, 6))


def _algebra(spark, sf):
    a, b = C("a"), C("b")
    rows = view(spark, sf, ENTRIES).withColumn("i", matrices.inverse(a))
    return rows.select("id", _rounded(matrices.product(a, b)).alias("ab"), _rounded(matrices.transpose(b)).alias("bt"), F.round(matrices.determinant(b), 6).alias("det"), _rounded(matrices.product(a, C("i"))).alias("unit"))


def _rotations(spark, sf):
    rows = view(spark, sf, ENTRIES).withColumn("m", matrices.rotation(C("r"))).withColumn("t", matrices.transpose(C("m")))
    unit = F.transform(matrices.product(C("m"), C("t")), lambda v: F.round(F.abs(v), 6))
    return rows.select("id", _rounded(matrices.rotation_log(C("m"))).alias("r"), unit.alias("unit"))


def _transforms(spark, sf):
    h = C("a")
    x, y = matrices.applied(h, C("x"), C("y"))
    return view(spark, sf, ENTRIES).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(matrices.normalized(C("b"))[0], 6).alias("first"), matrices.is_safe(h, F.lit(100.0), F.lit(80.0)).alias("safe"))


def _bilinear(spark, sf):
    got = matrices.bilinear(view(spark, sf, POINTS), blend.raster(spark, SIDE, 45))
    return got.select("id", F.round("v", 4).alias("v"))


def _projections(spark, sf):
    out = view(spark, sf, POINTS)
    cols = []
    for kind in ("cylindrical", "spherical"):
        u, v = matrices.source_place(kind, C("x"), C("y"), 40.0, 32.0, 22.0)
        cols += [F.round(u, 4).alias(f"{kind}_u"), F.round(v, 4).alias(f"{kind}_v")]
    u, v = matrices.undistorted(C("x") / 70, C("y") / 46, 0.1, -0.02, 0.001, 0.002)
    return out.select("id", *cols, F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


def _warps(spark, sf):
    rows = view(spark, sf, WARPS)
    dx, dy = matrices.warp_offset(C("offsets"), 3, C("width"), C("height"), C("x"), C("y"))
    return rows.select("id", F.round(dx, 4).alias("dx"), F.round(dy, 4).alias("dy")).join(matrices.warp_is_valid(rows, "id", 3), "id")


QUERIES = {
    "matrix_algebra": _algebra,
    "rotation_round_trip": _rotations,
    "projective_points": _transforms,
    "bilinear_samples": _bilinear,
    "projection_maps": _projections,
    "source_plane_warps": _warps,
}


def _entries(sql: str) -> str:
    return duck(sql).replace("array(", "list_value(")


def _product(a: str, b: str) -> str:
    return "[" + ", ".join("round(" + " + ".join(f"{a}[{3 * r + k + 1}] * {b}[{3 * k + c + 1}]" for k in range(3)) + ", 6)" for r in range(3) for c in range(3)) + "]"


_DET = "({0}[1] * ({0}[5] * {0}[9] - {0}[6] * {0}[8]) - {0}[2] * ({0}[4] * {0}[9] - {0}[6] * {0}[7]) + {0}[3] * ({0}[4] * {0}[8] - {0}[5] * {0}[7]))"
_UNIT = "[1::double, 0, 0, 0, 1, 0, 0, 0, 1]"
_W = "(a[7] * {x} + a[8] * {y} + a[9])"
_CORNERS = [(0, 0), (100, 0), (100, 80), (0, 80)]
_PX = [f"(a[1] * {x} + a[2] * {y} + a[3]) / {_W.format(x=x, y=y)}" for x, y in _CORNERS]
_PY = [f"(a[4] * {x} + a[5] * {y} + a[6]) / {_W.format(x=x, y=y)}" for x, y in _CORNERS]
_AREA = " + ".join(f"({_PX[k]}) * ({_PY[(k + 1) % 4]}) - ({_PX[(k + 1) % 4]}) * ({_PY[k]})" for k in range(4))


def _strain() -> str:
    out = []
    for i, j in ((0, 0), (1, 0), (0, 1), (1, 1)):
        at = lambda r, q, k, i=i, j=j: f"offsets[{(j + r) * 3 + i + q + 1}][{k}]"
        for u, v in ((0, 0), (1, 0), (0, 1), (1, 1)):
            a, b = (f"(({at(v, 1, k)} - {at(v, 0, k)}) / (999 / 2))" for k in (1, 2))
            d, e = (f"(({at(1, u, k)} - {at(0, u, k)}) / (799 / 2))" for k in (1, 2))
            t = f"({a} * {a} + {b} * {b} + {d} * {d} + {e} * {e})"
            out.append(f"sqrt(({t} + sqrt(greatest({t} * {t} - 4 * ({a} * {e} - {b} * {d}) * ({a} * {e} - {b} * {d}), 0))) / 2)")
    return f"greatest({', '.join(out)})"


_AT = "offsets[(j + {r}) * 3 + i + {c} + 1][{k}]"
_MIX = lambda k: f"({_AT.format(r=0, c=0, k=k)} * (1 - u) + {_AT.format(r=0, c=1, k=k)} * u) * (1 - v) + ({_AT.format(r=1, c=0, k=k)} * (1 - u) + {_AT.format(r=1, c=1, k=k)} * u) * v"
_R = f"r as (select range % {SIDE} as x, range // {SIDE} as y, ((range % {SIDE}) * 17 + (range // {SIDE}) * 11 + xor((range % {SIDE}) // 8, (range // {SIDE}) // 8) * 29) & 255 as v from range({SIDE * 45}))"
ORACLES = {
    "matrix_algebra": f"""select id, {_product("a", "b")} as ab, [{", ".join(f"round(b[{3 * c + r + 1}], 6)" for r in range(3) for c in range(3))}] as bt, round({_DET.format("b")}, 6) as det, case when abs({_DET.format("a")}) > 1e-12 then {_UNIT} end as unit from ({_entries(ENTRIES)})""",
    "rotation_round_trip": f"select id, list_transform(r, lambda v: round(v, 6)) as r, {_UNIT} as unit from ({_entries(ENTRIES)})",
    "projective_points": f"""select id, round((a[1] * x + a[2] * y + a[3]) / (a[7] * x + a[8] * y + a[9]), 3) as x, round((a[4] * x + a[5] * y + a[6]) / (a[7] * x + a[8] * y + a[9]), 3) as y, round(b[1] / b[9], 6) as first,
  abs({_DET.format("a")}) > 1e-12 and abs({_AREA}) / 2 > 1e-6 and sqrt(abs({_AREA}) / 2 / 8000) between 0.1 and 10 as safe from ({_entries(ENTRIES)})""",
    "bilinear_samples": f"""with {_R}, p as ({duck(POINTS)}), t as (select id, floor(x)::bigint + i as tx, floor(y)::bigint + j as ty, (case when i = 1 then x - floor(x) else 1 - (x - floor(x)) end) * (case when j = 1 then y - floor(y) else 1 - (y - floor(y)) end) as w from p, (values (0), (1)) a(i), (values (0), (1)) b(j))
select id, case when count(v) = count(*) then round(sum(v * w), 4) end as v from t left join r on r.x = tx and r.y = ty where w > 0 group by id""",
    "projection_maps": f"""with p as (select *, (x - 32) / 40 as a, (y - 22) / 40 as b, x / 70 as s, y / 46 as t from ({duck(POINTS)})), q as (select *, s * s + t * t as r from p)
select id, round(32 + 40 * tan(a), 4) as cylindrical_u, round(22 + 40 * b / cos(a), 4) as cylindrical_v, round(32 + 40 * tan(a), 4) as spherical_u, round(22 + 40 * tan(b) / cos(a), 4) as spherical_v,
  round(s * (1 + 0.1::double * r - 0.02::double * r * r) + 2 * 0.001::double * s * t + 0.002::double * (r + 2 * s * s), 6) as u, round(t * (1 + 0.1::double * r - 0.02::double * r * r) + 0.001::double * (r + 2 * t * t) + 2 * 0.002::double * s * t, 6) as v from q""",
    "source_plane_warps": f"""with w as ({_entries(WARPS)}), g as (select *, least(floor(x * 2 / 999), 1)::int as i, least(floor(y * 2 / 799), 1)::int as j, x * 2 / 999 - least(floor(x * 2 / 999), 1) as u, y * 2 / 799 - least(floor(y * 2 / 799), 1) as v from w)
select id, round({_MIX(1)}, 4) as dx, round({_MIX(2)}, 4) as dy, len(list_filter(offsets, lambda o: sqrt(o[1] * o[1] + o[2] * o[2]) > 64)) = 0 and {_strain()} <= 0.10 + 1e-9 as valid from g""",
}
