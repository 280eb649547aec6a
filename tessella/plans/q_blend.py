"""Blending queries: a part is a pixel, its lines are the samples of suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import blend
from ..session import dealt_by_size, table
from .shared import PIXELS, duck, view

SIDE = 64
VIEWS = """select o_orderkey as view, 1 + o_custkey % 1200 as need_w, 1 + o_orderkey % 900 as need_h, o_custkey % 900 as x0, o_custkey % 900 + o_orderkey % 300 - 10 as x1, o_orderkey % 700 as y0, o_orderkey % 700 + o_custkey % 9 * 70 as y1 from {orders}"""


def _samples(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source"), "l_quantity", "l_discount", "l_extendedprice")


def _two_of_four(spark, sf):
    four = blend.top(_samples(spark, sf), ["l_partkey"], [F.desc("l_quantity"), F.asc("source")], 4).drop("rank")
    adjusted = four.withColumn("adjusted", F.round(F.col("l_quantity") * (1 - F.col("l_discount") * 5), 6))
    return blend.top(adjusted, ["l_partkey"], [F.desc("adjusted"), F.asc("source")], 2).select("l_partkey", "source", "adjusted", "rank")


def _peers(spark, sf):
    lines = dealt_by_size(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_discount", "l_quantity", "l_tax", "l_linenumber"), "l_partkey")
    lines = lines.groupBy("l_partkey", "l_suppkey").agg(*[F.max(c).alias(c) for c in ("l_discount", "l_quantity", "l_tax")], F.max(F.col("l_linenumber") / 7).alias("support"))
    got = blend.best_other(lines, ["l_partkey"], "l_suppkey", "l_discount", "l_quantity", "l_tax", support="support", own=True)
    strength = blend.suppression(F.col("peer_l_quantity"), F.col("l_tax") * 12, F.col("l_quantity") / 5, F.col("l_tax") * 200, F.col("peer_l_tax") * 400)
    score = blend.adjusted(F.col("l_discount"), F.col("peer"), F.coalesce(strength, F.lit(0.0)), F.lit(641.0))
    return got.select("l_partkey", "l_suppkey", F.round("peer_l_quantity", 6).alias("peer_quantity"), F.round(score, 6).alias("score"))


def _levels(spark):
    return spark.range(11).select(F.col("id").alias("level"), F.expr("shiftright(1024, cast(id as int))").alias("w"), F.expr("greatest(shiftright(768, cast(id as int)), 1)").alias("h"))


def _raster(spark, sf):
    return view(spark, sf, PIXELS).select("x", "y", "v")


def _pyramid(spark, sf):
    pixels = _raster(spark, sf)
    return blend.pyramid(pixels, SIDE, pixels.agg(F.max("y")).first()[0] + 1).select("level", "x", "y", F.round("v", 4).alias("v"))


def _compared(spark, sf):
    """Two pictures of one size: the values and those with some changed."""
    pixels = view(spark, sf, PIXELS)
    other = pixels.select("x", "y", F.when(F.col("a") % 5 == 0, (F.col("v") + 9).bitwiseAND(255)).otherwise(F.col("v")).alias("u"))
    d = pixels.join(other, ["x", "y"]).select(F.abs(F.col("v") - F.col("u")).alias("d"))
    return d.agg(F.round(F.avg("d"), 6).alias("mean_abs"), F.round(F.count_if(F.col("d") > 0) / F.count("*"), 6).alias("changed"), F.max("d").alias("max_abs"))


def _light(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 256).alias("c"))
    return c.select("id", F.round(blend.linear(F.col("c") / 255.0), 8).alias("linear"), F.round(255 * blend.encoded(blend.linear(F.col("c") / 255.0)), 6).alias("back"), F.round(blend.smoothstep(40.0, 200.0, F.col("c")), 8).alias("step"))


QUERIES = {
    "weighted_blend": lambda spark, sf: blend.weighted(_samples(spark, sf), ["l_partkey"], "l_extendedprice", "l_discount").select("l_partkey", F.round("blended", 4).alias("blended"), "samples", F.round("covered", 6).alias("covered")),
    "softmax_blend": lambda spark, sf: blend.softmax(_samples(spark, sf), ["l_partkey"], "l_extendedprice", "l_discount", 40.0).select("l_partkey", F.round("blended", 4).alias("blended")),
    "top2_owner": lambda spark, sf: blend.top(_samples(spark, sf), ["l_partkey"], [F.desc("l_discount"), F.asc("source")], 2).select("l_partkey", "source", "l_discount", "rank"),
    "best_other_peer": lambda spark, sf: blend.best_other(dealt_by_size(_samples(spark, sf).select("l_partkey", "source", "l_discount"), "l_partkey"), ["l_partkey"], "source", "l_discount"),
    "peer_evidence": _peers,
    "top4_then_top2": _two_of_four,
    "pyramid_level1": lambda spark, sf: blend.halve(_raster(spark, sf)).select("x", "y", F.round("v", 4).alias("v")),
    "pyramid_all": _pyramid,
    "pyramid_premultiplied": lambda spark, sf: blend.halve_premultiplied(view(spark, sf, PIXELS)).select("x", "y", F.round("v", 4).alias("v"), F.round("a", 4).alias("a")),
    "lod_choice": lambda spark, sf: blend.level_of_detail(_levels(spark), view(spark, sf, VIEWS)),
    "visible_tiles": lambda spark, sf: blend.visible_tiles(view(spark, sf, VIEWS), 64),
    "srgb_round_trip": _light,
    "pixel_compare": _compared,
}

_S = "s as (select l_partkey, l_orderkey * 10 + l_linenumber as source, l_quantity, l_discount, l_extendedprice from lineitem)"
_R = f"r as ({duck(PIXELS)})"
_V = f"views as ({duck(VIEWS)})"


def _levels_sql() -> str:
    ctes, prior, unions = [_R, "l0 as (select x, y, v::double as v from r)"], "l0", ["select 0 as level, * from l0"]
    for k in range(1, 15):
        ctes.append(f"l{k} as (select x // 2 as x, y // 2 as y, avg(v) as v from {prior} group by 1, 2)")
        prior = f"l{k}"
        unions.append(f"select {k} as level, * from l{k}")
    return f"with {', '.join(ctes)} select level, x, y, round(v, 4) as v from ({' union all '.join(unions)}) where level <= (select ceil(log2(greatest({SIDE}, max(y) + 1))) from l0)"


def _STEP(v, low, high):
    t = f"greatest(0::double, least(1::double, ({v} - {low}::double) / ({high}::double - {low}::double)))"
    return f"({t} * {t} * (3 - 2 * {t}))"


_LIN = "case when {0} <= 0.04045 then {0} / 12.92 else pow(({0} + 0.055) / 1.055, 2.4) end"
_ENC = "case when {0} <= 0.0031308 then {0} * 12.92 else 1.055 * pow({0}, 1 / 2.4) - 0.055 end"
ORACLES = {
    "weighted_blend": f"with {_S} select l_partkey, round(sum(case when l_discount > 0 then l_extendedprice * l_discount end) / sum(case when l_discount > 0 then l_discount end), 4) as blended, count_if(l_discount > 0)::bigint as samples, round(count_if(l_discount > 0) / count(*), 6) as covered from s group by all",
    "softmax_blend": f"with {_S}, w as (select *, exp(greatest(-80, least(0, 40.0 * (l_discount - max(l_discount) over (partition by l_partkey))))) as w from s) select l_partkey, round(sum(l_extendedprice * w) / sum(w), 4) as blended from w group by all",
    "top2_owner": f"with {_S} select l_partkey, source, l_discount, row_number() over (partition by l_partkey order by l_discount desc, source)::int as rank from s qualify rank <= 2",
    "best_other_peer": f"with {_S} select a.l_partkey, a.source, max(a.l_discount) as l_discount, max(b.l_discount) as peer from s a left join s b on a.l_partkey = b.l_partkey and a.source <> b.source group by 1, 2",
    "peer_evidence": f"""with l as (select l_partkey, l_suppkey, max(l_discount) as d, max(l_quantity) as q, max(l_tax) as t, max(l_linenumber / 7) as u from lineitem group by 1, 2),
r as (select *, row_number() over (partition by l_partkey order by d desc, l_suppkey) as k from l), p as (select a.*, b.d as pd, b.q * b.u as pq, b.t * b.u * 400 as pt from r a left join r b on b.l_partkey = a.l_partkey and b.k = case when a.k = 1 then 2 else 1 end),
s as (select *, least(greatest(case when pt > 0 then {_STEP('pq', 10, 14)} * {_STEP('pt', 15, 21)} * (1 - {_STEP('t * 200 / pt', 0.55, 0.85)}) else 0 end, {_STEP('t * 12', 0.5, 0.8)} * (1 - {_STEP('q / 5', 3.3, 7.7)}) * {_STEP('pq', 6, 10)}), 1) as g from p)
select l_partkey, l_suppkey, round(pq, 6) as peer_quantity, round(case when pd is null or coalesce(g, 0) <= 0 then d else d - g * greatest(d - pd + 32 / 641, 0) end, 6) as score from s""",
    "top4_then_top2": f"with {_S}, four as (select *, row_number() over (partition by l_partkey order by l_quantity desc, source) as r4 from s qualify r4 <= 4), a as (select l_partkey, source, round(l_quantity * (1 - l_discount * 5), 6) as adjusted from four) select *, row_number() over (partition by l_partkey order by adjusted desc, source)::int as rank from a qualify rank <= 2",
    "pyramid_level1": f"with {_R} select x // 2 as x, y // 2 as y, round(avg(v), 4) as v from r group by 1, 2",
    "pyramid_all": _levels_sql(),
    "pyramid_premultiplied": f"""with {_R}, p as (select x, y, v / 255.0::double as c, a from r),
g as (select x // 2 as x, y // 2 as y, sum(a / 255.0::double * ({_LIN.format('c')})) as va, sum(a / 255.0::double) as sa, avg(a) as a from p group by 1, 2),
h as (select x, y, a, case when sa > 0 then va / sa else 0 end as m from g) select x, y, round(255 * ({_ENC.format('m')}), 4) as v, round(a, 4) as a from h""",
    "lod_choice": f"""with levels as (select range as level, 1024 >> range::int as w, greatest(768 >> range::int, 1) as h from range(11)), {_V}
select view, coalesce(arg_min(level, w * h) filter (where w >= need_w and h >= need_h), arg_max(level, w * h)) as level from views, levels group by view""",
    "visible_tiles": f"""with {_V}, t as (select range as tile_row from range(40)), c as (select range as tile_column from range(40))
select view, tile_row, tile_column from views, t, c where x1 > x0 and y1 > y0 and tile_column * 64 < x1 and (tile_column + 1) * 64 > x0 and tile_row * 64 < y1 and (tile_row + 1) * 64 > y0""",
    "srgb_round_trip": f"""with c as (select c_custkey as id, c_custkey % 256 / 255.0::double as c, greatest(0.0, least(1.0, (c_custkey % 256 - 40.0::double) / 160.0::double)) as t from customer), l as (select id, t, {_LIN.format('c')} as lin from c)
select id, round(lin, 8) as linear, round(255 * ({_ENC.format('lin')}), 6) as back, round(t * t * (3 - 2 * t), 8) as step from l""",
    "pixel_compare": f"with {_R}, d as (select abs(v - case when a % 5 = 0 then (v + 9) & 255 else v end) as d from r) select round(avg(d), 6) as mean_abs, round(count_if(d > 0) / count(*), 6) as changed, max(d) as max_abs from d",
}
