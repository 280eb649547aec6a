"""Tile queries: parts are tiles and pictures, suppliers are sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, tiles
from ..session import table
from .shared import duck, view

C = F.col
TILES = "select p_partkey as tile, (p_partkey % 63) * 0.1e0 - 3.1e0 as yaw, (p_size % 30) * 0.1e0 - 1.5e0 as pitch, 0.05e0 + p_partkey % 3 * 0.02e0 as radius from {part}"
SOURCES = "select s_suppkey as source, (s_suppkey % 61) * 0.1e0 - 3e0 as yaw, (s_suppkey % 29) * 0.1e0 - 1.4e0 as pitch, 0.3e0 as radius from {supplier}"
BANDS = "select p_partkey as tile, p_size * 7 as top, p_size * 7 + 1 + p_partkey % 90 as bottom from {part}"
COLOURS = "select l_partkey % 40 as x, l_suppkey % 30 as y, max(l_quantity) as r, max(cast(l_tax * 1000 as int)) as g, max(cast(l_discount * 900 as int)) as b from {lineitem} group by 1, 2"
CELLS = "select l_suppkey % 5 as picture, (l_partkey % 20) * 24 + l_orderkey % 24 as id, l_partkey % 20 as r, l_orderkey % 24 as c, avg(l_quantity) as luma from {lineitem} group by 1, 2, 3, 4"


def _compare(spark, sf):
    a = view(spark, sf, COLOURS)
    b = a.withColumn("g", F.when((C("x") + C("y")) % 4 == 0, C("g") + 5).otherwise(C("g"))).withColumn("r", F.when(C("x") % 7 == 0, C("r") - 2).otherwise(C("r")))
    return tiles.compare(a, b, ["r", "g", "b"]).select(F.round("mean_abs", 6).alias("mean_abs"), F.round("changed", 6).alias("changed"), F.round("max_abs", 4).alias("max_abs"))


def _light(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_partkey", (C("l_quantity") * 5).alias("r"), (C("l_tax") * 3000).alias("g"), "l_discount")
    got = tiles.linear_light(lines, ["l_partkey"], ["r", "g"], "l_discount")
    return got.select("l_partkey", *[F.round(c, 4).alias(c) for c in ("r", "g", "weight")])


def _obstructions(spark, sf):
    cells = view(spark, sf, CELLS).withColumnsRenamed({"r": "row", "c": "column"}).withColumns({"rows": F.lit(20), "columns": F.lit(24)})
    dark = cells.where((C("row") < 5) | (C("column") > 20) | (C("row") * C("column") % 9 == 4))
    pair = lambda i, j: dark.alias("a").join(dark.alias("b"), (C("a.picture") == C("b.picture")) & (C("b.row") == C("a.row") + i) & (C("b.column") == C("a.column") + j)).select((C("a.picture") * 1000 + C("a.id")).alias("a"), (C("b.picture") * 1000 + C("b.id")).alias("b"))
    named = graph.components(dark.select((C("picture") * 1000 + C("id")).alias("id")), pair(0, 1).union(pair(1, 0)))
    named = named.select(F.expr("id div 1000").alias("picture"), (C("id") % 1000).alias("id"), (C("component") % 1000).alias("component"))
    return tiles.obstructions(cells, named, "picture", contrast=-3.0)


QUERIES = {
    "tile_sources": lambda spark, sf: tiles.tile_sources(view(spark, sf, TILES), view(spark, sf, SOURCES)),
    "band_tiles": lambda spark, sf: tiles.band_tiles(spark.range(20).withColumnRenamed("id", "band"), view(spark, sf, BANDS), 32),
    "tile_blocks": lambda spark, sf: tiles.in_blocks(table(spark, sf, "part").select((C("p_partkey") % 40).alias("row"), F.expr("p_partkey div 40").alias("column"))),
    "picture_rows": lambda spark, sf: tiles.ordered_rows(view(spark, sf, COLOURS).select("x", "y", C("g").alias("v")), 8).select("y", "tile_row", F.array_join("values", ",").alias("row_values")),
    "source_ranks": lambda spark, sf: tiles.source_ranks(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity"), "l_partkey", "l_quantity", "l_suppkey").withColumn("source_rank", C("source_rank").cast("long")),
    "inference_windows": lambda spark, sf: tiles.inference_windows(table(spark, sf, "part").select("p_partkey", (C("p_size") * 40).cast("int").alias("width"), (300 + C("p_partkey") % 700).cast("int").alias("height")), "p_partkey"),
    "picture_compare": _compare,
    "linear_light_blend": _light,
    "obstructions": _obstructions,
}
_LIN = "case when {0} <= 0.04045 then {0} / 12.92 else pow(({0} + 0.055) / 1.055, 2.4) end"
_ENC = "case when {0} <= 0.0031308 then {0} * 12.92 else 1.055 * pow({0}, 1 / 2.4) - 0.055 end"
_STARTS = "case when {0} <= 512 then [0] else list_distinct(list_concat(list_filter(range(0, {0}, 256), lambda s: s + 512 < {0}), [{0} - 512])) end"
ORACLES = {
    "tile_sources": f"""with t as ({duck(TILES)}), s as ({duck(SOURCES)}) select tile, source from t join s on sin(t.pitch) * sin(s.pitch) + cos(t.pitch) * cos(s.pitch) * cos(t.yaw - s.yaw) >= cos(least(t.radius + s.radius, pi()))""",
    "band_tiles": f"with t as ({duck(BANDS)}), b as (select range as band from range(20)) select band, tile, greatest(top, band * 32) as y0, least(bottom, (band + 1) * 32) as y1 from b join t on top < (band + 1) * 32 and bottom > band * 32",
    "tile_blocks": 'select p_partkey % 40 as "row", p_partkey // 40 as "column", floor((p_partkey % 40) / 4)::bigint as block_row, floor((p_partkey // 40) / 4)::bigint as block_column from part',
    "picture_rows": f"select y, y // 8 as tile_row, string_agg(g::varchar, ',' order by x) as row_values from ({duck(COLOURS)}) group by y",
    "source_ranks": "select l_partkey, l_suppkey, l_quantity, dense_rank() over (partition by l_partkey order by l_quantity, l_suppkey) as source_rank from lineitem",
    "inference_windows": f"with p as (select p_partkey, p_size * 40 as w, 300 + p_partkey % 700 as h from part), x as (select p_partkey, h, unnest({_STARTS.format('w')})::int as x from p) select p_partkey, x, unnest({_STARTS.format('h')})::int as y from x",
    "picture_compare": f"""with a as ({duck(COLOURS)}), d as (select case when x % 7 = 0 then 2 else 0 end as dr, case when (x + y) % 4 = 0 then 5 else 0 end as dg from a)
select round(sum(dr + dg) / (count(*) * 3), 6) as mean_abs, round(count_if(dr + dg > 0) / count(*), 6) as changed, round(greatest(max(dr), max(dg)), 4)::double as max_abs from d""",
    "linear_light_blend": f"""with l as (select l_partkey, l_quantity * 5 / 255 as r, l_tax * 3000 / 255 as g, l_discount as w from lineitem where l_discount > 0), s as (select l_partkey, sum(w) as weight, sum(({_LIN.format("r")}) * w) / sum(w) as r, sum(({_LIN.format("g")}) * w) / sum(w) as g from l group by 1)
select l_partkey, round(255 * ({_ENC.format("r")}), 4) as r, round(255 * ({_ENC.format("g")}), 4) as g, round(weight, 4) as weight from s""",
    "obstructions": f"""with recursive a as ({duck(CELLS)}), d as (select * from a where r < 5 or c > 20 or r * c % 9 = 4), e as (select x.picture, x.id as f, y.id as t from d x join d y on x.picture = y.picture and abs(x.r - y.r) + abs(x.c - y.c) = 1),
k(picture, id, root) as (select picture, id, id from d union select k.picture, e.t, k.root from k join e on e.picture = k.picture and e.f = k.id), m as (select picture, id, min(root) as component from k group by 1, 2),
o as (select d.*, m.component from d join m using (picture, id)), z as (select picture, component, count(*) as cells, bool_or(r in (0, 19) or c in (0, 23)) as border, least(max(r) - min(r), max(c) - min(c)) as span, avg(luma) as mean from o group by 1, 2),
b as (select distinct o.picture, o.component, a.id, a.luma from o join a on a.picture = o.picture and abs(a.r - o.r) + abs(a.c - o.c) = 1 left join m on m.picture = a.picture and m.id = a.id where m.component is null or m.component <> o.component),
g as (select picture, component, median(luma) as edge from b group by 1, 2)
select picture, component, cells, coalesce(cells >= 24 and border and span >= 3 and edge - mean >= -3, false) as is_obstruction from z left join g using (picture, component)""",
}
