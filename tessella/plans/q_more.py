"""Queries of geometry with neighbours, grouped components, approximate neighbours and summaries of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, grid, match, matrices, records, runs
from ..session import table
from .shared import duck, view

C = F.col
RUNS = "select l_suppkey as id, cast(floor(l_suppkey / 5) as bigint) * 5 + l_partkey % 30 as y, l_orderkey % 90 as x0, l_orderkey % 90 + cast(l_quantity as int) % 9 as x1, l_discount as conf from {lineitem}"
QUALITY = "select l_orderkey, l_discount >= 0.03e0 as accepted, l_linenumber = 4 as nominal, l_tax as ratio, case when l_partkey % 7 > 0 then l_quantity end as residual from {lineitem}"
LEVELS = "select l_orderkey as manifest, l_linenumber - 2 as level, cast(l_quantity * 30 as int) as width, cast(floor(l_extendedprice) as int) % 1500 as height, l_partkey % 5 as tiles from {lineitem}"


def _neighbours(spark, sf):
    cells = grid.plan(spark, 40, 25, "row").select(C("sequence").alias("id"), "row", "column")
    edges = table(spark, sf, "lineitem").groupBy((C("l_partkey") % 1000).alias("from"), ((C("l_partkey") % 1000) + F.element_at(F.array(*map(F.lit, [1, 25, 26, 7])), (C("l_suppkey") % 4 + 1).cast("int"))).alias("to")).agg(F.max("l_returnflag").alias("disposition"), F.max("l_tax").alias("residual"))
    return geometry.neighbour_diagnostics(cells, edges)


def _rotations(spark, sf):
    """Rays of lines turned by a known rotation for each order: the fit gives it back."""
    c = C
    lines = table(spark, sf, "lineitem").select((c("l_orderkey") % 50).alias("edge"), (c("l_quantity") * 12).alias("sx"), (c("l_discount") * 5000).alias("sy"))
    turned = lines.withColumn("m", matrices.rotation(F.array(c("edge") * 0.002, 0.05 - c("edge") * 0.001, c("edge") * 0.0005)))
    ray = lambda x, y: ((x - 300) / 500, -(y - 250) / 500)
    x, y = ray(c("sx"), c("sy"))
    u, v, w = (c("m")[3 * k] * x + c("m")[3 * k + 1] * y + c("m")[3 * k + 2] for k in range(3))
    points = turned.select("edge", "sx", "sy", (300 + 500 * u / w).alias("tx"), (250 - 500 * v / w).alias("ty"))
    got = geometry.fitted_rotations(points, ["edge"], 500.0, 300.0, 250.0)
    return got.select("edge", F.transform(matrices.rotation_log(c("rotation")), lambda a: F.round(F.round(a, 6) + 0.0, 6)).alias("turn"), (c("rms") < 1e-5).alias("exact"))


def _compared(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", C("o_totalprice").alias("ms"))
    return records.compared_runs(o, o.withColumn("ms", C("ms") * 0.75), "o_orderkey", ["o_custkey"], ["ms"]).select("o_orderkey", F.round("ms", 4).alias("ms"))


def _approximate(spark, sf):
    e = table(spark, sf, "embeddings").select(C("vec_id").alias("id"), C("embedding").alias("v"))
    return match.approximate_nearest(e.where("id % 2 = 0"), e.where("id % 2 = 1"), 4.0, within=100.0)


def _stored(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", C("l_orderkey").alias("from"), C("l_linenumber").alias("to"), F.array("l_partkey", "l_linenumber").alias("points"))
    return match.stored(lines, ["l_suppkey"]).select("l_suppkey", "edges", "sha256")


QUERIES = {
    "neighbour_diagnostics": _neighbours,
    "ray_rotation_fit": _rotations,
    "component_groups": lambda spark, sf: runs.grouped_components(runs.merge(view(spark, sf, RUNS).select("id", "y", "x0", "x1"), ["id", "y"]).drop("parts")),
    "component_summary": lambda spark, sf: runs.summarised(view(spark, sf, RUNS).withColumn("id", C("y") * 1000 + C("x0")), view(spark, sf, RUNS).select((C("y") * 1000 + C("x0")).alias("id"), (C("y") % 7).alias("component")).distinct(), "conf").withColumn("confidence", F.round("confidence", 6)),
    "owners_in_tiles": lambda spark, sf: runs.owners_in_tiles(table(spark, sf, "part").select(F.expr("p_partkey div 16").alias("tile_row"), (C("p_partkey") % 6).alias("tile_column")).distinct(), view(spark, sf, RUNS).withColumnRenamed("id", "owner"), 16).drop("conf"),
    "quality_summary": lambda spark, sf: records.quality_summary(view(spark, sf, QUALITY), "l_orderkey").select("l_orderkey", "matched", "nominal", "failed", *[F.round(c, 5).alias(c) for c in ("confidence", "mean_residual", "greatest_residual")]),
    "runs_compared": _compared,
    "thumbnail_levels": lambda spark, sf: records.thumbnail_level(view(spark, sf, LEVELS), "manifest", 512),
    "files_imported": lambda spark, sf: records.imported(table(spark, sf, "pages").select((C("page_id") % 20).alias("batch"), "page_id", F.when(C("page_id") % 57 > 0, C("html")).alias("html")), "batch", "page_id", "html"),
    "scene_options": lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", records.scene_options(F.struct((C("o_orderkey") % 2 == 0).alias("protectPeople"), (C("o_orderkey") % 3 == 0).alias("smoothWater"), F.lit("m").alias("model"))).alias("options")),
    "log_order": lambda spark, sf: records.ordered_log(table(spark, sf, "events").select("user_id", F.date_trunc("day", "ts").alias("ts"), F.when(C("event_id") % 3 > 0, C("event_id") % 5).alias("sequence"), C("event_id").alias("added")), "user_id").select("added", C("place").cast("long").alias("place")),
    "edges_without": lambda spark, sf: match.without(*[table(spark, sf, "lineitem").where(f"l_linenumber % 3 {x}").select(C("l_partkey").alias("from"), C("l_suppkey").alias("to")).distinct() for x in ("= 1", "= 2")]),
    "stored_correspondences": _stored,
    "approximate_nearest": _approximate,
}
_M = f"""with m as (select id, y, x0, x1, case when x0 > 1 + max(x1) over (partition by id, y order by x0, x1 rows between unbounded preceding and 1 preceding) then 1 else 0 end as n from ({duck(RUNS)})),
g as (select *, sum(n) over (partition by id, y order by x0, x1 rows unbounded preceding) as k from m), r as (select id, y, min(x0) as x0, max(x1) as x1 from g group by id, y, k)"""
ORACLES = {
    "neighbour_diagnostics": """with e as (select l_partkey % 1000 as f, l_partkey % 1000 + [1, 25, 26, 7][l_suppkey % 4 + 1] as t, max(l_returnflag) as disposition, max(l_tax) as residual from lineitem group by 1, 2), b as (select * from e union all select t, f, disposition, residual from e)
select f as id, t as neighbour, disposition, residual from b where t < 1000 and f < 1000 and abs(f // 25 - t // 25) <= 1 and abs(f % 25 - t % 25) <= 1 and f <> t""",
    "ray_rotation_fit": "select range as edge, [round(range * 0.002::double, 6), round(0.05::double - range * 0.001::double, 6), round(range * 0.0005::double, 6)] as turn, true as exact from range(50)",
    "component_groups": _M + """, a as (select id, sum(x1 - x0 + 1) as area from r group by 1), p as (select l.id as a, q.id as b, sum(least(l.x1, q.x1) - greatest(l.x0, q.x0) + 1)::bigint as pixels from r l join r q on l.y = q.y and l.x0 <= q.x1 and q.x0 <= l.x1 and l.id < q.id group by 1, 2)
select a, b, pixels from p join a x on x.id = a join a z on z.id = b where pixels >= least(x.area, z.area, 2) and pixels * 10 >= least(x.area, z.area)""",
    "component_summary": f"select y % 7 as component, sum(x1 - x0 + 1)::bigint as area, min(x0) as x0, max(x1) as x1, min(y) as y0, max(y) as y1, round(sum(conf * (x1 - x0 + 1)) / sum(x1 - x0 + 1), 6) as confidence from ({duck(RUNS)}) group by 1",
    "owners_in_tiles": f"""with t as (select distinct p_partkey // 16 as tile_row, p_partkey % 6 as tile_column from part) select tile_row, tile_column, id as owner, y, greatest(x0, tile_column * 16 - 3) as x0, least(x1, tile_column * 16 + 18) as x1
from t join ({duck(RUNS)}) r on y + 3 >= tile_row * 16 and y - 3 < (tile_row + 1) * 16 and x1 + 3 >= tile_column * 16 and x0 - 3 < (tile_column + 1) * 16""",
    "quality_summary": f"""with q as ({duck(QUALITY)}), m as (select *, case when accepted and not nominal then residual end as v from q) select l_orderkey, count_if(accepted and not nominal)::bigint as matched, count_if(nominal)::bigint as nominal, count_if(not accepted and not nominal)::bigint as failed,
  round(coalesce(avg(case when accepted then ratio end), 0), 5) as confidence, round(coalesce(avg(v), 0), 5) as mean_residual, round(coalesce(max(v), 0), 5) as greatest_residual from m group by 1""",
    "runs_compared": "select o_orderkey, 0.75::double as ms from orders",
    "thumbnail_levels": f"""with l as (select *, greatest(width, height) as s from ({duck(LEVELS)}) where level >= 0 and width > 0 and height > 0 and tiles > 0)
select manifest, coalesce(first(level order by s, level) filter (where s >= 512), first(level order by s desc, level)) as level from l group by 1""",
    "files_imported": """with p as (select page_id % 20 as batch, page_id, html, bool_and(page_id % 57 > 0) over (partition by page_id % 20) as w from pages)
select batch, lpad((row_number() over (partition by batch order by page_id))::varchar, 6, '0') || '.jpg' as name, sha256(html) as sha256 from p where w""",
    "scene_options": "select o_orderkey, case o_orderkey % 6 when 0 then 'people+water+m' when 2 then 'people+m' when 4 then 'people+m' when 3 then 'water+m' else '' end as options from orders",
    "log_order": "select event_id as added, row_number() over (partition by user_id order by date_trunc('day', ts), case when event_id % 3 > 0 then event_id % 5 end nulls last, event_id) as place from events",
    "edges_without": """select distinct l_partkey as "from", l_suppkey as "to" from lineitem where l_linenumber % 3 = 1 and (l_partkey, l_suppkey) not in (select (l_partkey, l_suppkey) from lineitem where l_linenumber % 3 = 2)""",
    "stored_correspondences": """with e as (select l_suppkey, l_orderkey as f, l_linenumber as t, sha256('{"from":' || l_orderkey || ',"to":' || l_linenumber || ',"points":[' || l_partkey || ',' || l_linenumber || ']}') as h from lineitem)
select l_suppkey, count(*) as edges, sha256(string_agg(h, '' order by f, t, h)) as sha256 from e group by 1""",
}
