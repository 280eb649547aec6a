"""Run and interval queries: lines mark pixels, orders are boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, runs
from ..session import dealt, table
from .shared import duck, view

#: Marked pixels of two pictures, a row for each supplier.
MASK = "select distinct l_partkey % 1499 as x, l_suppkey as y from {{lineitem}} where l_returnflag = '{flag}'"
#: A person for each order: lines of a silhouette, at one of the places of its customer's block, in one of seven sources.
SILHOUETTES = """select l_orderkey as id, l_orderkey % 50 * 16 + l_linenumber as y, cast(floor(l_orderkey / 200) as bigint) % 40 * 30 + l_orderkey % 3 as x0,
cast(floor(l_orderkey / 200) as bigint) % 40 * 30 + l_orderkey % 3 + cast(l_quantity as int) % 12 as x1 from {lineitem}"""
PEOPLE = """select o_orderkey as id, o_custkey % 7 as source, 'p' || o_custkey % 7 as path, o_orderkey % 4 = 0 as truncated, o_custkey % 5 * 0.2e0 as coverage, o_orderkey % 11 * 0.05e0 as confidence, o_totalprice as sharpness from {orders}"""
BOXES = """select o_orderkey as id, o_orderkey * 37 % 20000 as x0, o_orderkey * 37 % 20000 + o_custkey % 40 + 1 as x1, o_custkey * 53 % 4000 as y0, o_custkey * 53 % 4000 + o_orderkey * 7 % 30 as y1 from {orders}"""


def _runs(spark, sf, flag="R"):
    return runs.run_length(view(spark, sf, MASK.format(flag=flag)), ["y"], "x")


def _sources(spark, sf, flag):
    return _runs(spark, sf, flag).select(F.expr("y div 6").alias("id"), "y", "x0", "x1")


def _labelled(spark, sf):
    own = _runs(spark, sf).select((F.col("y") * 10000 + F.col("x0")).alias("id"), "y", "x0", "x1")
    named = graph.components(own.select("id"), runs.run_links(own))
    size = F.col("x1") - F.col("x0") + 1
    return own.join(named, "id").groupBy("component").agg(F.sum(size).alias("area"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))


def _people(spark, sf):
    components, own = view(spark, sf, PEOPLE), runs.merge(dealt(view(spark, sf, SILHOUETTES), "id"), ["id", "y"]).drop("parts")
    return runs.person_groups(components, own, 1200, 800)[0]


QUERIES = {
    "person_groups": _people,
    "rle_runs": _runs,
    "interval_merge": lambda spark, sf: runs.merge(table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 97 % 5000).alias("x0"), (F.col("l_orderkey") * 97 % 5000 + F.col("l_quantity").cast("long")).alias("x1")), ["l_suppkey"]),
    "box_overlap_pairs": lambda spark, sf: runs.overlapping_boxes(view(spark, sf, BOXES)),
    "interval_overlap_pairs": lambda spark, sf: runs.shared_pixels(_sources(spark, sf, "R"), _sources(spark, sf, "A")),
    "component_boxes": _labelled,
}


def _mask_sql(name, flag="R"):
    return f"""{name}_m as ({duck(MASK.format(flag=flag))}),
{name} as (select y, min(x) as x0, max(x) as x1 from (select *, x - row_number() over (partition by y order by x) as i from {name}_m) group by y, i)"""


_PEOPLE = f"""with recursive c as ({duck(PEOPLE)}), l as ({duck(SILHOUETTES)}),
n as (select *, case when x0 > 1 + max(x1) over (partition by id, y order by x0, x1 rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from l),
k as (select *, sum(new) over (partition by id, y order by x0, x1 rows unbounded preceding) as g from n), r as (select id, y, min(x0) as x0, max(x1) as x1 from k group by id, y, g),
a as (select id, sum(x1 - x0 + 1) as area from r group by id),
p as (select u.id as a, v.id as b, sum(least(u.x1, v.x1) - greatest(u.x0, v.x0) + 1) as pixels from r u join r v on u.y = v.y and u.id < v.id and u.x0 <= v.x1 and v.x0 <= u.x1 group by 1, 2),
e as (select p.a, p.b from p join a x on x.id = p.a join a z on z.id = p.b join c cx on cx.id = p.a join c cz on cz.id = p.b where cx.source <> cz.source and pixels >= least(x.area, z.area, 2) and pixels * 10 >= least(x.area, z.area)),
s as (select a, b from e union select b, a from e), w(id, root) as (select id, id from a union select s.b, w.root from w join s on s.a = w.id), m as (select id, min(root) as grp from w group by id),
j as (select m.grp, c.* from m join c using (id)), o as (select grp, source, max(row(not truncated, coverage, confidence, sharpness, path)) as rank, count(*) as n from j group by all),
q as (select grp, list(source order by rank desc) as sources, sum(n)::bigint as members from o group by grp),
d as (select grp, greatest(min(x0) - 3, 0) as x0, greatest(min(y) - 3, 0) as y0, least(max(x1) + 3, 1199) as x1, least(max(y) + 3, 799) as y1 from r join m using (id) group by grp)
select grp as "group", sources[1] as preferred, sources, members, x0, y0, x1, y1 from q join d using (grp)"""
ORACLES = {
    "person_groups": _PEOPLE,
    "rle_runs": f"with {_mask_sql('r')} select * from r",
    "interval_merge": """with i as (select l_suppkey, l_orderkey * 97 % 5000 as x0, l_orderkey * 97 % 5000 + floor(l_quantity)::bigint as x1 from lineitem),
n as (select *, case when x0 > 1 + max(x1) over (partition by l_suppkey order by x0, x1 rows between unbounded preceding and 1 preceding) then 1 else 0 end as new from i),
g as (select *, sum(new) over (partition by l_suppkey order by x0, x1 rows unbounded preceding) as g from n)
select l_suppkey, min(x0) as x0, max(x1) as x1, count(*) as parts from g group by l_suppkey, g""",
    "box_overlap_pairs": f"""with b as ({duck(BOXES)})
select a.id as a, b.id as b from b a join b on a.id < b.id and a.x0 <= b.x1 + 3 and b.x0 <= a.x1 + 3 and a.y0 <= b.y1 + 3 and b.y0 <= a.y1 + 3""",
    "interval_overlap_pairs": f"""with {_mask_sql("l")}, {_mask_sql("r", "A")}
select l.y // 6 as a, r.y // 6 as b, sum(least(l.x1, r.x1) - greatest(l.x0, r.x0) + 1)::bigint as pixels from l join r on l.y = r.y and l.x0 <= r.x1 and r.x0 <= l.x1 group by 1, 2""",
    "component_boxes": f"""with recursive {_mask_sql("r")}, n as (select y * 10000 + x0 as id, * from r),
e as (select a.id as a, b.id as b from (select *, unnest([-1, 1]) as d from n) a join n b on b.y = a.y + a.d and a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1),
c(id, root) as (select id, id from n union select e.b, c.root from c join e on e.a = c.id), m as (select id, min(root) as component from c group by id)
select component, sum(x1 - x0 + 1)::bigint as area, min(x0) as x0, max(x1) as x1, min(y) as y0, max(y) as y1 from n join m using (id) group by component""",
}
