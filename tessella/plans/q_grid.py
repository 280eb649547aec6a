"""Grid queries: orders are the cells of one grid, suppliers have grids of their own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid
from ..session import table
from .shared import GRID, duck, ticked, view

GRIDS = "select s_suppkey as grid, 1 + s_suppkey % 7 as rows, cast(1 + s_nationkey % 9 as bigint) as columns from {supplier}"
#: Captures of 20 pictures, 4 x 5; some have a name of another form, a cell twice or none for a cell.
NAMES = """select cast(floor(o_orderkey / 20) as bigint) as capture, cast(3 + cast(floor(o_orderkey % 20 / 5) as int) as string) || case when o_orderkey % 3 = 0 then '-' else '_' end || lpad(cast(o_orderkey % 5 + case when o_custkey % 40 = 7 then 1 else 0 end as string), 3, '0')
|| case when o_custkey % 50 = 3 then '.png' when o_orderkey % 2 = 0 then '.JPG' else '.jpeg' end as name from {orders}"""


def _cells(spark, sf):
    return view(spark, sf, ticked(GRID)).select("id", "row", "column")


def _edges(spark, sf):
    return grid.neighbours(_cells(spark, sf), grid.RIGHT_DOWN)


def _missing(spark, sf):
    seen = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("from"), (F.col("l_orderkey") + F.when(F.col("l_linenumber") % 2 == 0, 25).otherwise(1)).alias("to"))
    return grid.missing(_edges(spark, sf), seen)


QUERIES = {
    "grid_snake_plan": lambda spark, sf: grid.plans(view(spark, sf, GRIDS), "grid"),
    "grid_corner_orders": lambda spark, sf: grid.corner_orders(view(spark, sf, GRIDS), "grid"),
    "grid_from_names": lambda spark, sf: grid.from_names(view(spark, sf, NAMES), ["capture"]),
    "grid_check": lambda spark, sf: grid.check(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("column"))),
    "neighbors4": _edges,
    "neighbors8": lambda spark, sf: grid.neighbours(_cells(spark, sf), grid.EIGHT_ONCE),
    "missing_edges": _missing,
    "locked_edges": lambda spark, sf: grid.without_locked(_edges(spark, sf), view(spark, sf, ticked(GRID)).where("priority = '1-URGENT'").select("id")),
    "natural_sort_key": lambda spark, sf: table(spark, sf, "customer").select("c_custkey", grid.natural_key(F.concat("c_name", F.lit("_"), F.col("c_custkey") % 7, F.lit(".jpg"))).alias("sort_key")),
}

_CELLS = f"cells as ({duck(GRID)})"
_EDGES = _CELLS + """, e as (select a.id as "from", b.id as "to" from (select *, unnest([0, 1]) as d from cells) a join cells b on b."row" = a."row" + d and b."column" = a."column" + 1 - d)"""
ORACLES = {
    "grid_snake_plan": f"""with g as ({duck(GRIDS)}), s as (select *, unnest(range(rows * columns)) as sequence from g)
select grid, sequence, sequence // columns as "row", case when (sequence // columns) % 2 = 1 then columns - 1 - sequence % columns else sequence % columns end as "column" from s""",
    "grid_corner_orders": f"""
with g as ({duck(GRIDS)}), k as (select * from (values ('row'), ('column')) a(axis), (values (false), (true)) b(bottom), (values (false), (true)) c("right"), (values (false), (true)) d(serpentine)),
s as (select *, case when axis = 'row' then columns else rows end as w, unnest(range(rows * columns)) as sequence from k, g),
p as (select *, sequence // w as line, case when serpentine and (sequence // w) % 2 = 1 then w - 1 - sequence % w else sequence % w end as step from s),
q as (select *, case when axis = 'row' then line else step end as r, case when axis = 'row' then step else line end as c from p)
select grid, axis, bottom, "right", serpentine, sequence, case when bottom then rows - 1 - r else r end as "row", case when "right" then columns - 1 - c else c end as "column" from q""",
    "grid_from_names": rf"""with f as ({duck(NAMES)}), h as (select capture, name, regexp_matches(lower(name), '^(\d+)[_-](\d+)\.(?:jpe?g)$') as fine, try_cast(regexp_extract(name, '^(\d+)', 1) as bigint) as r, try_cast(regexp_extract(name, '[_-](\d+)', 1) as bigint) as c from f),
w as (select capture, min(r) as r0, min(c) as c0 from h group by capture having bool_and(fine) and count(*) = count(distinct (r, c)) and count(*) = (max(r) - min(r) + 1) * (max(c) - min(c) + 1))
select capture, name, r - r0 as "row", c - c0 as "column" from h join w using (capture)""",
    "grid_check": """select max(l_suppkey) + 1 as rows, max(l_linenumber) + 1 as columns, count(*) as cells, count(distinct (l_suppkey, l_linenumber)) as distinct_cells,
  count(*) = (max(l_suppkey) + 1) * (max(l_linenumber) + 1) and count(*) = count(distinct (l_suppkey, l_linenumber)) as complete from lineitem""",
    "neighbors4": f"with {_EDGES} select * from e",
    "neighbors8": f"""with {_CELLS}, o(r, c) as (values (0, 1), (1, 0), (1, 1), (1, -1)) select a.id as "from", b.id as "to" from (select * from cells, o) a join cells b on b."row" = a."row" + r and b."column" = a."column" + c""",
    "missing_edges": f"""with {_EDGES} select * from e where not exists (select 1 from lineitem where l_orderkey = e."from" and l_orderkey + case when l_linenumber % 2 = 0 then 25 else 1 end = e."to")""",
    "locked_edges": f"""with {_EDGES}, l as (select id from cells where priority = '1-URGENT') select * from e where "from" not in (select id from l) and "to" not in (select id from l)""",
    "natural_sort_key": """
with n as (select c_custkey, lower(c_name || '_' || (c_custkey % 7)::varchar || '.jpg') as name from customer),
p as (select c_custkey, regexp_extract_all(name, '\\d+|\\D+') as parts from n)
select c_custkey, array_to_string(list_transform(parts, lambda p: case when regexp_matches(p, '^\\d') then lpad(regexp_replace(p, '^0+(.)', '\\1'), 20, '0') else p end), chr(1)) as sort_key from p""".replace("\\\\", "\\"),
}
