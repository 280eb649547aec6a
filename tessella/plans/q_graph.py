"""Graph queries: orders are nodes and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..session import table
from .shared import GRID, duck, ticked, view

#: Orders linked within blocks of 64 by their customer, and as one tree.
LINKS = "select o_orderkey as a, cast(floor(o_orderkey / 64) as bigint) * 64 + o_custkey % 64 as b from {orders}"
TREE = "select o_orderkey as a, cast(floor(o_orderkey / 3) as bigint) as b from {orders}"


def _squares(spark, sf):
    cells = view(spark, sf, ticked(GRID))
    across = cells.where("column < 24 and price % 13 <> 4").select("row", "column", F.lit("across").alias("kind"), (100 + F.col("price") % 9).alias("v"))
    down = cells.select("row", "column", F.lit("down").alias("kind"), (80 + F.col("price") % 7).alias("v"))
    return graph.square_residuals(cells, across.unionByName(down))


QUERIES = {
    "components": lambda spark, sf: graph.components(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), view(spark, sf, LINKS)),
    "reachable": lambda spark, sf: graph.reachable(view(spark, sf, TREE)).select("id", F.col("steps").cast("long").alias("steps")),
    "cycle_residual": _squares,
}
_S = "s as (select a, b from e union select b, a from e)"
ORACLES = {
    "components": f"with recursive e as ({duck(LINKS)}), {_S}, c(id, root) as (select o_orderkey, o_orderkey from orders union select s.b, c.root from c join s on s.a = c.id), r as (select id, min(root) as component from c group by id) select r.id, component from r join orders on o_orderkey = r.id",
    "reachable": f"with recursive e as ({duck(TREE)}), {_S}, c(id, steps) as (select 0::bigint, 0::bigint union select s.b, c.steps + 1 from c join s on s.a = c.id where c.steps < 24 and s.a <> s.b) select id, min(steps) as steps from c group by id",
    "cycle_residual": f"""with c as ({duck(GRID)}), h as (select "row" as r, "column" as q, 100 + price % 9 as v from c where "column" < 24 and price % 13 <> 4), d as (select "row" as r, "column" as q, 80 + price % 7 as v from c)
select t.r as "row", t.q as "column", t.v + r.v - b.v - l.v as residual from h t join d l on l.r = t.r and l.q = t.q join h b on b.r = t.r + 1 and b.q = t.q join d r on r.r = t.r and r.q = t.q + 1""",
}
