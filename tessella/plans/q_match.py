"""Matching queries: embeddings are descriptors, events and lines are edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import match
from ..session import table

RATIO = 0.98


def _vectors(spark, sf, odd):
    e = table(spark, sf, "embeddings")
    return e.where(F.col("vec_id") % 2 == odd).select((F.col("label") % 4).alias("tile"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def _edges(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to")).agg(F.round(F.max("l_quantity") + F.sum("l_discount"), 4).alias("rms"))


def _attempt(spark, sf, flag):
    return table(spark, sf, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to")).agg(F.count("*").alias("inliers"))


QUERIES = {
    "mutual_ratio_knn": lambda spark, sf: match.mutual_nearest(_vectors(spark, sf, 0), _vectors(spark, sf, 1), "tile", RATIO).select("a", "b", F.round("distance", 4).alias("distance")),
    "retry_ladder": lambda spark, sf: match.retry_ladder(_edges(spark, sf).select("from", "to"), *[_attempt(spark, sf, f) for f in "ARN"]),
    "worst_edges": lambda spark, sf: match.worst(_edges(spark, sf), "rms", 5, "from", "to"),
    "pair_dedup_over_limit": lambda spark, sf: match.over_limit(_edges(spark, sf), "rms", 45.0).withColumn("rank", F.col("rank").cast("long")),
    "first_match_lookup": lambda spark, sf: match.first_match(_edges(spark, sf).select("from", "to"), table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("from"), F.col("l_suppkey").alias("to"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), "l_quantity"), "edge_id"),
}
_E = 'e as (select l_partkey as "from", l_suppkey as "to", round(max(l_quantity) + sum(l_discount), 4) as rms from lineitem group by 1, 2)'
ORACLES = {
    "mutual_ratio_knn": f"""
with l as (select label % 4 as tile, vec_id as id, embedding::double[] as v from embeddings where vec_id % 2 = 0), r as (select label % 4 as tile, vec_id as id, embedding::double[] as v from embeddings where vec_id % 2 = 1),
p as (select l.id as a, r.id as b, list_distance(l.v, r.v) as d from l join r using (tile)),
x as (select *, row_number() over (partition by a order by d, b) as ra, lead(d) over (partition by a order by d, b) as da, row_number() over (partition by b order by d, a) as rb, lead(d) over (partition by b order by d, a) as db from p)
select a, b, round(d, 4) as distance from x where ra = 1 and rb = 1 and (da is null or d < {RATIO} * da) and (db is null or d < {RATIO} * db)""",
    "retry_ladder": f"""with {_E}, c as (select l_partkey as "from", l_suppkey as "to", nullif(count_if(l_returnflag = 'A'), 0) as a, nullif(count_if(l_returnflag = 'R'), 0) as r, nullif(count_if(l_returnflag = 'N'), 0) as n from lineitem group by 1, 2)
select "from", "to", coalesce(a, r, n)::bigint as inliers, case when a is not null then 1 when r is not null then 2 when n is not null then 3 else 0 end as attempt from c""",
    "worst_edges": f'with {_E} select * from e order by rms desc, "from", "to" limit 5',
    "pair_dedup_over_limit": f'with {_E} select least("from", "to") as a, greatest("from", "to") as b, max(rms) as rms, row_number() over (order by max(rms) desc, least("from", "to"), greatest("from", "to")) as rank from e where rms > 45 group by 1, 2',
    "first_match_lookup": f"""with {_E}, m as (select l_partkey as "from", l_suppkey as "to", min(l_orderkey * 10 + l_linenumber) as edge_id, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) as l_quantity from lineitem where l_returnflag = 'R' group by 1, 2)
select "from", "to", edge_id, l_quantity, edge_id is not null as complete from e left join m using ("from", "to")""",
}
