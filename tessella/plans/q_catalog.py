"""Record queries: orders are tasks of a customer's library, pages are files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog
from ..session import table


def _orders(spark, sf):
    return table(spark, sf, "orders")


def _cached(spark, sf):
    pages = table(spark, sf, "pages")
    cache = pages.where("page_id % 3 <> 0").select(F.sha2("url", 256).alias("key"), F.col("html").alias("body"), F.sha2(F.when(F.col("page_id") % 5 == 0, "broken").otherwise(F.col("html")), 256).alias("body_hash"))
    return catalog.cached(pages.select("page_id", F.sha2("url", 256).alias("key")), cache.dropDuplicates(["key", "body"]), "key").select("page_id", F.length("body").cast("long").alias("length"))


def _files(spark, sf):
    p = table(spark, sf, "part")
    ext = F.element_at(F.array(*map(F.lit, [".PNG", ".tif", ".jpeg", ".JXL", "", ".gif"])), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit("."), F.col("p_size") % 3, ext).alias("name"))


def _galleries(spark, sf):
    rows = _orders(spark, sf).select("o_custkey", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(F.lower("o_orderpriority")).alias("name"), F.date_trunc("month", "o_orderdate").alias("created"))
    out = None
    for mode in catalog.GALLERY:
        own = catalog.gallery(rows, ["o_custkey"], mode).select(F.lit(mode).alias("mode"), "id", F.col("rank").cast("long").alias("rank"))
        out = own if out is None else out.union(own)
    return out


def _bodies(spark, sf):
    c = F.col
    one = F.concat(F.lit('{"cust":'), c("o_custkey"), F.lit(',"workers":'), c("o_orderkey") % 9, F.lit(',"prio":"'), c("o_orderpriority"), F.lit('"}'))
    two = F.concat(F.lit('{"prio":"'), c("o_orderpriority"), F.lit('","outputDir":"x'), c("o_orderkey"), F.lit('","cust":'), c("o_custkey"), F.lit("}"))
    return _orders(spark, sf).withColumn("body", F.when(c("o_orderkey") % 3 == 0, one).when(c("o_orderkey") % 3 == 1, two).otherwise("{broken"))


QUERIES = {
    "gallery_sort_rank": lambda spark, sf: catalog.ranked(_orders(spark, sf).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank")),
    "best_duplicate": lambda spark, sf: catalog.best(_orders(spark, sf), ["o_custkey"], F.asc(F.col("o_orderpriority") != "1-URGENT"), F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice"),
    "clear_best_duplicate": lambda spark, sf: catalog.clear_best(table(spark, sf, "lineitem").select("l_partkey", F.when(F.col("l_orderkey") % 50 != 0, F.col("l_quantity")).alias("bytes")), ["l_partkey"], "bytes"),
    "content_hash": lambda spark, sf: table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("sha256")),
    "request_fingerprint": lambda spark, sf: _orders(spark, sf).select("o_orderkey", catalog.fingerprint("o_custkey", "o_orderpriority", "o_orderstatus").alias("sha256")),
    "cache_key_lookup": _cached,
    "pending_tiles": lambda spark, sf: catalog.pending(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").where("l_linenumber <= 3"), table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").where("l_returnflag <> 'N'"), ["l_orderkey", "l_linenumber"]),
    "set_equality": lambda spark, sf: catalog.same_rows(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").where("l_orderkey % 3 <> 0"), table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").where("l_orderkey % 5 <> 0")),
    "admission": lambda spark, sf: catalog.admitted(_orders(spark, sf).select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"], "o_totalprice", 500_000.0, 4).select("o_custkey", "o_orderkey", F.col("slot").cast("long").alias("slot"), F.round("spent", 2).alias("spent")),
    "format_by_ext": lambda spark, sf: _files(spark, sf).select("p_partkey", catalog.export_format(F.col("name")).alias("format")),
    "unique_names": lambda spark, sf: catalog.unique_names(_files(spark, sf), "name", "p_partkey").select("p_partkey", "unique_name"),
    "status_counts": lambda spark, sf: catalog.status_counts(_orders(spark, sf), "o_orderstatus"),
    "gallery_modes": _galleries,
    "request_hash": lambda spark, sf: _bodies(spark, sf).select("o_orderkey", catalog.request_hash(F.col("body")).alias("hash")),
    "same_maps": lambda spark, sf: _orders(spark, sf).select("o_orderkey", catalog.same_map(F.create_map(F.lit("a"), F.col("o_orderkey") % 3, F.lit("b"), F.col("o_custkey") % 2), F.create_map(F.lit("b"), F.col("o_orderkey") % 2, F.lit("a"), F.col("o_custkey") % 3)).alias("same")),
    "clear_best_only": lambda spark, sf: catalog.only_clear(table(spark, sf, "lineitem").select("l_partkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_extendedprice") / 1e7).alias("bytes")).distinct(), ["l_partkey"], "bytes").select("l_partkey", F.round("size", 4).alias("size")),
}
_F = """f as (select p_partkey, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') || '.' || (p_size % 3) || ['.PNG', '.tif', '.jpeg', '.JXL', '', '.gif'][p_partkey % 6 + 1] as name from part)"""
ORACLES = {
    "gallery_sort_rank": "select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as rank from orders",
    "best_duplicate": """with r as (select *, row_number() over (partition by o_custkey order by o_orderpriority <> '1-URGENT', o_totalprice desc, o_orderkey) as k from orders) select o_custkey, o_orderkey, o_totalprice from r where k = 1""",
    "clear_best_duplicate": """with l as (select l_partkey, case when l_orderkey % 50 <> 0 then l_quantity end as b from lineitem), m as (select *, max(b) over (partition by l_partkey) as top from l)
select l_partkey, max(top) as size, count(*) as copies, count(*) = count(b) and count_if(b = top) = 1 as clear from m group by l_partkey""",
    "content_hash": "select page_id, sha256(html) as sha256 from pages",
    "request_fingerprint": """select o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderpriority":"' || o_orderpriority || '","o_orderstatus":"' || o_orderstatus || '"}') as sha256 from orders""",
    "cache_key_lookup": """with c as (select distinct url, html as body, page_id % 5 = 0 as broken from pages where page_id % 3 <> 0), g as (select url, body from c where not broken)
select page_id, length(body)::bigint as length from pages left join g using (url)""",
    "pending_tiles": "select l_orderkey, l_linenumber from lineitem l where l_linenumber <= 3 and not exists (select 1 from lineitem d where d.l_orderkey = l.l_orderkey and d.l_linenumber = l.l_linenumber and d.l_returnflag <> 'N')",
    "set_equality": """with a as (select l_partkey, l_suppkey from lineitem where l_orderkey % 3 <> 0), b as (select l_partkey, l_suppkey from lineitem where l_orderkey % 5 <> 0),
x as (select count(*) as n from (select * from a except all select * from b)), y as (select count(*) as n from (select * from b except all select * from a))
select x.n as only_a, y.n as only_b, x.n = 0 and y.n = 0 as same from x, y""",
    "admission": """with w as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as slot, sum(o_totalprice) over (partition by o_custkey order by o_orderkey rows unbounded preceding) as spent from orders)
select o_custkey, o_orderkey, slot, round(spent, 2) as spent from w where slot <= 4 and spent <= 500000""",
    "format_by_ext": f"""with {_F} select p_partkey, case regexp_extract(lower(name), '\\.([^./]+)$', 1) when 'png' then 'png' when 'tif' then 'tiff' when 'tiff' then 'tiff' when 'jpg' then 'jpeg' when 'jpeg' then 'jpeg' when 'jxl' then 'jxl' end as format from f""",
    "unique_names": f"with {_F}, n as (select *, row_number() over (partition by name order by p_partkey) as k from f) select p_partkey, case when k = 1 then name else name || ' (' || k || ')' end as unique_name from n",
    "gallery_modes": """with r as (select o_custkey as c, o_orderkey as id, lower(o_orderpriority) as name, date_trunc('month', o_orderdate) as d from orders)
select 'name' as mode, id, row_number() over (partition by c order by name, d desc, id) as rank from r union all select 'name-down', id, row_number() over (partition by c order by name desc, d desc, id) from r
union all select 'newest', id, row_number() over (partition by c order by d desc, name, id) from r union all select 'oldest', id, row_number() over (partition by c order by d, name, id) from r""",
    "request_hash": "select o_orderkey, case when o_orderkey % 3 < 2 then sha256('cust=' || o_custkey || chr(1) || 'prio=' || o_orderpriority) end as hash from orders",
    "same_maps": "select o_orderkey, o_orderkey % 3 = o_custkey % 3 and o_orderkey % 2 = o_custkey % 2 as same from orders",
    "clear_best_only": "select l_partkey, round(max(l_orderkey * 10 + l_linenumber + l_extendedprice / 1e7), 4) as size from lineitem group by 1",
    "status_counts": "select o_orderstatus, count(*) as n from orders group by 1",
}
