"""Record queries: orders are jobs and results, lines are their files, pages are names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import records
from ..session import table
from .shared import duck, view

C = F.col
STAGES = """select event_id, case event_id % 14 when 0 then 'grid-component-pose-' || user_id when 1 then 'pixel-bundle-3' when 2 then 'retry-matching' when 3 then 'retry-matching-progress:' || user_id % 30 || '/20' when 4 then 'clahe-retry' when 5 then 'clahe-retry-progress:x/9'
when 6 then 'joint-cycle-prune-1' when 7 then 'source-plane-warp-2' when 8 then 'validation-complete' when 9 then 'registration-complete' when 10 then 'precision-recovery-start' when 11 then 'clahe-retry-progress:4/8' when 12 then 'export' end as stage from {events}"""
NAMES = """select p_partkey, case p_partkey % 8 when 0 then p_name when 1 then ' ' || p_name when 2 then 'con.txt' when 3 then 'a/b' || p_partkey when 4 then 'x.' when 5 then 'Com' || p_size % 12 when 6 then '..' else p_brand || '?' end as name,
case p_partkey % 5 when 0 then 'v1.' || p_size || '.3' when 1 then '1.2.3+' || p_size when 2 then '1.2' else p_size || '.0.' || p_partkey end as version, p_retailprice from {part}"""
REPORTS = """select o_orderkey, case o_orderkey % 9 when 0 then 'central-measured-overlap-grid' when 1 then 'nominal-fov-grid' when 2 then 'visual-ray' when 3 then 'visual-ray-grid-2' when 4 then 'planar' when 5 then 'Grid-x' when 6 then 'visual-grid-bridge' end as geometry,
cast(case when o_custkey % 3 > 0 then o_custkey % 5 * (o_custkey % 2) end as bigint) as forced, cast(case when o_custkey % 4 > 0 then o_orderkey % 4 end as bigint) as visual, cast(case when o_custkey % 5 > 0 then o_orderkey % 3 * (o_custkey % 2) end as bigint) as estimated,
cast(case when o_custkey % 7 > 0 then 3 end as bigint) as total, case when o_orderkey % 2 = 0 then 'passed-measured-checks' else 'needs-review' end as quality, o_orderkey % 5 = 0 as evidence, o_orderkey % 31 = 0 as nominal from {orders}"""
LOCKS = "select distinct l_partkey as photo_cell, cast(floor(l_partkey / 20) as bigint) as \"row\", l_partkey % 20 as \"column\", case when l_partkey % 3 > 0 then 'user' end as origin from {lineitem} where l_returnflag = 'R'"
OLD = 'select p_partkey as photo, cast(floor(p_partkey / 20) as bigint) as "row", p_partkey % 20 as "column" from {part} where p_size > 5'
NEW = 'select p_partkey as photo, cast(floor(p_partkey / 25) as bigint) as "row", p_partkey % 25 as "column" from {part} where p_size < 40'
TILES = "select l_orderkey as manifest, l_linenumber % 4 - 1 as \"row\", cast(l_quantity as int) % 4 as \"column\", case l_partkey % 6 when 0 then '/abs.png' when 1 then 'a/../b.png' when 2 then 'c:x' else 'ok.png' end as path, case when l_suppkey % 3 = 0 then 512 else 376 end as w, 512 as h, 1400 as width, 1536 as height from {lineitem}"
FILES = "select l_orderkey, l_quantity as wanted_bytes, case when l_partkey % 9 > 0 then l_quantity end as got_bytes, cast(l_suppkey as string) as wanted_hash, cast(case when l_partkey % 31 > 0 then l_suppkey end as string) as got_hash from {lineitem}"
COMPONENTS = "select l_suppkey as grp, l_orderkey * 10 + l_linenumber as id, l_linenumber > 3 as truncated, l_discount as coverage, l_tax as confidence, l_quantity as sharpness from {lineitem}"


def _spark(sql):
    return sql.replace('"', "`")


def _names(spark, sf):
    cols = [text.is_valid_name(C("name")).alias("valid"), text.safe_name(C("name")).alias("safe"), text.last_segment(C("name")).alias("last"), text.version_key(C("version")).alias("version")]
    return view(spark, sf, NAMES).select("p_partkey", *cols)


def _reconciled(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(C("o_orderkey") % 3 > 0, C("o_orderstatus")).alias("status"), C("o_totalprice").alias("price"))
    native = o.where("o_orderkey % 4 > 0").select((C("o_orderkey") + 2).alias("o_orderkey"), F.when(C("o_orderkey") % 5 > 0, "native").alias("status"), F.lit(None).cast("double").alias("price"))
    export = o.where("o_orderkey % 7 = 0").select("o_orderkey", F.lit(None).cast("string").alias("status"), (C("price") + 1).alias("price"))
    return records.reconciled(o, native, export, key="o_orderkey", columns=["status", "price"]).withColumn("price", F.round("price", 2))


def _verified(spark, sf):
    pages = table(spark, sf, "pages")
    refs = pages.select("page_id", F.sha2(F.when(C("page_id") % 6 == 0, "other").otherwise(C("html")), 256).alias("digest"))
    return records.verified(refs, pages.where("page_id % 5 > 0"), "page_id", "digest", "html").select("page_id", "state")


def _complete(spark, sf):
    lines = table(spark, sf, "lineitem")
    return records.complete(lines, lines.where("l_partkey % 6 > 0"), "l_orderkey", ["l_linenumber"])


def _appended(spark, sf):
    p = table(spark, sf, "part")
    known = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("C:\\in\\"), C("p_size"), F.lit("/")).alias("path"))
    found = p.select(F.concat(F.when(C("p_partkey") % 2 == 0, "c:/in/").otherwise("C:/IN/"), C("p_size") + C("p_partkey") % 4, F.when(C("p_partkey") % 5 == 0, "/").otherwise("")).alias("path"))
    return records.appended(known.distinct(), found, "path")


def _gated(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), C("l_partkey")).alias("path"))
    now = lines.select("l_orderkey", "l_linenumber", F.when(F.xxhash64("l_orderkey") % 1 == 0, F.lower("path")).alias("path")).where("l_orderkey % 9 > 0 or l_linenumber <> 2")
    return records.gated(lines, now, "l_orderkey", ["l_linenumber"], "path")


def _paths(spark, sf):
    p = table(spark, sf, "part")
    return records.overlapping_paths(p.select(F.concat(F.lit("a/"), C("p_size")).alias("path")).union(p.select(F.concat(F.lit("a/"), C("p_size") % 9, F.lit("/b/"), C("p_partkey") % 40).alias("path"))))


def _layers(spark, sf):
    lines = table(spark, sf, "lineitem")
    base = lines.groupBy((C("l_partkey") % 50).alias("x"), (C("l_suppkey") % 40).alias("y")).agg((F.count("*") % 256).alias("v"))
    over = base.where("(x + y) % 3 = 0").select("x", "y", (C("x") * 5 % 256).alias("v"), (C("y") * 13 % 256).alias("a"))
    return records.merged_layers(base, over)


def _owners(spark, sf):
    lines = table(spark, sf, "lineitem")
    owners = lines.where("l_partkey % 17 = 0").groupBy((C("l_partkey") % 60).alias("x"), (C("l_suppkey") % 50).alias("y")).agg(F.min("l_suppkey").alias("owner"))
    i = C("id")
    return records.nearest_owner(owners, spark.range(3000).select((i % 60).alias("x"), F.expr("id div 60").alias("y")))


def _scene(spark, sf):
    lines = table(spark, sf, "lineitem")
    share = records.water_share((C("l_quantity") * 5).cast("double"))
    distance = records.colour_distance([C("l_quantity"), C("l_tax") * 1000, F.lit(7.0)], [C("l_discount") * 1000, C("l_quantity") * 2, F.lit(90.0)])
    owner = F.when(C("l_suppkey") % 4 == 0, C("l_suppkey"))
    return lines.select("l_orderkey", "l_linenumber", records.blend_override(C("l_partkey") % 2 == 0, C("l_partkey") % 3 == 0, owner, share).alias("decides"), F.round(distance, 6).alias("distance"))


QUERIES = {
    "stage_names": lambda spark, sf: view(spark, sf, STAGES).select("event_id", text.stage_family(C("stage")).alias("family"), F.round(text.stage_progress(C("stage")), 6).alias("progress")),
    "name_rules": _names,
    "page_text": lambda spark, sf: table(spark, sf, "pages").select("page_id", F.sha2(text.without_markup(C("html")), 256).alias("sha256")),
    "local_dates": lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", text.local_date(C("o_orderdate")).alias("iso"), text.local_date(C("o_orderdate"), True).alias("american")),
    "result_provenance": lambda spark, sf: view(spark, sf, REPORTS).select("o_orderkey", records.provenance().alias("kind")),
    "record_reconciliation": _reconciled,
    "artifact_states": _verified,
    "render_completeness": _complete,
    "download_batches": lambda spark, sf: records.downloads(view(spark, sf, FILES), "l_orderkey").select("l_orderkey", "files", F.round("bytes", 2).alias("bytes"), "admitted"),
    "folders_appended": _appended,
    "locks_rekeyed": lambda spark, sf: records.rekeyed_locks(*[view(spark, sf, _spark(x)) for x in (LOCKS, OLD, NEW)]),
    "diagnostics_gate": _gated,
    "manifest_faults": lambda spark, sf: records.manifest_faults(view(spark, sf, _spark(TILES)), "manifest", 512),
    "overlapping_paths": _paths,
    "layers_merged": _layers,
    "nearest_owner": _owners,
    "best_components": lambda spark, sf: records.best_component(view(spark, sf, COMPONENTS), "grp", "id"),
    "scene_decisions": _scene,
}
_FAMILY = "case when stage like 'grid-component-pose-%' then 'optimize-grid-poses' when stage like 'pixel-%' then 'refine-pixel-texture' when stage in ('retry-matching', 'clahe-retry') or stage like '%-progress:%' then 'retry-neighbor-matching' when stage like 'joint-%' then 'prune-conflicting-neighbors' when stage like 'source-plane%' then 'fit-local-texture-warp' else stage end"
_NORM = "regexp_replace(replace(lower(path), chr(92), '/'), '/+$', '')"
ORACLES = {
    "stage_names": f"""with s as ({duck(STAGES)}), n as (select *, try_cast(regexp_extract(stage, 'retry-matching-progress:([0-9]+)/', 1) as bigint) as done from s)
select event_id, {_FAMILY} as family, round(case event_id % 14 when 0 then 0.15 when 1 then 0.15 when 3 then case when done between 1 and 20 then 0.10 + 0.02::double * (done / 20) end when 4 then 0.12 when 6 then 0.17 when 7 then 0.18 when 8 then 0.04 when 9 then 0.19 when 10 then 0.18 when 11 then 0.13 end, 6)::double as progress from n""",
    "name_rules": f"""with n as ({duck(NAMES)}) select p_partkey, name = trim(name) and name not in ('', '.', '..') and not regexp_matches(name, '[\\\\/:*?"<>|\\x00-\\x1f]') and not name like '%.' and not regexp_matches(upper(split_part(name, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') as valid,
  regexp_replace(trim(name), '[\\\\/:*?"<>|\\x00-\\x1f]+', '_', 'g') as safe, string_split(name, '/')[-1] as last,
  case when regexp_matches(version, '^v?[0-9]+[.][0-9]+[.][0-9]+([+][0-9]+)?$') then list_transform(list_resize(regexp_extract_all(version, '[0-9]+'), 4, '0'), lambda x: x::int) end as version from n""",
    "page_text": r"""select page_id, sha256(trim(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', '', 'g'), '&amp;', '&'), '&#x2F;', '/'), '&#47;', '/'), '&quot;', '"'), '&#39;', ''''))) as sha256 from pages""",
    "local_dates": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M') as iso, strftime(o_orderdate, '%m/%d/%Y %H:%M') as american from orders",
    "result_provenance": f"""with r as ({duck(REPORTS)}), f as (select *, coalesce(contains(lower(geometry), 'grid'), false) as grid, coalesce(forced > 0, false) as f, coalesce(visual > 0, false) as v, coalesce(estimated > 0, false) as e, coalesce(geometry like 'visual-%', false) as model, coalesce(geometry, '') as g from r)
select o_orderkey, case when not (nominal or grid or e or f) and (evidence or model) and quality = 'passed-measured-checks' and (total is null or (visual is not distinct from total and estimated is not distinct from 0 and forced is not distinct from 0) or (model and visual is null and estimated is null and forced is null)) then 'normal'
  when g = 'central-measured-overlap-grid' then 'measured-grid' when g = 'nominal-fov-grid' or nominal then case when f then 'forced-grid' else 'nominal-grid' end
  when f and coalesce(forced >= total, false) and not v then 'forced-grid' when f or (e and v) or contains(g, 'grid-bridge') or contains(g, 'visual-ray-grid') then 'mixed-grid' when e and not v then 'estimated-grid' when grid then 'mixed-grid' else 'unknown' end as kind from f""",
    "record_reconciliation": """with o as (select o_orderkey as k, case when o_orderkey % 3 > 0 then o_orderstatus end as s, o_totalprice as p from orders), n as (select k + 2 as k, case when k % 5 > 0 then 'native' end as s from o where k % 4 > 0), x as (select k, p + 1 as p from o where k % 7 = 0)
select coalesce(o.k, n.k) as o_orderkey, coalesce(n.s, o.s) as status, round(coalesce(x.p, o.p), 2) as price from o full join n on o.k = n.k left join x on x.k = coalesce(o.k, n.k)""",
    "artifact_states": "select page_id, case when page_id % 5 = 0 then 'missing' when page_id % 6 = 0 then 'changed' else 'verified' end as state from pages",
    "render_completeness": """with h as (select distinct l_orderkey, l_linenumber from lineitem where l_partkey % 6 > 0) select l.l_orderkey, count(*) as expected, count_if(h.l_orderkey is null)::bigint as lacking, count_if(h.l_orderkey is null) = 0 as complete from lineitem l left join h using (l_orderkey, l_linenumber) group by 1""",
    "download_batches": f"select l_orderkey, count(*) as files, round(sum(coalesce(got_bytes, 0)), 2) as bytes, bool_and(coalesce(wanted_bytes = got_bytes and wanted_hash = got_hash, false)) as admitted from ({duck(FILES).replace(' as string)', ' as varchar)')}) group by 1",
    "folders_appended": f"""with k as (select distinct 'C:' || chr(92) || 'in' || chr(92) || p_size || '/' as path from part where p_partkey % 3 = 0), f as (select case when p_partkey % 2 = 0 then 'c:/in/' else 'C:/IN/' end || (p_size + p_partkey % 4) || case when p_partkey % 5 = 0 then '/' else '' end as path from part),
n as (select {_NORM} as p, min(path) as path from f group by 1) select path from k union all select path from n where p not in (select {_NORM} from k)""",
    "locks_rekeyed": f"""with l as ({duck(LOCKS)}), o as ({duck(OLD)}), n as ({duck(NEW)}) select distinct coalesce(n."row", l."row") as "row", coalesce(n."column", l."column") as "column", coalesce(origin, 'legacy-unknown') as origin, n.photo is null as pending
from l left join o on o."row" = l."row" and o."column" = l."column" left join n on n.photo = o.photo""",
    "diagnostics_gate": """with l as (select l_orderkey, l_linenumber, 'P' || l_partkey as path, count(*) over (partition by l_orderkey, l_linenumber) as k from lineitem)
select l_orderkey, l_linenumber, path from l where l_orderkey not in (select l_orderkey from l where k > 1 or (l_orderkey % 9 = 0 and l_linenumber = 2))""",
    "manifest_faults": f"""with t as (select *, count(*) over (partition by manifest, "row", "column") as k from ({duck(TILES)})), f as (select *, case when "row" < 0 or "column" * 512 >= width or "row" * 512 >= height then 'outside' when w <> least(512, width - "column" * 512) or h <> least(512, height - "row" * 512) then 'size' when k > 1 then 'repeated' when path <> 'ok.png' then 'path' end as fault from t)
select manifest, "row", "column", fault from f where fault is not null""",
    "overlapping_paths": "with p as (select 'a/' || p_size as path from part union select 'a/' || p_size % 9 || '/b/' || p_partkey % 40 from part) select o.path as outer, i.path as inner from p o join p i on starts_with(i.path, o.path || '/')",
    "layers_merged": """with b as (select l_partkey % 50 as x, l_suppkey % 40 as y, count(*) % 256 as v from lineitem group by 1, 2), m as (select *, (x + y) % 3 = 0 as o, x * 5 % 256 as ov, y * 13 % 256 as a from b)
select x, y, case when not o or a = 0 then v when a = 255 then ov else round((ov * a + v * (255 - a)) / 255.0::double) end::bigint as v from m""",
    "nearest_owner": """with o as (select l_partkey % 60 as x, l_suppkey % 50 as y, min(l_suppkey) as owner from lineitem where l_partkey % 17 = 0 group by 1, 2), c as (select range % 60 as x, range // 60 as y from range(3000)),
n as (select c.x, c.y, o.owner, (c.x - o.x) ** 2 + (c.y - o.y) ** 2 as d from c left join o on abs(c.x - o.x) <= 3 and abs(c.y - o.y) <= 3 and (c.x - o.x) ** 2 + (c.y - o.y) ** 2 <= 9)
select x, y, first(owner order by d, owner) as owner from n group by 1, 2""",
    "best_components": f"select grp, first(id order by truncated, coverage desc, confidence desc, sharpness desc, id desc) as id from ({duck(COMPONENTS)}) group by grp",
    "scene_decisions": """with s as (select *, greatest(0, least(1, (l_quantity * 5 - 160) / 64)) as t from lineitem), w as (select *, round(t * t * (3 - 2 * t) * 255)::int as share from s)
select l_orderkey, l_linenumber, case when l_partkey % 2 = 0 and l_suppkey % 4 = 0 then 'person:' || l_suppkey when l_partkey % 3 = 0 and share > 0 then 'water:' || share else 'base' end as decides,
  round(sqrt((l_quantity - l_discount * 1000) ** 2 + (l_tax * 1000 - l_quantity * 2) ** 2 + 83 * 83) / 441.7, 6) as distance from w""",
}
