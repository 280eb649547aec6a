"""Reader and writer queries: requests, manifests and records are made from orders, written to the shared folder and read back."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import functions as F

from ..session import shared_dir, table
from ..sinks import writers
from ..sources import paged, photos, readers
from .shared import duck, view

C, SIDE = F.col, 64
#: Fixed value: the widest that a JPEG can be.
WIDEST = 65535
#: A picture as wide as SIDE and as high as there are suppliers.
PIXELS = "select l_partkey % 64 as x, l_suppkey as y, cast(sum(l_quantity) as bigint) as v from {lineitem} group by l_partkey % 64, l_suppkey"
ALBUM = """select cast(floor(page_id / 20) as int) as page, cast(page_id % 20 as int) as place, '/sd/' || page_id % 97 as filePath, 'p' || page_id as fileName, length(html) as fileSize,
case when page_id % 97 % 5 > 0 then page_id % 97 * 86400 + page_id end as modificationTime from {pages}"""
SPOOL = "select l_suppkey % 25 as band, l_partkey % 40 as `row`, l_quantity as v from {lineitem}"
REQUESTS = """select o_orderkey, case o_orderkey % 8 when 0 then '{{broken' when 1 then '{{"rows":0,"columns":2,"fx":1,"fy":1,"cx":0,"cy":0}}' when 2 then '{{"rows":1,"columns":1,"fx":-1,"fy":1,"cx":0,"cy":0,"tiles":[{{"row":0,"column":0,"path":"a"}}]}}'
when 3 then '{{"rows":1,"columns":2,"fx":1,"fy":1,"cx":0,"cy":0,"overlapX":0.5,"tiles":[{{"row":0,"column":0,"path":"a"}},{{"row":0,"column":0,"path":"b"}}]}}' when 4 then '{{"rows":1,"columns":1,"fx":1,"fy":1,"cx":0,"cy":0,"tiles":[{{"row":0,"column":1,"path":"a"}}]}}'
when 5 then '{{"rows":2,"columns":1,"fx":1,"fy":1,"cx":0,"cy":0,"tiles":[]}}' else '{{"rows":1,"columns":1,"fx":' || o_custkey || ',"fy":1,"cx":0,"cy":0,"workers":' || o_custkey % 9 || ',"tiles":[{{"row":0,"column":0,"path":"a"}}]}}' end as body from {orders}"""
REQUESTS = REQUESTS.replace("{{", "\x01").replace("}}", "\x02")
TASKS = """select case when o_orderkey % 11 = 0 then 'unreadable' else '\x01"id":"t' || o_orderkey || '","schemaVersion":' || o_custkey % 4 || ',"phase":"' || case when o_custkey % 3 = 0 then 'running' else 'done' end || '","createdAt":"2024-01-' || case when o_custkey % 28 < 9 then '0' else '' end || (o_custkey % 28 + 1) || 'T00:00:00Z"\x02' end as body from {orders}"""


def _plain(sql: str) -> str:
    return sql.replace("\x01", "{").replace("\x02", "}")


def _view(spark, sf, sql):
    df = view(spark, sf, sql)
    return df.withColumn("body", F.replace(F.replace("body", F.lit("\x01"), F.lit("{")), F.lit("\x02"), F.lit("}")))


def _folder(spark):
    return f"{shared_dir(spark)}/files/{uuid.uuid4().hex}"


def _parsed(spark, sf):
    got = readers.requests(_view(spark, sf, REQUESTS))
    return got.select("o_orderkey", "request.rows", "request.columns", "request.workers", "request.overlapX", "request.traversal", F.size("request.tiles").alias("tiles"))


def _tsv(spark, sf):
    path = _folder(spark)
    lines = table(spark, sf, "part").select(F.concat_ws("\t", (C("p_partkey") % 7).cast("string"), C("p_size").cast("string"), C("p_brand")).alias("value"))
    lines.unionByName(spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return readers.tsv_manifest(spark, path)


def _json(spark, sf):
    path = _folder(spark)
    nations = table(spark, sf, "nation")
    tile = F.struct((C("n_nationkey") % 5).cast("int").alias("row"), F.floor(C("n_nationkey") / 5).cast("int").alias("column"), F.concat(F.when(C("n_nationkey") % 2 == 0, "/x/").otherwise("tiles/"), "n_name").alias("path"))
    nations.agg(F.lit(5).alias("rows"), F.lit(5).alias("columns"), F.collect_list(tile).alias("tiles")).coalesce(1).write.json(path)
    got = readers.json_manifest(spark, path)
    return got.select("rows", "columns", "row", "column", F.when(C("path").startswith("/x/"), C("path")).otherwise(F.concat(F.lit("beside/"), F.regexp_extract("path", "([^/]*/[^/]*)$", 1))).alias("path"))


def _listed(spark, sf):
    files = table(spark, sf, "part").select(F.concat(F.lit("/in/"), F.when(C("p_partkey") % 9 == 0, "thumb_").otherwise("IMG"), C("p_partkey"), F.when(C("p_partkey") % 13 == 0, "-thumbnail").otherwise(""), F.lit(".JPG")).alias("path"), C("p_partkey").alias("bytes"))
    return readers.listed(files)


def _tasks(spark, sf):
    removed = table(spark, sf, "orders").where("o_orderkey % 10 = 3").select(F.concat(F.lit("t"), C("o_orderkey")).alias("id"))
    return readers.task_records(_view(spark, sf, TASKS), removed).select("id", "phase", C("newest").cast("long").alias("newest"))


def _pages(spark, sf):
    """The pages table as the listing of a device, 20 pictures a page, read page by page."""
    path, rows = _folder(spark), view(spark, sf, ALBUM)
    item = F.to_json(F.array_sort(F.collect_list(F.struct("place", "filePath", "fileName", "fileSize", "modificationTime"))))
    rows.groupBy("page").agg(item.alias("value")).write.partitionBy("page").text(path)
    got = paged.newest(paged.album(spark, path + "/page={page}", pages=rows.agg(F.max("page")).first()[0] + 1))
    return got.select("path", "name", "bytes", F.unix_seconds("taken").alias("taken"), "page")


def _spooled(spark, sf):
    """Rows of the bands that a region's nations name."""
    path = _folder(spark)
    paged.spool(view(spark, sf, SPOOL), path)
    wanted = table(spark, sf, "nation").where("n_regionkey = 1").select(C("n_nationkey").alias("band"))
    return paged.bands(spark, path, wanted).groupBy("band", "row").agg(F.count("*").alias("samples"), F.sum("v").cast("long").alias("v"))


def _sizes(spark, sf):
    p = table(spark, sf, "part")
    number = lambda c, n: F.lpad(F.hex(c.cast("long")), 2 * n, "0")
    w, h = C("p_partkey"), C("p_size")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(w, 4), number(h, 4))
    jpeg = F.concat(F.lit("FFD8FFE00004ABCDFFC40003FF"), F.when(w % 2 == 0, "FFC0").otherwise("FFC2"), F.lit("000B08"), number(h, 2), number(w, 2))
    # a JPEG has 16 bits for its width
    hexed = F.when(w % 3 == 2, "00FF00FF").when((w % 3 == 0) | (w > WIDEST), png).otherwise(jpeg)
    width, height = readers.picture_size(F.unhex(hexed))
    return p.select("p_partkey", width.alias("width"), height.alias("height"))


def _photos(spark, sf):
    """A JPEG for each part, in both byte orders, with its fields behind 70 other segments; some with broken offsets. Parts too wide for a JPEG are PNGs."""
    p = table(spark, sf, "part")
    big = C("p_partkey") % 2 == 0

    def number(v, n):
        h = F.lpad(F.hex((F.lit(v) if isinstance(v, int) else v).cast("long")), 2 * n, "0")
        return F.when(big, h).otherwise(F.concat(*[F.substring(h, 2 * k + 1, 2) for k in reversed(range(n))]))

    text = lambda v: F.hex(F.encode(v, "utf-8"))
    entry = lambda tag, kind, n, value: [number(tag, 2), number(kind, 2), number(n, 4), value]
    offset = F.when(C("p_partkey") % 10 == 3, 5000).otherwise(58)
    parts = [F.lit("457869660000"), F.when(big, "4D4D").otherwise("4949"), number(42, 2), number(8, 4), number(3, 2)]
    parts += entry(0x010F, 2, 8, number(50, 4)) + entry(0x0112, 3, 1, F.concat(number(1 + C("p_partkey") % 9, 2), F.lit("0000"))) + entry(0x8769, 4, 1, number(offset, 4)) + [number(0, 4)]
    parts += [text(F.concat(F.lit("Maker"), F.lpad(C("p_size").cast("string"), 2, "0"))), F.lit("00"), number(2, 2)] + entry(0x9003, 2, 20, number(88, 4)) + entry(0x920A, 5, 1, number(108, 4)) + [number(0, 4)]
    parts += [text(F.concat(F.lit("2024:01:"), F.lpad((1 + C("p_partkey") % 28).cast("string"), 2, "0"), F.lit(" 10:20:30"))), F.lit("00"), number(C("p_size"), 4), number(10, 4)]
    plain = lambda v, n: F.lpad(F.hex(v.cast("long")), 2 * n, "0")
    size = F.concat(F.lit("FFC0000B08"), plain(C("p_size"), 2), plain(C("p_partkey"), 2), F.lit("01011100"))
    jpeg = F.concat(F.lit("FFD8"), F.lit("FFFE0002" * 70), F.lit("FFE1007C"), *parts, size)

    def chunk(length, name, *content):
        body = F.concat(F.lit(name.encode().hex()), *content)
        return F.concat(plain(F.lit(length), 4), body, plain(F.crc32(F.unhex(body)), 4))

    header = chunk(13, "IHDR", plain(C("p_partkey"), 4), plain(C("p_size"), 4), F.lit("0800000000"))
    other = f"00000000{b'tEXt'.hex()}{zlib.crc32(b'tEXt'):08X}" * 70
    png = F.concat(F.lit("89504E470D0A1A0A"), header, F.lit(other), chunk(116, "eXIf", *parts[1:]))
    return photos.metadata(p.select("p_partkey", F.unhex(F.when(C("p_partkey") > WIDEST, png).otherwise(jpeg)).alias("content")), ["p_partkey"]).withColumn("taken", F.unix_seconds("taken"))


def _written_tiles(spark, sf):
    """A job that was stopped, tiles that were damaged since, and a second job with other values: it renders what is missing or damaged."""
    path, pixels = _folder(spark), view(spark, sf, PIXELS)
    writers.write_tiles(pixels.where("x < 32"), path, 16)
    tiles = writers.tile_store(spark, path)
    tiles.append(tiles.rows().where("tile_row % 2 = 0 and tile_column = 1").withColumn("pixels", F.slice("pixels", 1, 3)))
    writers.write_tiles(pixels.withColumn("v", -C("v")), path, 16)
    return tiles.rows().select("tile_row", "tile_column", F.explode("pixels").alias("p")).select("tile_row", "tile_column", "p.x", "p.y", "p.v")


def _written_levels(spark, sf):
    pixels = view(spark, sf, PIXELS)
    got = writers.write_pyramid(pixels, _folder(spark), SIDE, pixels.agg(F.max("y")).first()[0] + 1)
    return got.select(C("level").cast("int").alias("level"), "x", "y", F.round("v", 4).alias("v"))


def _published(spark, sf):
    path, rows = _folder(spark), table(spark, sf, "customer").select("c_name", C("c_nationkey").alias("nation"))
    writers.write_record(rows.where("nation < 5"), f"{path}/record")
    writers.write_record(rows, f"{path}/record")
    writers.publish(rows, f"{path}/result")
    try:
        writers.publish(rows.limit(0), f"{path}/result")
    except Exception as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    keyed = rows.select(F.sha2("c_name", 256).alias("key"), "c_name", "nation")
    writers.cache(keyed.where("nation % 2 = 0"), f"{path}/cache", "key")
    writers.cache(keyed.withColumn("nation", -C("nation")), f"{path}/cache", "key")
    out = [writers.read_record(spark, f"{path}/record"), spark.read.parquet(f"{path}/result"), writers.cached(spark, f"{path}/cache", "key")]
    kinds = [df.select(F.lit(kind).alias("kind"), "c_name", C("nation").cast("int").alias("nation")) for kind, df in zip(("record", "result", "cache"), out)]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


QUERIES = {
    "requests_parsed": _parsed,
    "requests_refused": lambda spark, sf: readers.request_faults(readers.requests(_view(spark, sf, REQUESTS)), "o_orderkey"),
    "tsv_manifest": _tsv,
    "json_manifest": _json,
    "folder_listing": _listed,
    "task_library": _tasks,
    "album_pages": _pages,
    "spooled_bands": _spooled,
    "picture_sizes": _sizes,
    "photo_metadata": _photos,
    "tiles_written": _written_tiles,
    "levels_written": _written_levels,
    "published_once": _published,
}


def _levels_sql() -> str:
    """Levels up to 2 ** 14 rows."""
    ctes = [f"l0 as (select x, y, v::double as v from ({duck(PIXELS)}))"] + [f"l{k} as (select x // 2 as x, y // 2 as y, avg(v) as v from l{k - 1} group by 1, 2)" for k in range(1, 15)]
    each = " union all ".join(f"select {k} as level, x, y, round(v, 4) as v from l{k}" for k in range(15))
    return f"with {', '.join(ctes)} select level::int as level, x, y, v from ({each}) where level <= (select ceil(log2(greatest({SIDE}, max(y) + 1))) from l0)"


_KEY = "array_to_string(list_transform(regexp_extract_all(lower(name), '[0-9]+|[^0-9]+'), lambda p: case when regexp_matches(p, '^[0-9]') then lpad(ltrim(p, '0'), 20, '0') else p end), chr(1))"
ORACLES = {
    "requests_parsed": """select o_orderkey, case when k = 0 then null when k = 1 then 0 when k = 5 then 2 else 1 end::int as rows, case when k = 0 then null when k in (1, 3) then 2 else 1 end::int as columns,
  case when k = 0 then null when k in (6, 7) then o_custkey % 9 else 1 end::int as workers, case when k = 0 then null when k = 3 then 0.5 else 0.3 end::double as "overlapX", case when k > 0 then 'snake' end as traversal, case k when 0 then null when 1 then null when 3 then 2 when 5 then 0 else 1 end::int as tiles
from (select *, o_orderkey % 8 as k from orders)""",
    "requests_refused": "select o_orderkey, case when o_orderkey % 8 < 6 then ['malformed', 'shape', 'intrinsics', 'repeated-cell', 'tile', 'tile-count'][o_orderkey % 8 + 1] else 'intrinsics' end as fault from orders where o_orderkey % 8 < 6 or o_custkey = 0",
    "tsv_manifest": 'select (p_partkey % 7)::int as "row", p_size::int as "column", p_brand as path from part',
    "json_manifest": """select 5 as rows, 5 as columns, (n_nationkey % 5)::int as "row", (n_nationkey // 5)::int as "column", case when n_nationkey % 2 = 0 then '/x/' || n_name else 'beside/tiles/' || n_name end as path from nation""",
    "folder_listing": f"""with f as (select case when p_partkey % 9 = 0 then 'thumb_' else 'IMG' end || p_partkey || case when p_partkey % 13 = 0 then '-thumbnail' else '' end || '.JPG' as name, p_partkey as bytes from part)
select '/in/' || name as path, name, bytes, {_KEY} as key from f where not contains(name, 'thumb')""",
    "task_library": """with t as (select 't' || o_orderkey as id, case when o_custkey % 3 = 0 then 'interrupted' else 'done' end as phase, o_custkey % 28 as d from orders where o_orderkey % 11 > 0 and o_custkey % 4 in (1, 2) and o_orderkey % 10 <> 3)
select id, phase, row_number() over (order by d desc, id) as newest from t""",
    "album_pages": f"""with a as ({duck(ALBUM)}) select filePath as path, last(fileName order by page, place) as name, last(fileSize order by page, place)::bigint as bytes,
  nullif(arg_max(coalesce(modificationTime, -1), page * 100 + place), -1)::bigint as taken, max(page) as page from a group by 1""",
    "spooled_bands": """select l_suppkey % 25 as band, l_partkey % 40 as "row", count(*) as samples, sum(l_quantity)::bigint as v from lineitem join nation on n_nationkey = l_suppkey % 25 where n_regionkey = 1 group by 1, 2""",
    "picture_sizes": "select p_partkey, case when p_partkey % 3 < 2 then p_partkey end::int as width, case when p_partkey % 3 < 2 then p_size end::int as height from part",
    "photo_metadata": """select p_partkey, p_partkey::int as width, p_size::int as height, case when p_partkey % 9 < 8 then (1 + p_partkey % 9)::int end as orientation, 'Maker' || lpad(p_size::varchar, 2, '0') as make, null::varchar as model, null::varchar as lens,
  case when p_partkey % 10 <> 3 then p_size / 10.0::double end as focal_mm, case when p_partkey % 10 <> 3 then epoch(timestamp '2024-01-01 10:20:30' + to_days((p_partkey % 28)::int))::bigint end as taken from part""",
    "tiles_written": f"""with p as ({duck(PIXELS)}) select (y // 16)::int as tile_row, (x // 16)::int as tile_column, x, y, case when x >= 32 or (x // 16 = 1 and y // 16 % 2 = 0) then -v else v end as v from p""",
    "levels_written": _levels_sql(),
    "published_once": """select kind, c_name, case when kind = 'cache' and c_nationkey % 2 = 1 then -c_nationkey else c_nationkey end::int as nation from customer, (values ('record'), ('result'), ('cache')) k(kind)""",
}
