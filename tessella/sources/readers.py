"""Requests, manifests, task records and folders as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import natural_key

TILE = "struct<row:int,column:int,path:string,forceGrid:boolean>"
REQUEST = f"rows int, columns int, fx double, fy double, cx double, cy double, sourceWidth int, sourceHeight int, workers int, overlapX double, overlapY double, traversal string, tiles array<{TILE}>"
# What a request means where it says nothing.
DEFAULTS = {"workers": 1, "overlapX": 0.3, "overlapY": 0.3, "traversal": "snake"}
TASK = "id string, schemaVersion int, name string, createdAt timestamp, phase string, photos array<struct<originalName:string,storedPath:string,sha256:string,width:int,height:int>>"


def requests(rows: DataFrame, body: str = "body", fail: bool = False) -> DataFrame:
    """rows with the struct `request` of a JSON text, defaults filled in; a malformed one gives null, or fails the job."""
    parsed = F.from_json(body, REQUEST, {"mode": "FAILFAST" if fail else "PERMISSIVE"})
    filled = rows.withColumn("request", parsed)
    for name, value in DEFAULTS.items():
        filled = filled.withColumn("request", F.col("request").withField(name, F.coalesce(F.col(f"request.{name}"), F.lit(value))))
    known = F.col("request.rows").isNotNull() & F.col("request.columns").isNotNull()
    return filled.withColumn("request", F.when(known, F.col("request")))


def request_faults(rows: DataFrame, key: str) -> DataFrame:
    """key, fault of parsed requests that can't be run: the quarantine; the first rule that one breaks."""
    r = lambda n: F.col(f"request.{n}")
    fine = lambda n: F.coalesce(~F.isnan(r(n)) & (F.abs(r(n)) < float("inf")), F.lit(False))
    cells = F.transform(r("tiles"), lambda t: F.struct(t.row, t.column))
    inside = F.forall(r("tiles"), lambda t: (t.row >= 0) & (t.column >= 0) & (t.row < r("rows")) & (t.column < r("columns")) & F.coalesce(F.length(t.path) > 0, F.lit(False)))
    fault = F.when(F.col("request").isNull(), "malformed").when((r("rows") < 1) | (r("columns") < 1), "shape").when(~(fine("fx") & fine("fy") & fine("cx") & fine("cy")) | (r("fx") <= 0) | (r("fy") <= 0), "intrinsics")
    fault = fault.when(F.coalesce(F.size(r("tiles")), F.lit(0)) != r("rows") * r("columns"), "tile-count").when(~inside, "tile").when(F.size(F.array_distinct(cells)) != F.size(cells), "repeated-cell")
    return rows.withColumn("fault", fault).where("fault is not null").select(key, "fault")


def tsv_manifest(spark: SparkSession, path: str) -> DataFrame:
    """row, column, path of a tab-separated manifest; blank lines and those that begin with # are left out."""
    return spark.read.csv(path, sep="\t", comment="#", schema="row int, column int, path string", mode="FAILFAST").where("row is not null")


def json_manifest(spark: SparkSession, path: str) -> DataFrame:
    """manifest, rows, columns, row, column, path of JSON manifests; a path is relative to its manifest's folder."""
    schema = "rows int, columns int, overlapX double, overlapY double, tiles array<struct<row:int,column:int,path:string>>"
    raw = spark.read.json(path, schema=schema, multiLine=True, mode="FAILFAST").withColumn("manifest", F.col("_metadata.file_path"))
    tile = raw.select("manifest", "rows", "columns", F.explode("tiles").alias("t"))
    folder = F.regexp_replace("manifest", "[^/]*$", "")
    return tile.select("manifest", "rows", "columns", "t.row", "t.column", F.when(F.col("t.path").startswith("/"), F.col("t.path")).otherwise(F.concat(folder, F.col("t.path"))).alias("path"))


def folder(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png,JPG,JPEG,PNG}") -> DataFrame:
    """path, name, bytes, place of the pictures of a folder in natural order, thumbnails left out; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.col("length").alias("bytes"))
    return listed(files)


def listed(files: DataFrame) -> DataFrame:
    """path, name, bytes, key: what is no thumbnail, with the key by which it sorts."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("name", name).where(~F.lower("name").rlike(r"(^|[._-])thumb(nail)?s?([._-]|$)")).select("path", "name", "bytes", natural_key(F.col("name")).alias("key"))


def task_records(lines: DataFrame, removed: DataFrame, body: str = "body") -> DataFrame:
    """Task records from JSON texts: those that can be read, are of schema 1 or 2 and are not removed (id), with `newest`, 1 for the last created."""
    from pyspark.sql import Window as W

    parsed = lines.select(F.from_json(body, TASK, {"mode": "PERMISSIVE"}).alias("t")).select("t.*")
    live = parsed.where("id is not null and schemaVersion in (1, 2)").join(removed.select("id"), "id", "left_anti")
    interrupted = F.when(F.col("phase").isin("running", "paused"), "interrupted").otherwise(F.col("phase"))
    # one order over all records: a library is what one user has
    return live.withColumn("phase", interrupted).withColumn("newest", F.row_number().over(W.orderBy(F.desc_nulls_last("createdAt"), "id")))


def picture_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG's first 24 bytes, or a JPEG's first frame header within 2 MiB; nulls for others."""
    number = lambda a, n: F.conv(F.substring(F.hex(content), 2 * a + 1, 2 * n), 16, 10).cast("int")
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    head = F.hex(F.substring(content, 1, 2 << 20))
    # segments before the frame header are skipped by their lengths, not searched through
    frame = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)),
        F.struct(F.lit(2).cast("long").alias("at"), F.lit(False).alias("done")),
        lambda s, _: F.when(s.done, s).otherwise(
            F.when(F.substring(head, s.at * 2 + 1, F.lit(4)).rlike("^FFC[0-35-79-BD-F]$"), F.struct(s.at.alias("at"), F.lit(True).alias("done"))).otherwise(
                F.struct((s.at + 2 + F.coalesce(F.conv(F.substring(head, s.at * 2 + 5, F.lit(4)), 16, 10).cast("long"), F.lit(0))).alias("at"), F.lit(False).alias("done"))
            )
        ),
    )
    jpeg = (F.substring(head, 1, 4) == "FFD8") & frame["done"]
    short = lambda k: F.conv(F.substring(head, (frame["at"] + k) * 2 + 1, F.lit(4)), 16, 10).cast("int")
    return F.when(png, number(16, 4)).when(jpeg, short(7)), F.when(png, number(20, 4)).when(jpeg, short(5))
