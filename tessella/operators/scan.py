"""Scan plans from requests, and the estimates that a job is admitted by."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The columns of a request beside its key; grid_rows and grid_columns are null for an automatic grid.
REQUEST = [
    "pan", "tilt", "zoom", "fov_x", "fov_y", "mech_pan", "mech_tilt", "target_x", "target_y", "target_mech_pan", "target_mech_tilt",
    "roi_left", "roi_top", "roi_right", "roi_bottom", "overlap_x", "overlap_y", "grid_rows", "grid_columns", "traversal", "bytes_per_tile", "maximum_tiles",
]


def finite(*names: str) -> Column:
    """Whether none of the columns is null, NaN or infinite."""
    out = F.lit(True)
    for n in names:
        out = out & F.coalesce(~F.isnan(n) & (F.abs(F.col(n)) < float("inf")), F.lit(False))
    return out


def required(span: Column, tile: Column, step: Column) -> Column:
    """Tiles that cover a span when each adds a step to the one before."""
    return (F.ceil(F.greatest(span - tile, F.lit(0.0)) / step) + 1).cast("long")


def sized(requests: DataFrame) -> DataFrame:
    """requests with step_x, step_y, rows, columns and `error`: the first reason to refuse, or null."""
    c = F.col
    steps = requests.withColumns({"step_x": c("target_x") * (1 - c("overlap_x")), "step_y": c("target_y") * (1 - c("overlap_y"))})
    roi = finite("roi_left", "roi_top", "roi_right", "roi_bottom") & (c("roi_left") >= 0) & (c("roi_top") >= 0) & (c("roi_right") <= 1) & (c("roi_bottom") <= 1) & (c("roi_right") > c("roi_left")) & (c("roi_bottom") > c("roi_top"))
    fov = F.lit(True)
    for n in ("fov_x", "fov_y", "mech_pan", "mech_tilt", "target_x", "target_y", "target_mech_pan", "target_mech_tilt"):
        fov = fov & finite(n) & (c(n) > 0)
    pose = finite("pan", "tilt", "zoom") & c("pan").between(-1, 1) & c("tilt").between(-1, 1) & (c("zoom") > 0)
    overlap = finite("overlap_x", "overlap_y") & (c("overlap_x") >= 0) & (c("overlap_x") < 1) & (c("overlap_y") >= 0) & (c("overlap_y") < 1)
    same = (c("mech_pan") == c("target_mech_pan")) & (c("mech_tilt") == c("target_mech_tilt"))
    invalid = F.when(~roi, "roi").when(~fov, "fov").when(~same, "mechanical").when(~pose, "pose").when(~overlap, "overlap")
    invalid = invalid.when((c("bytes_per_tile") <= 0) | (c("maximum_tiles") <= 0), "limits").when((c("grid_rows") <= 0) | (c("grid_columns") <= 0), "grid")
    checked = steps.withColumn("error", invalid)
    fine = c("error").isNull()
    need_x = F.when(fine, required((c("roi_right") - c("roi_left")) * c("fov_x"), c("target_x"), c("step_x")))
    need_y = F.when(fine, required((c("roi_bottom") - c("roi_top")) * c("fov_y"), c("target_y"), c("step_y")))
    counted = checked.withColumns({"need_rows": need_y, "need_columns": need_x}).withColumns({"rows": F.coalesce("grid_rows", "need_rows").cast("long"), "columns": F.coalesce("grid_columns", "need_columns").cast("long")})
    small = F.when((c("rows") < c("need_rows")) | (c("columns") < c("need_columns")), "grid-too-small")
    # the product is taken as a double: it may be beyond a bigint
    large = F.when(c("rows").cast("double") * c("columns") > c("maximum_tiles"), "resource-limit")
    counted = counted.withColumn("error", F.coalesce("error", small, large))
    # tile centres are even steps around the middle, so the corners decide whether all are in range
    mid_pan = c("pan") + ((c("roi_left") + c("roi_right")) / 2 - 0.5) * c("fov_x") * 2 / c("mech_pan")
    mid_tilt = c("tilt") - ((c("roi_top") + c("roi_bottom")) / 2 - 0.5) * c("fov_y") * 2 / c("mech_tilt")
    placed = counted.withColumns({"mid_pan": mid_pan, "mid_tilt": mid_tilt, "nx": c("step_x") * 2 / c("target_mech_pan"), "ny": c("step_y") * 2 / c("target_mech_tilt")})
    far = (F.abs("mid_pan") + (c("columns") - 1) / 2 * c("nx") > 1) | (F.abs("mid_tilt") + (c("rows") - 1) / 2 * c("ny") > 1)
    return placed.withColumn("error", F.coalesce("error", F.when(far, "mechanical-range")))


def plan(requests: DataFrame, key: str) -> DataFrame:
    """key, sequence, row, column, pan, tilt of the tiles of every request that is not refused."""
    c = F.col
    tiles = sized(requests).where("error is null").withColumn("sequence", F.explode(F.sequence(F.lit(0).cast("long"), c("rows") * c("columns") - 1)))
    by_column = c("traversal") == "column"
    row = F.when(by_column, c("sequence") % c("rows")).otherwise(F.expr("sequence div columns"))
    column = F.when(by_column, F.expr("sequence div rows")).otherwise(c("sequence") % c("columns"))
    tiles = tiles.withColumns({"row": row, "column": column})
    tiles = tiles.withColumn("column", F.when((c("traversal") == "snake") & (c("row") % 2 == 1), c("columns") - 1 - c("column")).otherwise(c("column")))
    return tiles.select(key, "sequence", "row", "column", (c("mid_pan") + (c("column") - (c("columns") - 1) / 2) * c("nx")).alias("pan"), (c("mid_tilt") + ((c("rows") - 1) / 2 - c("row")) * c("ny")).alias("tilt"))


def output_size(rows: Column, columns: Column, fov_degrees: Column, width: Column, height: Column, overlap_x: Column, overlap_y: Column) -> tuple[Column, Column]:
    """Width and height of the stitched picture, or nulls where the input makes none."""
    fov = fov_degrees * (math.pi / 180)
    vertical = 2 * F.atan(F.tan(fov / 2) * height / width)
    focal = width / (2 * F.tan(fov / 2))
    fine = (rows >= 1) & (columns >= 1) & (fov_degrees > 1) & (fov_degrees < 179) & (overlap_x >= 0) & (overlap_x < 1) & (overlap_y >= 0) & (overlap_y < 1) & (width >= 1) & (height >= 1)
    wide, high = width + (columns - 1) * focal * fov * (1 - overlap_x), height + (rows - 1) * focal * vertical * (1 - overlap_y)
    return F.when(fine, F.ceil(wide)), F.when(fine, F.ceil(high))


def job_budget(total_mib: Column, jobs: Column, least: int = 128, most: int = 128 * 1024) -> Column:
    """MiB for each of some jobs that run at once: at most 8, and no more than have `least` each."""
    whole = lambda a, b: F.floor(a / b)
    clamp = lambda x, lo, hi: F.greatest(F.least(x, hi), lo)
    slots = clamp(jobs, F.lit(1), clamp(whole(total_mib, F.lit(least)), F.lit(1), F.lit(8)))
    return clamp(whole(total_mib, slots), F.lit(least), F.lit(most)).cast("long")


def safe_memory(total_mib: Column, available_mib: Column, mobile: Column, least: int = 128, most: int = 128 * 1024) -> Column:
    """MiB that all jobs may take: a third of what is available on a phone, else three quarters; a fixed value where the reading makes no sense."""
    valid = (total_mib > 0) & (available_mib > 0) & (available_mib <= total_mib)
    part = F.floor(F.when(mobile, available_mib / 3).otherwise(available_mib * 3 / 4))
    return F.when(F.coalesce(valid, F.lit(False)), F.greatest(F.least(part, F.lit(most)), F.lit(least))).otherwise(F.when(mobile, least).otherwise(512)).cast("long")
