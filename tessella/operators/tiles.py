"""Output tiles: which sources and bands they need, in which order, and which windows an inference sees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import dealt, named, pieces


def tile_sources(tiles: DataFrame, sources: DataFrame, bin_size: float = 0.5) -> DataFrame:
    """(tile, source) whose cones meet: tiles and sources are (yaw, pitch, radius) in radians.

    Cones that are alike are compared once: pairs of distinct cones meet by bands of pitch, in the band of the tile, which the
    source's reach in pitch covers. Tiles and sources then join their cones in pieces, which are spread out last: nothing follows that handles each pair.
    """
    c, cone, other = F.col, ["yaw", "pitch", "radius"], ["_y", "_p", "_r"]
    tiles, sources = (d.select(n, *cone, named(*cone).alias("_cone")) for d, n in ((tiles, "tile"), (sources, "source")))
    widest = tiles.agg(F.max("radius").alias("_w"))  # one row
    reach = F.sequence(F.floor((c("_p") - c("_r") - c("_w")) / bin_size), F.floor((c("_p") + c("_r") + c("_w")) / bin_size))
    theirs = sources.select(*[c(a).alias(b) for a, b in zip(cone, other)], c("_cone").alias("_other"))
    far = theirs.distinct().crossJoin(F.broadcast(widest)).select(*other, "_other", F.explode(reach).alias("_band"))
    near = tiles.select(*cone, "_cone").distinct().withColumn("_band", F.floor(c("pitch") / bin_size))
    angle = F.sin("pitch") * F.sin("_p") + F.cos("pitch") * F.cos("_p") * F.cos(c("yaw") - c("_y"))
    meets = angle >= F.cos(F.least(c("radius") + c("_r"), F.lit(math.pi)))
    met = dealt(near, "_cone").join(far, "_band").where(meets).select("_cone", "_other")
    alike = pieces(sources.select("source", c("_cone").alias("_other")), ["_other"], "source", 1 << 12)
    alike = met.join(alike.withColumnRenamed("values", "_sources"), "_other").select("_cone", "_sources")
    own = pieces(dealt(tiles.select("tile", "_cone"), "_cone"), ["_cone"], "tile")
    # sorted and merged: what one piece of tiles makes is bounded by the sources of a tile
    both = own.join(dealt(alike, "_cone").hint("merge"), "_cone")
    return both.select(F.inline("values"), "_sources").select("tile", F.inline("_sources"))


def band_tiles(bands: DataFrame, tiles: DataFrame, height: int) -> DataFrame:
    """(band, tile, y0, y1) of the rows that tiles (tile, top, bottom; half-open) have in bands of `height` rows."""
    spans = tiles.withColumn("band", F.explode(F.sequence(F.expr(f"top div {height}"), F.expr(f"(bottom - 1) div {height}"))))
    return bands.join(spans, "band").select("band", "tile", F.greatest(F.col("top"), F.col("band") * height).alias("y0"), F.least(F.col("bottom"), (F.col("band") + 1) * height).alias("y1"))


def in_blocks(tiles: DataFrame, side: int = 4) -> DataFrame:
    """tiles (row, column) dealt and sorted so that tasks hold neighbouring blocks of side x side tiles."""
    block = [F.floor(F.col("row") / side), F.floor(F.col("column") / side)]
    return tiles.withColumns({"block_row": block[0], "block_column": block[1]}).repartitionByRange("block_row", "block_column").sortWithinPartitions("block_row", "block_column", "row", "column")


def ordered_rows(pixels: DataFrame, tile: int) -> DataFrame:
    """Pixels (x, y, v) as whole rows (y, values): each row is one group, dealt by ranges of tile rows, in order within a task."""
    rows = pixels.groupBy("y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p.v).alias("values"))
    return rows.withColumn("tile_row", F.expr(f"y div {tile}")).repartitionByRange("tile_row").sortWithinPartitions("tile_row", "y")


def source_ranks(sources: DataFrame, group: str, *order: str) -> DataFrame:
    """sources with a `source_rank` that does not depend on how they come: dense over all order columns."""
    return sources.withColumn("source_rank", F.dense_rank().over(W.partitionBy(group).orderBy(*order)))


def inference_windows(pictures: DataFrame, key: str, size: int = 512, stride: int = 256) -> DataFrame:
    """key, x, y of the windows over pictures (width, height): every stride, and one that ends with the picture."""

    def starts(extent: Column) -> Column:
        regular = F.filter(F.sequence(F.lit(0), F.greatest(extent - size, F.lit(0)), F.lit(stride)), lambda s: s + size < extent)
        return F.when(extent <= size, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(regular, F.array((extent - size).cast("int")))))

    return pictures.select(key, F.explode(starts(F.col("width"))).alias("x"), "height").select(key, "x", F.explode(starts(F.col("height"))).alias("y"))


def compare(a: DataFrame, b: DataFrame, channels: list[str]) -> DataFrame:
    """One row for pictures (x, y, channels): mean absolute difference of all channels, share of pixels that differ, greatest difference."""
    off = [F.abs(F.col(c) - F.col(f"_{c}")) for c in channels]
    both = a.join(b.select("x", "y", *[F.col(c).alias(f"_{c}") for c in channels]), ["x", "y"])
    return both.select(F.array(*off).alias("d")).agg((F.sum(F.aggregate("d", F.lit(0).cast("double"), lambda s, v: s + v)) / (F.count("*") * len(channels))).alias("mean_abs"), (F.count_if(F.exists("d", lambda v: v > 0)) / F.count("*")).alias("changed"), F.max(F.array_max("d")).alias("max_abs"))


def linear_light(df: DataFrame, keys: list[str], channels: list[str], weight: str) -> DataFrame:
    """keys and the channels (0 to 255) blended in linear light by weight, back in sRGB, with the sum of the weights."""
    from .blend import encoded, linear

    w = F.col(weight)
    sums = df.where(w > 0).groupBy(*keys).agg(F.sum(w).alias("weight"), *[F.sum(linear(F.col(c) / 255.0) * w).alias(c) for c in channels])
    return sums.select(*keys, *[(255 * encoded(F.col(c) / F.col("weight"))).alias(c) for c in channels], "weight")


def obstructions(cells: DataFrame, components: DataFrame, group: str, least: int = 24, contrast: float = 24.0) -> DataFrame:
    """group, component, cells, is_obstruction of dark, plain cells (id, row, column, luma, rows, columns) joined by components (id, component): enough of
    them, touching the picture's border, at least four thick, and darker than the median of the cells beside them by `contrast`."""
    c = F.col
    own = cells.join(components, [group, "id"])
    border = (c("row") == 0) | (c("column") == 0) | (c("row") == c("rows") - 1) | (c("column") == c("columns") - 1)
    size = own.groupBy(group, "component").agg(
        F.count("*").alias("cells"), F.bool_or(border).alias("border"), F.least(F.max("row") - F.min("row"), F.max("column") - F.min("column")).alias("span"), F.avg("luma").alias("mean"))
    shifts = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])).alias("d")
    beside = own.select(group, "component", (c("row")).alias("r0"), c("column").alias("c0"), shifts).select(group, "component", (c("r0") + c("d.i")).alias("row"), (c("c0") + c("d.j")).alias("column")).distinct()
    outer = beside.join(cells.select(group, "row", "column", "id", "luma"), [group, "row", "column"]).join(components.withColumnRenamed("component", "_c"), [group, "id"], "left").where("_c is null or _c <> component")
    edge = outer.groupBy(group, "component").agg(F.median("luma").alias("edge"))
    judged = size.join(edge, [group, "component"], "left")
    is_one = (c("cells") >= least) & c("border") & (c("span") >= 3) & (c("edge") - c("mean") >= contrast)
    return judged.select(group, "component", "cells", F.coalesce(is_one, F.lit(False)).alias("is_obstruction"))
