"""Blending and ownership of overlapping samples of a pixel, and multi-resolution roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written


def weighted(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, blended value, samples with weight and the share of samples that have one."""
    on = F.col(weight) > 0
    return df.groupBy(*keys).agg(
        F.sum(F.when(on, F.col(value) * F.col(weight))).alias("vw"), F.sum(F.when(on, F.col(weight))).alias("w"), F.count_if(on).alias("samples"), (F.count_if(on) / F.count("*")).alias("covered")
    ).select(*keys, (F.col("vw") / F.col("w")).alias("blended"), "samples", "covered")


def softmax(df: DataFrame, keys: list[str], value: str, score: str, sharpness: float = 8.0) -> DataFrame:
    """Weights exp(sharpness * (score - best)) with the exponent held in [-80, 0]; the best is a window maximum."""
    best = F.max(score).over(W.partitionBy(*keys))
    weight = F.exp(F.greatest(F.lit(-80.0), F.least(F.lit(0.0), sharpness * (F.col(score) - best))))
    return df.withColumn("_w", weight).groupBy(*keys).agg((F.sum(F.col(value) * F.col("_w")) / F.sum("_w")).alias("blended"))


def top(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with `rank`: planned as a group limit before the shuffle."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def best_other(df: DataFrame, keys: list[str], source: str, score: str, *evidence: str, support: str | None = None, own: bool = False) -> DataFrame:
    """For each source of a pixel the best score among its other sources, as `peer`, and peer_<name> of that one for
    each name in evidence, times its support where a support is named; with `own` also its own evidence. A source's best sample stands for it.

    Rows that are dealt by their keys stay where they are: sorts and windows, and no join.
    """
    rows = [score, *evidence, *([support] if support else [])]
    one = df.groupBy(*keys, source).agg(F.max(F.struct(*rows)).alias("_s")).withColumn("_v", F.col(f"_s.{score}"))
    pixel = W.partitionBy(*keys)
    at = lambda k, c: F.max(F.when(F.col("_rank") == k, F.col(c))).over(pixel)
    ranked = one.withColumn("_rank", F.row_number().over(pixel.orderBy(F.desc("_v"), F.asc(source))))
    two = ranked.withColumns({"_one": at(1, "_s"), "_two": at(2, "_s")})
    peer = F.when(F.col("_rank") == 1, F.col("_two")).otherwise(F.col("_one"))
    share = peer[support] if support else F.lit(1.0)
    mine = [F.col(f"_s.{e}").alias(e) for e in evidence] if own else []
    return two.select(*keys, source, F.col("_v").alias(score), peer[score].alias("peer"), *[(peer[e] * share).alias(f"peer_{e}") for e in evidence], *mine)


def suppression(peer_texture: Column, obstruction: Column, texture: Column, sharpness: Column, peer_sharpness: Column) -> Column:
    """How far a source that is blurred or obstructed beside a better peer is held back, 0 to 1."""
    ratio = F.when(peer_sharpness > 0, sharpness / peer_sharpness).otherwise(1.0)
    blur = smoothstep(10.0, 14.0, peer_texture) * smoothstep(15.0, 21.0, peer_sharpness) * (1 - smoothstep(0.55, 0.85, ratio))
    blocked = smoothstep(0.50, 0.80, obstruction) * (1 - smoothstep(3.3, 7.7, texture)) * smoothstep(6.0, 10.0, peer_texture)
    return F.least(F.greatest(F.when(peer_sharpness > 0, blur).otherwise(0.0), blocked), F.lit(1.0))


def adjusted(score: Column, peer: Column, strength: Column, least_side: Column, margin: float = 32.0) -> Column:
    """A score moved towards below its best peer's by the strength of suppression; as it is without a peer."""
    return F.when(peer.isNull() | (strength <= 0), score).otherwise(score - strength * F.greatest(score - peer + margin / F.greatest(least_side, F.lit(1)), F.lit(0.0)))


def linear(v: Column) -> Column:
    """sRGB value in 0..1 to linear light."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def encoded(v: Column) -> Column:
    """Linear light to sRGB value in 0..1."""
    return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)


def smoothstep(low: float, high: float, v: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / (high - low)))
    return t * t * (3 - 2 * t)


def raster(spark: SparkSession, width: int, height: int) -> DataFrame:
    """x, y, v: a synthetic grey raster. Its integer rule is that of the fixtures."""
    x, y = F.expr(f"id % {width}"), F.expr(f"id div {width}")
    v = (x * 17 + y * 11 + F.expr(f"((id % {width}) div 8) ^ ((id div {width}) div 8)") * 29).bitwiseAND(255)
    return spark.range(width * height).select(x.alias("x"), y.alias("y"), v.alias("v"))


def halve(pixels: DataFrame) -> DataFrame:
    """One level up: the mean of the pixels present in each 2 x 2 block."""
    return pixels.groupBy(F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y")).agg(F.avg("v").alias("v"))


def pyramid(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """All levels up to 1 x 1, `level` 0 being the pixels themselves; each is written and the next made from it."""
    level, now = 0, pixels.select("x", "y", F.col("v").cast("double").alias("v"))
    out = now.select(F.lit(0).alias("level"), "x", "y", "v")
    while width > 1 or height > 1:
        width, height, level = -(-width // 2), -(-height // 2), level + 1
        now = written(halve(now), "level")
        out = out.unionByName(now.select(F.lit(level).alias("level"), "x", "y", "v"))
    return out


def halve_premultiplied(pixels: DataFrame) -> DataFrame:
    """One level up in linear light with alpha: colours weigh by alpha, alpha is the mean of the pixels present."""
    a = F.col("a") / 255.0
    got = pixels.groupBy(F.expr("x div 2").alias("x"), F.expr("y div 2").alias("y")).agg(F.sum(a * linear(F.col("v") / 255.0)).alias("va"), F.sum(a).alias("sa"), F.avg("a").alias("a"))
    return got.select("x", "y", F.when(F.col("sa") > 0, 255 * encoded(F.col("va") / F.col("sa"))).otherwise(0.0).alias("v"), "a")


def level_of_detail(levels: DataFrame, views: DataFrame) -> DataFrame:
    """For each view (view, need_w, need_h) the smallest level (level, w, h) that suffices, else the largest."""
    fits = (F.col("w") >= F.col("need_w")) & (F.col("h") >= F.col("need_h"))
    both = views.crossJoin(F.broadcast(levels))  # a manifest has as many levels as its width has bits
    area = F.col("w") * F.col("h")
    return both.groupBy("view").agg(F.coalesce(F.min_by("level", F.when(fits, area)), F.max_by("level", area)).alias("level"))


def visible_tiles(views: DataFrame, tile: int) -> DataFrame:
    """view, tile_row, tile_column of all tiles that a view's half-open rectangle x0..x1, y0..y1 touches."""
    cols = F.sequence(F.expr(f"x0 div {tile}"), F.expr(f"(x1 - 1) div {tile}"))
    rows = F.sequence(F.expr(f"y0 div {tile}"), F.expr(f"(y1 - 1) div {tile}"))
    return views.where("x1 > x0 and y1 > y0").withColumn("tile_column", F.explode(cols)).withColumn("tile_row", F.explode(rows)).select("view", "tile_row", "tile_column")
