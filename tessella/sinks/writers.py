"""Tiles, pyramid levels, records, results and caches as tables that change as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blend
from . import store
from .store import Store

TILE_KEY = ["tile_row", "tile_column"]


def tile_store(spark: SparkSession, folder: str) -> Store:
    return Store(spark, folder, TILE_KEY)


def pending_tiles(pixels: DataFrame, folder: str, tile: int = 512) -> DataFrame:
    """Pixels (x, y, v) with tile_row and tile_column, of the tiles that the folder lacks or holds damaged."""
    return store.pending(pixels, tile_store(pixels.sparkSession, folder), tile)


def write_tiles(pixels: DataFrame, folder: str, tile: int = 512) -> None:
    """Level-0 tiles, one row each with its pixels in row order; whole tiles that are there already are left alone."""
    store.render(pixels, tile_store(pixels.sparkSession, folder), tile)


def write_pyramid(pixels: DataFrame, folder: str, width: int, height: int) -> DataFrame:
    """All levels up to 1 x 1 as a table partitioned by level; every level is made from the one before as it is read back."""
    spark, level = pixels.sparkSession, 0
    now = pixels.select("x", "y", F.col("v").cast("double").alias("v"))
    while True:
        now.write.mode("errorifexists").parquet(f"{folder}/level={level}")
        if width <= 1 and height <= 1:
            return spark.read.parquet(folder)
        now = blend.halve(spark.read.schema("x long, y long, v double").parquet(f"{folder}/level={level}"))
        width, height, level = -(-width // 2), -(-height // 2), level + 1


def write_record(record: DataFrame, folder: str) -> None:
    """A small record as one JSON file; the one before counts until the new one is whole."""
    Store(record.sparkSession, folder, [], "json").replace(record.coalesce(1))


def read_record(spark: SparkSession, folder: str) -> DataFrame | None:
    return Store(spark, folder, [], "json").rows()


def publish(result: DataFrame, folder: str) -> None:
    """A result under a name that must be free."""
    result.write.mode("errorifexists").parquet(folder)


def cache(rows: DataFrame, folder: str, key: str) -> None:
    """Rows by content, all keys in one job: a key that the cache has is left as it is."""
    Store(rows.sparkSession, folder, [key]).add_missing(rows)


def cached(spark: SparkSession, folder: str, key: str) -> DataFrame | None:
    return Store(spark, folder, [key]).rows()
