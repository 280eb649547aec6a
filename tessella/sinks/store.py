"""Stores whose content changes as a whole: tiles, records and caches that a killed job leaves as they were.

A store is a folder of versions and a small file that names those that count. A job writes its rows as a new
version, by Spark's committer, and then replaces that file by a rename, which is one step of the file system. A reader
takes the versions that the file names, so it sees all of a job or nothing of it. What a killed job
has written is in no list; `swept` deletes it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import drop_folder

CURRENT = "_current"


class Store:
    """One folder of Parquet or JSON; `key` tells its rows apart."""

    def __init__(self, spark: SparkSession, folder: str, key: list[str], form: str = "parquet"):
        self.spark, self.folder, self.key, self.form = spark, folder.rstrip("/"), key, form
        jvm = spark.sparkContext._jvm
        self._path, self._fs = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """The versions that count, the oldest first: one for each job that has ended, but those that were merged."""
        at = self._path(f"{self.folder}/{CURRENT}")
        if not self._files.exists(at):
            return []
        stream = self._files.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def rows(self) -> DataFrame | None:
        """What the store holds, or None: of rows with one key those of the last version."""
        names = self.versions()
        if not names:
            return None
        parts = [self.spark.read.format(self.form).load(f"{self.folder}/{v}").withColumn("_version", F.lit(k)) for k, v in enumerate(names)]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part, allowMissingColumns=True)
        if len(parts) > 1:
            out = out.withColumn("_last", F.max("_version").over(W.partitionBy(*self.key))).where("_version = _last").drop("_last")
        return out.drop("_version")

    def staged(self, rows: DataFrame) -> str:
        """Rows as a version that does not count yet."""
        version = f"v-{uuid.uuid4().hex}"
        rows.write.format(self.form).save(f"{self.folder}/{version}")
        return version

    def count(self, versions: list[str]) -> None:
        """These versions and no others count, from one moment on."""
        fresh = self._path(f"{self.folder}/_next-{uuid.uuid4().hex}")
        stream = self._files.create(fresh, True)
        stream.write(bytearray(json.dumps(versions).encode()))
        stream.hsync()
        stream.close()
        context = self._fs.FileContext.getFileContext(self._path(self.folder).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        rename[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, self._path(f"{self.folder}/{CURRENT}"), rename)

    def append(self, rows: DataFrame) -> None:
        version = self.staged(rows)
        self.count([*self.versions(), version])

    def replace(self, rows: DataFrame) -> None:
        """Rows instead of all that the store holds; rows may be made from them."""
        self.count([self.staged(rows)])

    def add_missing(self, rows: DataFrame) -> None:
        """Rows whose key the store lacks: one job, whatever the number of keys. Of rows with one key the first in order of all columns is kept."""
        order = F.row_number().over(W.partitionBy(*self.key).orderBy(*[c for c in rows.columns if c not in self.key]))
        once = rows.withColumn("_n", order).where("_n = 1").drop("_n") if len(rows.columns) > len(self.key) else rows.distinct()
        held = self.rows()
        self.append(once if held is None else once.join(held.select(*self.key), self.key, "left_anti"))

    def swept(self) -> int:
        """Deletes versions that don't count: what killed jobs left and what was replaced. Not while another job writes."""
        keep, gone = {CURRENT, *self.versions()}, 0
        for s in self._files.listStatus(self._path(self.folder)):
            name = s.getPath().getName()
            if name not in keep and name.startswith(("v-", "_next-")):
                drop_folder(self.spark, f"{self.folder}/{name}")
                gone += 1
        return gone


def tile_digest() -> F.Column:
    """What a tile's pixels must still hash to when they are read."""
    return F.sha2(F.to_json(F.struct("tile_row", "tile_column", "pixels")), 256)


def damaged(tiles: DataFrame) -> DataFrame:
    """tile_row, tile_column of stored tiles whose pixels are not those that were written, or not as many as their size says."""
    whole = (F.col("sha256") == tile_digest()) & (F.size("pixels") == F.col("pixel_count"))
    return tiles.where(~F.coalesce(whole, F.lit(False))).select("tile_row", "tile_column")


def pending(pixels: DataFrame, store: Store, tile: int = 512) -> DataFrame:
    """Pixels (x, y, v) with tile_row and tile_column, of the tiles that the store lacks or holds damaged."""
    placed = pixels.withColumns({"tile_row": F.expr(f"y div {tile}").cast("int"), "tile_column": F.expr(f"x div {tile}").cast("int")})
    held = store.rows()
    if held is None:
        return placed
    done = held.select("tile_row", "tile_column").join(damaged(held), ["tile_row", "tile_column"], "left_anti")
    return placed.join(done, ["tile_row", "tile_column"], "left_anti")


def render(pixels: DataFrame, store: Store, tile: int = 512) -> None:
    """Level-0 tiles that the store lacks, one row each with its pixels in row order and their digest; whole tiles stay as they are."""
    grouped = pending(pixels, store, tile).groupBy("tile_row", "tile_column").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("pixels"))
    store.append(grouped.withColumns({"pixel_count": F.size("pixels"), "sha256": tile_digest()}))
