"""Albums that a device lists page by page, as a Spark data source; and spooled rows that are read band by band."""

from __future__ import annotations

import datetime
import json
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: What a listing gives for each picture, and the page that it stood on.
ALBUM = "page int, place int, path string, name string, bytes long, media int, taken timestamp"
SECONDS = 30


class Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


def fetched(url: str) -> bytes:
    """What is at an address: http and https over the network, all else a file or a folder of parts from a file system that Arrow knows."""
    if url.startswith(("http:", "https:")):
        with urllib.request.urlopen(url, timeout=SECONDS) as answer:
            return answer.read()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(url)
    parts = [path]
    if store.get_file_info(path).type == fs.FileType.Directory:  # as Spark writes a text
        parts = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and not f.base_name.startswith(("_", ".")))
    out = []
    for part in parts:
        with store.open_input_stream(part) as stream:
            out.append(stream.read())
    return b"".join(out)


class AlbumReader(DataSourceReader):
    """A partition for each page that is asked for."""

    def __init__(self, url: str, pages: range):
        self.url, self.pages = url, pages

    def partitions(self) -> Sequence[InputPartition]:
        return [Page(p) for p in self.pages]

    def read(self, partition: Page) -> Iterator[tuple]:
        listing = json.loads(fetched(self.url.format(page=partition.number)))
        if not isinstance(listing, list):
            raise ValueError(f"page {partition.number} is not a list")
        for place, item in enumerate(listing):
            path, name = (item.get(k) for k in ("filePath", "fileName")) if isinstance(item, dict) else (None, None)
            if not isinstance(path, str) or not isinstance(name, str):
                continue
            number = lambda k: int(item[k]) if isinstance(item.get(k), (int, float)) and not isinstance(item.get(k), bool) else None  # noqa: B023, E731
            seconds = number("modificationTime")
            taken = None if seconds is None else datetime.datetime.fromtimestamp(seconds, datetime.timezone.utc)
            yield partition.number, place, path, name, number("fileSize") or 0, number("mediaType"), taken


class AlbumSource(DataSource):
    """Format `album`: options url, with {page} where the number of a page goes from 0 on, and pages or both items and page_size;
    first and last, to fetch only pages from one to another.

    Pages are chosen by options and not by pushed filters: in Spark 4.1 two scans of one relation share the
    reader that the last filter left, so a union of two pages would be twice the same (a test holds the union).

    A page is fetched by one task and yields the same rows when the task is run again, so a retried task gives no second copy.
    A page that can't be fetched or is no list fails its task; an item that is no object or lacks its path or name has no row.
    """

    @classmethod
    def name(cls) -> str:
        return "album"

    def schema(self) -> str:
        return ALBUM

    def reader(self, schema: object) -> AlbumReader:
        url, pages = self.options.get("url"), self.options.get("pages")
        if not url:
            raise ValueError("the album source needs the option url")
        if pages is None:
            size = int(self.options.get("page_size", 50))
            if not 1 <= size <= 200:
                raise ValueError("page_size is 1 to 200")
            pages = -(-int(self.options.get("items", 0)) // size)
        first, last = int(self.options.get("first", 0)), int(self.options.get("last", int(pages) - 1))
        return AlbumReader(url, range(max(0, first), min(int(pages), last + 1)))


def album(spark: SparkSession, url: str, **options: object) -> DataFrame:
    """The rows of the pages of a listing, as ALBUM."""
    spark.dataSource.register(AlbumSource)
    reader = spark.read.format("album").option("url", url)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def newest(albums: DataFrame) -> DataFrame:
    """One row for each path, the last that was listed, newest first and those without a date last."""
    last = albums.groupBy("path").agg(F.max_by(F.struct("name", "bytes", "media", "taken", "page"), F.struct("page", "place")).alias("_a")).select("path", "_a.*")
    return last.orderBy(F.desc_nulls_last("taken"), "path")


def spool(rows: DataFrame, folder: str, band: str = "band") -> None:
    """Rows in a folder for each band; a task writes few bands, so a band is few files."""
    rows.repartition(band).write.mode("errorifexists").partitionBy(band).parquet(folder)


def bands(spark: SparkSession, folder: str, wanted: DataFrame, band: str = "band", schema: str | None = None) -> DataFrame:
    """The spooled rows of the bands that a table lists: other bands' files are not opened.

    The list is found first and prunes the folders as the scan begins (dynamic partition pruning).
    """
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(folder).join(wanted.select(band).distinct(), band, "left_semi")
