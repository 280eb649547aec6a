"""Stores that change as a whole, paged and spooled sources, state that leaves, and counts that are reported on the way."""

import json
import os
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tessella.operators import blend
from tessella.sinks import writers
from tessella.sinks.store import Store
from tessella.sources import paged
from tessella.streaming import events, jobs, progress


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_a_killed_job_leaves_the_record(spark, tmp_path):
    """A job that fails while it writes, and one that dies between its rows and the list of versions."""
    store = Store(spark, f"file://{tmp_path}/s", ["k"])
    store.replace(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    bad = spark.range(4).repartition(4).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.replace(bad)
    assert rows(store.rows()) == [(1, "a"), (2, "b")]
    staged = store.staged(spark.createDataFrame([(9, "z")], "k int, v string"))  # killed before it counts
    assert rows(Store(spark, f"file://{tmp_path}/s", ["k"]).rows()) == [(1, "a"), (2, "b")]
    assert os.path.exists(f"{tmp_path}/s/{staged}")
    store.append(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert rows(store.rows()) == [(1, "a"), (2, "c"), (3, "d")]
    store.replace(store.rows().where("k > 1"))
    assert rows(store.rows()) == [(2, "c"), (3, "d")]
    assert store.swept() >= 3 and not os.path.exists(f"{tmp_path}/s/{staged}") and rows(store.rows()) == [(2, "c"), (3, "d")]
    assert Store(spark, f"file://{tmp_path}/none", ["k"]).rows() is None


def test_caches_keep_what_they_have(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    writers.cache(spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "key string, v int"), folder, "key")
    writers.cache(spark.createDataFrame([("a", 9), ("c", 4)], "key string, v int"), folder, "key")
    assert rows(writers.cached(spark, folder, "key")) == [("a", 1), ("b", 3), ("c", 4)]


def test_damaged_tiles_are_rendered_again(spark, tmp_path):
    pixels = blend.raster(spark, 24, 16)
    folder = f"file://{tmp_path}/t"
    writers.write_tiles(pixels, folder, 8)
    store = writers.tile_store(spark, folder)
    broken = store.rows().where("tile_row = 1 and tile_column = 2").withColumn("pixels", F.transform("pixels", lambda p: p.withField("v", p["v"] + 1)))
    short = store.rows().where("tile_row = 0 and tile_column = 0").withColumn("pixels", F.slice("pixels", 1, 5))
    store.append(broken.unionByName(short))
    wanted = {(r.tile_row, r.tile_column) for r in writers.pending_tiles(pixels, folder, 8).select("tile_row", "tile_column").distinct().collect()}
    assert wanted == {(1, 2), (0, 0)}
    writers.write_tiles(pixels, folder, 8)
    held = store.rows()
    assert writers.pending_tiles(pixels, folder, 8).isEmpty() and held.count() == 6
    assert rows(held.select(F.explode("pixels").alias("p")).select("p.x", "p.y", "p.v")) == rows(pixels.select("x", "y", "v"))


def test_albums_are_read_page_by_page(spark, tmp_path):
    pages = [
        [{"filePath": "/a", "fileName": "1", "fileSize": 5, "modificationTime": 100}, {"filePath": "/b", "fileName": "2"}, "junk", {"filePath": 3, "fileName": "x"}],
        [],
        [{"filePath": "/a", "fileName": "3", "mediaType": 4, "modificationTime": 50}, {"filePath": "/c", "fileName": "4", "modificationTime": 900}, {"filePath": "/a", "fileName": "5", "modificationTime": 60}],
    ]
    for k, p in enumerate(pages):
        (tmp_path / f"{k}.json").write_text(json.dumps(p))
    url = f"file://{tmp_path}" + "/{page}.json"
    df = paged.album(spark, url, items=130, page_size=50)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 5
    got = [(r.path, r.name, r.taken and int(r.taken.timestamp())) for r in paged.newest(df.withColumn("taken", F.col("taken"))).collect()]
    assert [g[:2] for g in got] == [("/c", "4"), ("/a", "5"), ("/b", "2")] and got[2][2] is None
    assert df.where("page = 2").unionByName(df.where("page = 0")).count() == 5 and df.where("page = 0").join(df.where("page = 2"), "path").count() == 2
    (tmp_path / "1.json").write_text("{broken")
    assert paged.album(spark, url, pages=3, first=2).count() == 3 and paged.album(spark, url, pages=3, last=0).count() == 2  # page 1 is not fetched
    with pytest.raises(Exception):
        df.count()
    with pytest.raises(Exception, match="page_size"):
        paged.album(spark, url, items=1, page_size=0).count()


def test_a_retried_page_gives_no_second_copy(spark, tmp_path):
    """The first attempt at each page fails after the page was read; the rows of the second are all there is."""
    for k in range(4):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"filePath": f"/{k}/{i}", "fileName": "x"} for i in range(3)]))
    mark = str(tmp_path / "tried")

    @F.udf("string")
    def flaky(page, path):
        import os

        if path.endswith("2") and not os.path.exists(f"{mark}{page}"):
            open(f"{mark}{page}", "w").close()
            raise ValueError("lost")
        return path

    df = paged.album(spark, f"file://{tmp_path}" + "/{page}.json", pages=4)
    for _ in range(6):  # a local master does not retry tasks: the job is run again until all pages were tried
        try:
            df.select("page", flaky("page", "path").alias("path")).write.mode("overwrite").parquet(f"file://{tmp_path}/out")
            break
        except Exception as e:
            assert "lost" in str(e)
    assert rows(spark.read.parquet(f"file://{tmp_path}/out").select("path")) == sorted([(f"/{k}/{i}",) for k in range(4) for i in range(3)], key=repr)


def test_only_wanted_bands_are_opened(spark, tmp_path):
    """The files of other bands are destroyed; the plan prunes by the list of bands."""
    folder = f"{tmp_path}/spool"
    paged.spool(spark.range(2000).select((F.col("id") % 20).alias("band"), F.col("id").alias("v")), f"file://{folder}")
    for b in range(20):
        if b not in (3, 7):
            for f in os.listdir(f"{folder}/band={b}"):
                if f.endswith(".parquet"):
                    open(f"{folder}/band={b}/{f}", "w").write("gone")
                    if os.path.exists(f"{folder}/band={b}/.{f}.crc"):
                        os.remove(f"{folder}/band={b}/.{f}.crc")
    spark.createDataFrame([(3, "x"), (7, "x"), (9, "y")], "band int, kind string").write.parquet(f"file://{tmp_path}/wanted")
    wanted = spark.read.parquet(f"file://{tmp_path}/wanted").where("kind = 'x'")
    df = paged.bands(spark, f"file://{folder}", wanted, schema="v long, band int")
    assert "dynamicpruning" in df._jdf.queryExecution().toString().lower()
    assert df.count() == 200 and {r.band for r in df.select("band").distinct().collect()} == {3, 7}


def test_finished_jobs_leave_the_state(spark, tmp_path):
    """Two batches: what is open goes on, what has ended is refused for a while, and the state holds open jobs only."""
    def put(name, requests):
        spark.createDataFrame(requests, "job long, event_id long, at long, wanted string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")

    def drain():
        stream = spark.readStream.schema("job long, event_id long, at long, wanted string").parquet(f"file://{tmp_path}/in")
        return events.drained(jobs.machine(stream, minutes=30), f"file://{tmp_path}/run", "append", once=True)

    put("a", [(1, 1, 1, "queued"), (1, 2, 2, "running"), (2, 3, 1, "queued"), (2, 4, 2, "failed"), (3, 5, 1, "paused"), (4, 6, 1, "queued")])
    drain()
    put("b", [(1, 7, 9, "completed"), (2, 8, 9, "running"), (4, 10, 9, "queued"), (4, 9, 8, "running"), (5, 11, 1, "queued")])
    got = {r.event_id: (r.state, r.legal) for r in drain().collect()}
    assert got == {
        1: ("queued", True), 2: ("running", True), 3: ("queued", True), 4: ("failed", True), 5: (None, False), 6: ("queued", True),
        7: ("completed", True), 8: ("failed", False), 9: ("running", True), 10: ("running", False), 11: ("queued", True),
    }
    held = jobs.state_rows(spark, f"file://{tmp_path}/run/checkpoint", "open")
    assert {r.key.job: r.value.state for r in held.collect()} == {4: "running", 5: "queued"}


def test_samples_leave_the_buffer(spark, tmp_path):
    def drain(requests):
        spark.createDataFrame(requests, "job long, at long, done double").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema("job long, at long, done double").parquet(f"file://{tmp_path}/in")
        return {(r.samples, r.rate) for r in events.drained(jobs.rates(stream, minutes=1 / 30), f"file://{tmp_path}/run", "update", once=True).collect()}

    assert drain([(1, 0, 0.0), (1, 2_000_000, 0.4), (1, 2_000_000, 0.5)]) == {(2, 0.25)}
    time.sleep(2.5)
    assert (1, None) in drain([(1, 4_000_000, 0.6)])


def test_counts_are_reported_beside_the_result(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    kept = progress.stage(progress.stage(stream, "read").where("id % 4 = 0"), "kept")
    result, counts = progress.run(kept, f"file://{tmp_path}/run", "counted")
    assert {r.stage: r.rows for r in counts.groupBy("stage").agg(F.sum("rows").alias("rows")).collect()} == {"read": 100, "kept": result.count()}
    assert counts.select("batch").distinct().count() == 3
    one = Observation("one")
    df = spark.range(10).observe(one, F.count(F.lit(1)).alias("rows")).where("id > 5")
    assert rows(progress.written_with_counts(df, f"file://{tmp_path}/batch", {"one": one})) == [("one", 10)]
