"""Cases that the tables don't have: nulls, ties, repeated rows, empty tables, refinements and refusals."""

import random

import pytest
from pyspark.sql import functions as F

from tessella import session as sessions
from tessella.functions import text
from tessella.operators import blend, catalog, edges, graph, matrices, records, robust, scan, timeline
from tessella.sinks import writers
from tessella.sources import readers
from tessella.streaming import events as streams


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_order_statistics_cut_buckets_again(spark):
    """Ranks inside buckets that are cut many times, with ties, few values and one outlier that takes all the range."""
    rng = random.Random(1)
    data = [("a", rng.gauss(0, 1)) for _ in range(3000)] + [("b", float(rng.randrange(3))) for _ in range(2000)] + [("c", rng.random()) for _ in range(999)] + [("c", 1e12), ("d", 5.0), ("e", None), ("f", float("nan"))]
    df = spark.createDataFrame(data, "k string, v double")
    index = {"low": "0", "middle": "n div 2", "high": "((n - 1) * 95) div 100"}
    got = {r.k: r for r in robust.order_statistics(df, ["k"], "v", cell=20, **index).collect()}
    assert set(got) == set("abcd")
    for k in "abcd":
        v = sorted(x for g, x in data if g == k)
        assert (got[k].n, got[k].low, got[k].middle, got[k].high) == (len(v), v[0], v[len(v) // 2], v[(len(v) - 1) * 95 // 100])
    assert robust.order_statistics(df.where("k = 'z'"), ["k"], "v", middle="n div 2").count() == 0


def test_order_statistics_end_for_all_values(spark):
    """Infinite, subnormal, huge, equal and signed values and the ends of bigint, cut down to two rows at most."""
    inf, tiny, huge = float("inf"), 5e-324, 1.7976931348623157e308
    groups = {
        "inf": [float(i) for i in range(40)] + [inf, inf, -inf], "all inf": [inf] * 9 + [-inf] * 8, "tiny": [tiny * k for k in range(30)] + [-tiny, 0.0, -0.0],
        "wide": [-huge, huge, 1.0, -1.0, tiny, -tiny] * 5 + [inf], "equal": [2.5] * 50, "close": [1.0 + 2.0**-52 * k for k in range(40)], "powers": [2.0**k for k in range(-40, 40)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in [*vs, float("nan"), None]], "k string, v double")
    got = {r.k: r for r in robust.order_statistics(df, ["k"], "v", cell=2, low="0", middle="n div 2", high="n - 1").collect()}
    for k, vs in groups.items():
        v = sorted(vs)
        assert (got[k].n, got[k].low, got[k].middle, got[k].high) == (len(v), v[0], v[len(v) // 2], v[-1])
    ends = [-(2**63), 2**63 - 1, 0, 1, -1, 2**63 - 2, -(2**63) + 1] + list(range(2**62, 2**62 + 30))
    longs = spark.createDataFrame([("a", v) for v in ends], "k string, v long")
    got = robust.order_statistics(longs, ["k"], "v", cell=2, low="0", middle="n div 2", high="n - 1").first()
    assert (got.low, got.middle, got.high) == (min(ends), sorted(ends)[len(ends) // 2], max(ends))


def test_runs_of_null_states_collapse(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate([None, None, "a", "a", None, None, "b"])], "log int, at int, state string")
    assert [r.at for r in timeline.collapse(df, ["log"], ["at"], "state").orderBy("at").collect()] == [0, 2, 4, 6]


def test_names_that_look_made_are_not_taken(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "a (2)"), (5, "b"), (6, "a (2)")], "id int, name string")
    got = {r.id: r.unique_name for r in catalog.unique_names(df, "name", "id").collect()}
    assert got == {1: "a", 2: "a (3)", 3: "a (4)", 4: "a (2)", 5: "b", 6: "a (2) (2)"} and len(set(got.values())) == 6


def test_peers_are_other_sources(spark):
    df = spark.createDataFrame([(1, 7, 0.5), (1, 7, 0.4), (1, 8, 0.3), (2, 7, 0.1)], "pixel int, source int, score double")
    assert rows(blend.best_other(df, ["pixel"], "source", "score")) == [(1, 7, 0.5, 0.3), (1, 8, 0.3, 0.5), (2, 7, 0.1, None)]


def test_unclear_best_is_refused(spark):
    tied = spark.createDataFrame([("x", 5), ("x", 5), ("y", 3)], "k string, size int")
    with pytest.raises(Exception, match="no clear best"):
        catalog.only_clear(tied, ["k"], "size").collect()
    assert rows(catalog.only_clear(tied.where("k = 'y'"), ["k"], "size")) == [("y", 3)]


def test_runs_with_other_inputs_are_not_compared(spark):
    a = spark.createDataFrame([(1, "x", 2.0)], "id int, layout string, ms double")
    with pytest.raises(Exception, match="do not share"):
        records.compared_runs(a, a.withColumn("layout", F.lit("y")), "id", ["layout"], ["ms"]).collect()


def test_places_settle_on_their_steps(spark):
    n = 6
    nodes = spark.range(n).select("id", F.lit(0.0).alias("x"))
    pulls = spark.range(n - 1).select(F.col("id").alias("from"), (F.col("id") + 1).alias("to"), F.lit(-10.0).alias("dx"), F.lit(1.0).alias("w"))
    got = {r.id: r.x for r in edges.relaxed(nodes, pulls, 24).collect()}
    x = [0.0] * n
    for _ in range(24):  # the same rounds, one after the other
        said = [[x[j] + (10 if j < i else -10) for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)]
        x = [0.0 if i == 0 else 0.35 * x[i] + 0.65 * sum(said[i]) / len(said[i]) for i in range(n)]
    assert all(got[i] == pytest.approx(x[i], abs=1e-9) for i in range(n)) and 0 < x[1] < x[5]


def test_warps_that_bend_too_much(spark):
    flat = [[0.0, 0.0]] * 9
    bent, far = [list(x) for x in flat], [list(x) for x in flat]
    bent[4], far[0] = [60.0, 0.0], [65.0, 0.0]
    df = spark.createDataFrame([(1, flat, 1000, 1000), (2, bent, 1000, 1000), (3, far, 9000, 9000), (4, flat[:8], 1000, 1000)], "id int, offsets array<array<double>>, width int, height int")
    assert {r.id: r.valid for r in matrices.warp_is_valid(df, "id", 3).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_unsafe_transforms(spark):
    one, flat, small = [1.0, 0, 0, 0, 1, 0, 0, 0, 1], [1.0, 0, 0, 1, 0, 0, 0, 0, 1], [0.01, 0, 0, 0, 0.01, 0, 0, 0, 1]
    df = spark.createDataFrame([(i, [float(v) for v in h]) for i, h in enumerate((one, flat, small))], "id int, h array<double>")
    assert [r.s for r in df.select("id", matrices.is_safe(F.col("h"), F.lit(100.0), F.lit(50.0)).alias("s")).orderBy("id").collect()] == [True, False, False]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, a long, b long, name string, size int, path string")
    assert graph.components(none.select("id"), none).count() == 0
    assert catalog.unique_names(none, "name", "id").count() == 0
    assert records.overlapping_paths(none).count() == 0


def test_tiles_are_not_written_twice(spark, tmp_path):
    pixels = blend.raster(spark, 20, 10)
    folder = f"file://{tmp_path}/tiles"
    writers.write_tiles(pixels, folder, 8)
    assert writers.pending_tiles(pixels, folder, 8).count() == 0
    writers.write_tiles(pixels, folder, 8)
    assert writers.tile_store(spark, folder).rows().count() == 6


def test_malformed_requests_fail_where_asked(spark):
    df = spark.createDataFrame([("{broken",)], "body string")
    assert readers.requests(df).first().request is None
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        readers.requests(df, fail=True).select("request.rows").collect()


def test_thumbnails_are_left_out(spark):
    df = spark.createDataFrame([(f"/a/{n}", 1) for n in ("b10.jpg", "b2.jpg", "thumb_1.jpg", "x-thumbnail.jpg", "thumbprint.jpg")], "path string, bytes long")
    assert [r.name for r in readers.listed(df).orderBy("key").collect()] == ["b2.jpg", "b10.jpg", "thumbprint.jpg"]


def test_versions_sort_by_number(spark):
    df = spark.createDataFrame([(v,) for v in ("1.2.10", "v1.2.9+3", "1.2.9", "x", "1.10.0")], "v string").withColumn("key", text.version_key(F.col("v")))
    assert [r.v for r in df.where("key is not null").orderBy("key").collect()] == ["1.2.9", "v1.2.9+3", "1.2.10", "1.10.0"]


def test_overflowing_grids_are_refused(spark):
    base = dict(pan=0.0, tilt=0.0, zoom=1.0, fov_x=60.0, fov_y=40.0, mech_pan=180.0, mech_tilt=90.0, target_x=6.0, target_y=4.0, target_mech_pan=180.0, target_mech_tilt=90.0, roi_left=0.0, roi_top=0.0, roi_right=1.0, roi_bottom=1.0, overlap_x=0.3, overlap_y=0.3, grid_rows=None, grid_columns=None, traversal="snake", bytes_per_tile=10, maximum_tiles=500)
    cases = [base, base | {"grid_rows": 1 << 40, "grid_columns": 1 << 40}, base | {"fov_x": float("nan")}, base | {"grid_rows": 2, "grid_columns": 2}, base | {"pan": 0.9}]
    kinds = ", ".join(f"{c} {'string' if c == 'traversal' else 'long' if c in ('grid_rows', 'grid_columns', 'bytes_per_tile', 'maximum_tiles') else 'double'}" for c in base)
    df = spark.createDataFrame([(i, *c.values()) for i, c in enumerate(cases)], f"request int, {kinds}")
    assert [r.error for r in scan.sized(df).orderBy("request").collect()] == [None, "resource-limit", "fov", "grid-too-small", "mechanical-range"]
    assert scan.plan(df, "request").select("request").distinct().count() == 1


def test_states_do_not_depend_on_arrival(spark, tmp_path):
    """Ties of time go by the event's number, whatever file comes first."""
    for n, order in enumerate((1, -1)):
        folder = f"{tmp_path}/{n}"
        for k, (i, kind) in enumerate([(1, "a"), (2, "b")][::order]):
            spark.createDataFrame([(i, 7, kind)], "event_id long, user_id long, event_type string").selectExpr("*", "timestamp'2024-01-01' as ts").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        schema = "event_id long, user_id long, event_type string, ts timestamp"
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        got = streams.drained(streams.job_states(stream), f"file://{folder}", "update")
        assert got.where("events = 2").select("last_type").first()[0] == "b"


def test_no_shared_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        sessions.shared_dir(Cluster)


def test_released_tables_are_gone(spark):
    mark = sessions.tables_written()
    df = sessions.written(spark.range(3), "gone")
    assert df.count() == 3
    sessions.release(spark, mark)
    assert sessions.tables_written() == mark
    with pytest.raises(Exception):
        df.count()
