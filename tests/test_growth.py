"""Queries on tables whose keys and groups are those of larger folders, against their SQL."""

import math
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import blend, edges, geometry, match, matrices, poses, runs, tiles
from tessella.plans import registry
from tessella.session import dealt_by_size, tables_written
from tessella.streaming import events, jobs

from .test_queries import canonical

DATA = Path("/root/testdata/sf0.001")


def against_sql(spark, folder, name):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.sql(f"create view {p.stem} as from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    got, expected = registry.queries()[name](spark, str(folder)), con.sql(registry.oracle_sql()[name])
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(expected.columns, expected.fetchall())


@pytest.mark.parametrize("name", ["picture_sizes", "photo_metadata"])
def test_pictures_wider_than_a_jpeg_can_be(name, spark, tmp_path):
    spark.read.parquet(f"{DATA}/part.parquet").selectExpr("* except (p_partkey)", "p_partkey + 65436 as p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    against_sql(spark, tmp_path, name)


def test_box_pairs_are_dealt_over_tasks(spark):
    rng = random.Random(3)
    boxes = [(i, x := rng.randrange(-90, 90), x + rng.randrange(50), y := rng.randrange(-90, 90), y + rng.randrange(50)) for i in range(150)]
    got = runs.overlapping_boxes(spark.createDataFrame(boxes, "id long, x0 long, x1 long, y0 long, y1 long").coalesce(1))
    near = lambda a, b, k: a[k] <= b[k + 1] + 3 and b[k] <= a[k + 1] + 3
    assert sorted(map(tuple, got.collect())) == [(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and near(a, b, 1) and near(a, b, 3)]
    assert "[bin#" in (plan := got._jdf.queryExecution().executedPlan().toString()) and "row#" in plan.split("SortMergeJoin")[1].split("\n")[0]


def test_tile_sources_are_dealt_over_tasks(spark):
    tile = spark.range(40).selectExpr("id as tile", "id % 3 * 0.1D as yaw", "id % 2 * 0.1D as pitch", "0.05D as radius").coalesce(1)
    source = spark.range(30).selectExpr("id as source", "id % 5 * 0.1D as yaw", "0D as pitch", "0.06D as radius").coalesce(1)
    got = tiles.tile_sources(tile, source)
    assert got.rdd.getNumPartitions() >= 8
    near = lambda t, s: abs(t % 3 - s % 5) * 0.1 < 0.11 and (t % 2 == 0 or t % 3 == s % 5)
    assert sorted(map(tuple, got.collect())) == [(t, s) for t in range(40) for s in range(30) if near(t, s)]


def test_nearest_vectors_are_those_of_the_similarity_join(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    rng = random.Random(5)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(240)] + [(500, [0.5] * 4), (501, [0.5] * 4), (503, [0.5] * 4)]
    df = spark.createDataFrame(vectors, "id long, v array<float>")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = match.approximate_nearest(left, right, 0.5, tables=3, within=1.2, block=50)
    assert "CartesianProduct" not in (plan := got._jdf.queryExecution().toString()) and "FlatMapCoGroupsInPandas" in plan
    own, other = (d.select("id", array_to_vector(d.v.cast("array<double>")).alias("f")) for d in (left, right))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=0.5, numHashTables=3, seed=7).fit(own)
    best = {}
    for r in model.approxSimilarityJoin(own, other, 1.2, "d").selectExpr("datasetA.id as a", "datasetB.id as b", "d").collect():
        best[r.a] = min(best.get(r.a, (9.0, 0)), (r.d, r.b))
    found = {r.a: (r.distance, r.b) for r in got.collect()}
    assert len(found) > 50 and {a: b for a, (_, b) in found.items()} == {a: b for a, (_, b) in best.items()}
    assert all(abs(found[a][0] - best[a][0]) < 1e-9 for a in best)


def test_nearest_in_blocks_has_ties_in_order():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 3, (300, 3)).astype(float), rng.integers(0, 3, (90, 3)).astype(float)
    d = np.sqrt(((x[:, None] - y) ** 2).sum(axis=2))
    expected = [(i, int(j), d[i, j]) for i in range(300) for j in np.lexsort((np.arange(90), d[i]))[:2]]
    assert [(int(i), int(j), e) for i, j, e in zip(*match.closest(x, y, 2))] == expected


@pytest.mark.parametrize("name", ["mutual_ratio_knn", "pixel_to_source", "runs_projected"])
def test_heavy_joins_are_dealt_over_tasks(name, spark, tmp_path):
    """One small file of each table is work for all tasks, and what is alike is computed once."""
    for t in ("embeddings", "orders", "supplier", "lineitem"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
        rows.unionByName(rows.withColumn("o_orderkey", rows.o_orderkey + 1009) if t == "orders" else rows.limit(0)).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    against_sql(spark, tmp_path, name)
    assert "RepartitionByExpression" in registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().analyzed().toString() or name == "mutual_ratio_knn"


@pytest.mark.parametrize("cell", [1, 16, 4000])
def test_people_are_grouped_by_hubs(spark, monkeypatch, cell):
    """Whatever hubs there are, groups are those of all pairs; pairs within a group are not all made."""
    rng, rows = random.Random(cell), []
    for i in range(400):
        y, x = rng.randrange(0, 60, 6), rng.randrange(0, 300, 10)
        rows += [(i, i * 7 % 11 % 4, y + k, x + rng.randrange(3), x + rng.randrange(3, 9)) for k in range(rng.randint(1, 4))]
    monkeypatch.setattr(runs, "HUB_CELL", cell)
    got = {r.id: r.component for r in runs.linked_components(spark.createDataFrame(rows, "id int, source int, y int, x0 int, x1 int")).collect()}
    pixels, source = {}, {r[0]: r[1] for r in rows}
    for i, _, y, x0, x1 in rows:
        pixels.setdefault(i, set()).update((y, x) for x in range(x0, x1 + 1))
    root = list(range(400))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(400):
        for b in range(a + 1, 400):
            shared, least = len(pixels[a] & pixels[b]), min(len(pixels[a]), len(pixels[b]))
            if source[a] != source[b] and shared >= min(least, 2) and shared * 10 >= least:
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    assert got == {i: find(i) for i in range(400)} and len(set(got.values())) > 20


@pytest.mark.parametrize("name", ["person_groups", "thin_support"])
def test_shared_steps_against_sql(name, spark):
    against_sql(spark, "/root/testdata/sf0.01", name)


def test_points_are_sent_once(spark):
    """Four distinct counts of an edge's points sent each point five times."""
    points = spark.createDataFrame([(1, 2, 1.0, 1.0, 1.0, 1.0), (1, 2, 2.0, 1.0, None, 1.0), (2, 3, None, None, None, None)], "from long, to long, sx double, sy double, tx double, ty double")
    known = points.select("from", "to").distinct().selectExpr("*", "99D as worst_loop")
    got = edges.thin_support(points, known, 51.0, 91.0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan and {(r["from"], r.unique, r.removed) for r in got.collect()} == {(1, 2, True), (2, 1, False)}


def graph_edges(spark, seed=4):
    rng = random.Random(seed)
    rows = [(k, e, rng.randrange(9), rng.randrange(9), float(rng.randint(1, 5)), [1 + rng.random(), 0.1, rng.random(), 0.0, 1.0, 2.0, 0.0, 0.0, 1.0] if e % 5 else [0.0] * 9, 1.0, 2.0) for k in range(30) for e in range(rng.randint(1, 25))]
    return spark.createDataFrame(rows, "capture long, edge long, `from` long, `to` long, score double, h array<double>, dx double, dy double")


def test_forests_of_small_captures_take_one_shuffle(spark, monkeypatch):
    """Solved in batches and round by round in Spark, the trees and transforms are the same; batches write one table."""
    df = graph_edges(spark)
    before = tables_written()
    tiles = {(r.capture, r.tile): (r.root, r.parent, r.edge) for r in poses.rooted(df, ["capture"]).collect()}
    turned = {(r.capture, r.tile): r.transform for r in poses.propagated(df, ["capture"]).collect()}
    assert tables_written() - before <= 2
    monkeypatch.setattr(poses, "SMALL", 8)  # most captures are large now, some small
    assert tiles == {(r.capture, r.tile): (r.root, r.parent, r.edge) for r in poses.rooted(df, ["capture"]).collect()}
    other = {(r.capture, r.tile): r.transform for r in poses.propagated(df, ["capture"]).collect()}
    assert set(turned) == set(other) == set(tiles) and all(np.allclose(turned[k], other[k], rtol=1e-9) for k in turned)


def test_middles_of_small_groups_take_one_shuffle(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(g, [rng.gauss(0.1 * g, 0.004 if rng.random() < 0.8 else 0.3) for _ in range(3)]) for g in range(12) for _ in range(rng.randint(1, 30))]
    df = spark.createDataFrame([*rows, (3, None), (None, [0.1, 0.2, 0.3]), (99, None)], "g int, v array<double>").select("g", matrices.rotation(F.col("v")).alias("rotation"))
    before = tables_written()
    got = {r.g: r for r in poses.robust_steps(df, ["g"]).collect()}
    assert tables_written() - before == 1 and set(got) == set(range(12))
    monkeypatch.setattr(poses, "SMALL", 10)
    other = {r.g: r for r in poses.robust_steps(df, ["g"]).collect()}
    assert set(got) == set(other) and all(got[g].samples == other[g].samples and np.allclose([*got[g].vector, *got[g].rotation, got[g].rms], [*other[g].vector, *other[g].rotation, other[g].rms], atol=1e-12) for g in got)


def test_large_edges_are_fitted_without_holding_them(spark):
    rng, rows = random.Random(8), []
    for edge in range(5):
        a, b = edge * 0.02, 0.05 - edge * 0.01
        for _ in range((6, 9, 40, 60, 80)[edge]):
            x, y = rng.uniform(0, 600), rng.uniform(0, 500)
            u, v, w = (x - 300) / 500, -(y - 250) / 500, 1.0
            u, w = math.cos(a) * u + math.sin(a) * w, -math.sin(a) * u + math.cos(a) * w
            v, w = math.cos(b) * v - math.sin(b) * w, math.sin(b) * v + math.cos(b) * w
            far = rng.uniform(0, 40) if rng.random() < 0.1 else rng.gauss(0, 0.3)
            rows.append((edge, x, y, 300 + 500 * u / w + far, 250 - 500 * v / w))
    rows += [(9, rng.uniform(0, 600), rng.uniform(0, 500), rng.uniform(0, 600), rng.uniform(0, 500)) for _ in range(50)] + [(10, 300.0, 250.0, 300.0, 250.0)] * 20
    df = spark.createDataFrame(rows, "edge long, sx double, sy double, tx double, ty double")
    fit = lambda most: {r.edge: r for r in geometry.fitted_rotations(df, ["edge"], 500.0, 300.0, 250.0, most).collect()}
    whole, split = fit(10_000), fit(20)
    assert set(whole) == set(split) >= {1, 2, 3, 4} and 0 not in whole and 10 not in whole
    assert all(np.allclose([*whole[e].rotation, whole[e].median, whole[e].rms], [*split[e].rotation, split[e].median, split[e].rms], atol=1e-7) for e in whole)


def test_samples_heard_at_once_are_one_value_of_the_state(spark, tmp_path):
    spark.createDataFrame([(j, 10 * k, k / 50) for j in (1, 2) for k in range(50)], "job long, at long, done double").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("job long, at long, done double").parquet(f"file://{tmp_path}/in")
    got = events.drained(jobs.rates(stream), f"file://{tmp_path}/run", "update", once=True)
    assert sorted(map(tuple, got.select("job", "samples").collect())) == [(1, 50), (2, 50)]
    assert spark.read.format("statestore").option("stateVarName", "samples").load(f"file://{tmp_path}/run/checkpoint").count() == 2


def test_best_peers_take_no_join(spark):
    df = spark.createDataFrame([(1, 7, 0.5, 2.0), (1, 8, 0.3, 3.0), (1, 9, 0.5, 4.0), (2, 7, 0.1, 5.0)], "pixel int, source int, score double, q double")
    got = blend.best_other(dealt_by_size(df, "pixel", most=1), ["pixel"], "source", "score", "q", own=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(1, 7, 0.5, 0.5, 4.0, 2.0), (1, 8, 0.3, 0.5, 2.0, 3.0), (1, 9, 0.5, 0.5, 2.0, 4.0), (2, 7, 0.1, None, None, 5.0)]
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
