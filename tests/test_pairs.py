"""Work on pairs: what is compared, and that it is all there."""

import math
import random

from pyspark.sql import functions as F

from tessella.operators import geometry, runs, tiles


def test_people_beside_a_cell_border_are_not_all_compared(spark, monkeypatch):
    """Two cells share a crowd: its parts were compared pair by pair, each id of the smaller with all others."""
    rng, kept, real = random.Random(2), {}, runs.written

    def watched(df, name):
        kept.setdefault(name, []).append(got := real(df, name))
        return got

    monkeypatch.setattr(runs, "written", watched)
    rows = [(i, i % 7, 3 + k, x := 14 + i % 3, x + rng.randrange(1, 12)) for i in range(240) for k in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "id int, source int, y int, x0 int, x1 int")
    got = {r.id: r.component for r in runs.linked_components(df).collect()}
    assert got == dict.fromkeys(range(240), 0)
    assert max(t.count() for t in kept["widest"]) <= 20 and not any(t.count() for t in kept.get("odd", []))
    monkeypatch.setattr(runs, "LINE_ROUNDS", 0)
    assert got == {r.id: r.component for r in runs.linked_components(df).collect()} and kept["odd"][-1].count() > 100


def test_tiles_and_sources_that_are_alike_meet_in_pieces(spark):
    """Joins make a row for some tiles and their sources, not for each pair; nothing follows but their spreading out."""
    tile = spark.createDataFrame([(i if i else None, 0.1 * (i % 2), 0.0, 0.05) for i in range(50)] + [(99, None, 0.0, 0.05)], "tile long, yaw double, pitch double, radius double")
    source = spark.createDataFrame([(i if i else None, 0.1 * (i % 3), -0.0, 0.02) for i in range(40)] + [(99, 0.0, None, 0.1)], "source long, yaw double, pitch double, radius double")
    got = tiles.tile_sources(tile, source)
    want = [(t or -1, s or -1) for t in range(50) for s in range(40) if t % 2 == s % 3]
    assert sorted((-1 if r.tile is None else r.tile, -1 if r.source is None else r.source) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan()
    kinds = [n for n in plan.toString().replace(":", " ").replace("+-", " ").split() if n in ("Join", "Generate", "RepartitionByExpression")]
    assert kinds[:3] == ["Generate", "Generate", "Join"]


def test_pixels_and_cameras_that_are_alike_are_spread_out_last(spark):
    """What a ray and a camera make is computed and rounded before its pixels and cameras are rows; no join makes the pairs."""
    pixel = spark.createDataFrame([(i if i else None, 0.2 * (i % 3), 0.1) for i in range(50)] + [(99, None, 0.1)], "pixel long, yaw double, pitch double")
    camera = spark.createDataFrame([(i if i else None, 0.1 * (i % 2), -0.0, 900.0, 800.0, 600.0) for i in range(40)] + [(99, 2.5, 0.0, 900.0, 800.0, 600.0)], "camera long, yaw double, pitch double, f double, width double, height double")
    got = geometry.footprints(pixel, camera, 0.6, shown=[F.round("u", 2).alias("u")])
    rows = [(-1 if r.pixel is None else r.pixel, -1 if r.camera is None else r.camera, r.u) for r in got.collect()]
    at = lambda p, c: round(400 + 900 * math.tan(0.2 * (p % 3) - 0.1 * (c % 2)), 2)
    want = [(p or -1, c or -1, at(p, c)) for p in range(50) for c in range(40)]
    assert sorted(rows) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString().replace(":", " ").replace("+-", " ").split()
    assert [n for n in plan if n in ("Join", "Generate", "Aggregate", "RepartitionByExpression")][:4] == ["Generate", "Generate", "Join", "Generate"]
