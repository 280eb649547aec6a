"""Forests, homographies, ownership, inverse warps and rotations against plain versions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessella.operators import homographies, matrices, poses, seams


def greedy(edges, tiles):
    """Transforms by growth from the smallest tile of every component: always the best edge out of what is placed, the later of equals."""
    placed, used = {}, set()
    for start in sorted(tiles):
        if start in placed:
            continue
        placed[start] = (start, np.eye(3))
        while True:
            out = [(e["score"], e["edge"], e) for e in edges if (e["from"] in placed) != (e["to"] in placed)]
            if not out:
                break
            e = max(out, key=lambda x: x[:2])[2]
            h = np.array(e["h"]).reshape(3, 3)
            if e["from"] in placed:
                back = np.linalg.inv(h) if abs(np.linalg.det(h)) > 1e-12 else np.array([[1, 0, -e["dx"]], [0, 1, -e["dy"]], [0, 0, 1.0]])
                placed[e["to"]] = (placed[e["from"]][0], placed[e["from"]][1] @ back)
            else:
                placed[e["from"]] = (placed[e["to"]][0], placed[e["to"]][1] @ h)
            used.add(e["edge"])
    return placed, used


def test_transforms_follow_the_greedy_tree(spark):
    """Random graphs with ties, several components, double edges, loops and singular homographies, and a path of 150 tiles."""
    rng, rows = random.Random(2), []
    for capture in range(12):
        n = rng.randint(2, 14)
        for e in range(rng.randint(1, 30)):
            h = [1 + rng.uniform(-0.2, 0.2), rng.uniform(-0.1, 0.1), rng.uniform(-5, 5), rng.uniform(-0.1, 0.1), 1 + rng.uniform(-0.2, 0.2), rng.uniform(-5, 5), 0.001, -0.002, 1.0]
            rows.append((capture, e, rng.randrange(n), rng.randrange(n), float(rng.randint(1, 6)), [0.0] * 9 if rng.random() < 0.1 else h, 3.0, 4.0))
    order = list(range(150))
    rng.shuffle(order)
    for e, (a, b) in enumerate(zip(order, order[1:])):
        rows.append((50, e, a, b, rng.random(), [1.0, 0.0, float(e % 3), 0.0, 1.0, 1.0, 0.0, 0.0, 1.0], 0.0, 0.0))
    names = ["capture", "edge", "from", "to", "score", "h", "dx", "dy"]
    df = spark.createDataFrame([*rows, (60, 1, 2, 2, 5.0, None, 0.0, 0.0), (61, 1, 0, 1, None, None, 0.0, 0.0)], "capture int, edge int, `from` int, `to` int, score double, h array<double>, dx double, dy double")
    got = {(r.capture, r.tile): r for r in poses.propagated(df, ["capture"]).collect()}
    used = {(r.capture, r.edge) for r in poses.spanning_forest(df, ["capture"])[0].collect()}
    expected = {}
    for capture in {r[0] for r in rows}:
        own = [dict(zip(names, r)) for r in rows if r[0] == capture and r[2] != r[3]]
        tree, edges = greedy(own, {t for e in own for t in (e["from"], e["to"])})
        expected |= {(capture, t): v for t, v in tree.items()}
        assert {e for k, e in used if k == capture} == edges
    assert set(got) == set(expected)
    for k, (root, m) in expected.items():
        assert got[k].root == root and np.allclose(np.array(got[k].transform).reshape(3, 3), m, rtol=1e-7, atol=1e-7)
    assert poses.propagated(df.where("capture > 59"), ["capture"]).isEmpty()


def planted(rng, n, share, noise=0.0):
    h = np.array([[1 + rng.uniform(-0.1, 0.1), rng.uniform(-0.05, 0.05), rng.uniform(-80, 80)], [rng.uniform(-0.05, 0.05), 1 + rng.uniform(-0.1, 0.1), rng.uniform(-80, 80)], [1e-5, -2e-5, 1]])
    s = np.stack([rng.uniform(0, 1200, n), rng.uniform(0, 800, n)], 1)
    p = np.column_stack([s, np.ones(n)]) @ h.T
    t = p[:, :2] / p[:, 2:] + rng.normal(0, noise, (n, 2)) if noise else p[:, :2] / p[:, 2:]
    bad = rng.random(n) < share
    t[bad] += rng.uniform(40, 400, (int(bad.sum()), 2)) * rng.choice([-1, 1], (int(bad.sum()), 2))
    return h, np.column_stack([s, t]), bad


def test_homographies(spark):
    rng = np.random.default_rng(7)
    truth, rows = {}, []
    for e in range(30):
        h, p, bad = planted(rng, int(rng.integers(20, 300)), 0.4 if e % 2 else 0.0)
        truth[e] = h, len(p), int((~bad).sum())
        rows += [(e, *map(float, x)) for x in p]
    line = [(100, float(i), 2.0 * i, float(i), 2.0 * i + 5) for i in range(40)]
    few = [(101, float(i * i), float(i), float(i * i), float(i)) for i in range(11)]
    odd = [(0, None, 1.0, 1.0, 1.0), (0, float("nan"), 1.0, 1.0, 1.0), (0, 1.0, float("inf"), 1.0, 1.0)]
    points = spark.createDataFrame(rows + line + few + odd, "edge int, sx double, sy double, tx double, ty double")
    got = {r.edge: r for r in homographies.robust(points.repartition(5), ["edge"]).collect()}
    for e, (h, n, good) in truth.items():
        assert (got[e].reason, got[e].matches, got[e].inliers) == (0, n, good) and got[e].residual < 1e-6
        assert np.abs(np.array(got[e].homography).reshape(3, 3) - h).max() < 1e-6
    assert got[100].reason == 3 and (got[101].reason, got[101].matches, got[101].homography) == (2, 11, None)
    again = {r.edge: r for r in homographies.robust(points.repartition(2), ["edge"]).collect()}
    assert again == got
    assert homographies.robust(points.where("false"), ["edge"]).isEmpty()


def test_homographies_with_noise(spark):
    """Half a pixel of noise and 40 % outliers: the inliers are the planted ones but for a few, at twice the distance in a picture of twice the scale too."""
    rng = np.random.default_rng(8)
    rows, truth = [], {}
    for e in range(10):
        h, p, bad = planted(rng, 300, 0.4, 0.5 * (1 + e % 2))
        truth[e] = h, int((~bad).sum())
        rows += [(e, 1.0 + e % 2, *map(float, x)) for x in p]
    points = spark.createDataFrame(rows, "edge int, scale double, sx double, sy double, tx double, ty double")
    for r in homographies.robust(points, ["edge"], "scale").collect():
        h, good = truth[r.edge]
        assert 0.97 * good <= r.inliers <= good and r.residual < 1.5
        corner = lambda m: (m @ [600, 400, 1])[:2] / (m @ [600, 400, 1])[2]
        assert np.hypot(*(corner(np.array(r.homography).reshape(3, 3)) - corner(h))) < 0.5


def swept(cells, h, w, pair, sweeps):
    """In place, cell by cell."""
    f = np.float32
    own = {k: min(v, key=lambda c: (f(c[1]), c[0]))[0] for k, v in cells.items()}
    for _ in range(sweeps):
        changed = False
        for y in range(h):
            for x in range(w):
                if len(cells.get((y, x), ())) < 2:
                    continue
                best, least = None, f(np.inf)
                for s, cost in sorted(cells[y, x]):
                    cost = f(cost)
                    for k in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)):
                        if own.get(k) is not None and own[k] != s:
                            cost = f(cost + f(pair))
                    if cost < least:
                        best, least = s, cost
                changed |= best != own[y, x]
                own[y, x] = best
        if not changed:
            break
    return own


def test_ownership_is_an_in_place_sweep(spark):
    rng = random.Random(6)
    rows, pictures = [], {}
    for p in range(25):
        h, w = rng.randint(1, 13), rng.randint(1, 17)
        cells = {}
        for y in range(h):
            for x in range(w):
                some = rng.sample(range(6), rng.randint(0, 4))
                if some:
                    cells[y, x] = [(s, rng.choice([0.1, 0.2, 0.3, rng.random()])) for s in some]
        pictures[p] = cells, h, w
        rows += [(p, y, x, s, c) for (y, x), v in cells.items() for s, c in v]
    df = spark.createDataFrame(rows, "picture int, y int, x int, source int, cost double").repartition(4)
    for pair, sweeps in ((0.15, 4), (0.15, 1), (-1.0, 4), (float("nan"), 4)):
        got = {}
        for r in seams.regularised(df, ["picture"], pair, sweeps).collect():
            got.setdefault(r.picture, {})[r.y, r.x] = r.source
        real = pair if pair > 0 else 0.0
        assert got == {p: swept(*v, real, sweeps) for p, v in pictures.items()}
    odd = spark.createDataFrame([(1, 0, 0, None, 1.0), (1, 0, 1, 3, None), (1, 0, 2, 4, float("inf")), (1, 5, 5, 2, 1.0)], df.schema)
    assert {(r.y, r.x, r.source) for r in seams.regularised(odd, ["picture"], 0.1).collect()} == {(0, 2, 4), (5, 5, 2)}


def test_warps_are_inverted(spark):
    """Every place inside a warped picture comes back; places that no pixel goes to and grids of another size give null."""
    rng = random.Random(3)
    rows = []
    for i in range(60):
        offsets = [[rng.uniform(-9, 9), rng.uniform(-9, 9)] for _ in range(25)]
        for _ in range(20):
            rows.append((i, offsets, rng.uniform(0, 639), rng.uniform(0, 479)))
        rows += [(i, offsets, x, y) for x, y in ((0.0, 0.0), (639.0, 479.0))]
    df = spark.createDataFrame(rows, "id int, offsets array<array<double>>, x double, y double").withColumns({"width": F.lit(640), "height": F.lit(480)})
    dx, dy = matrices.warp_offset(F.col("offsets"), 5, F.col("width"), F.col("height"), F.col("x"), F.col("y"))
    moved = df.withColumns({"cx": F.col("x") + dx, "cy": F.col("y") + dy})
    back = moved.withColumn("p", matrices.warp_inverse(F.col("offsets"), 5, F.col("width"), F.col("height"), F.col("cx"), F.col("cy")))
    inner = back.where("x > 1 and x < 638 and y > 1 and y < 478").select(F.hypot(F.col("p.x") - F.col("x"), F.col("p.y") - F.col("y")).alias("off")).collect()
    assert len(inner) > 1100 and all(r.off is not None and r.off < 0.02 for r in inner)
    assert all(r.p is None or math.hypot(r.p.x - r.x, r.p.y - r.y) < 0.03 for r in back.collect())
    odd = spark.createDataFrame([([[0.0, 0.0]] * 9, 700.0, 5.0), ([[0.0, 0.0]] * 8, 5.0, 5.0), ([[0.0, 0.0]] * 9, float("nan"), 5.0), ([[0.0, 0.0]] * 9, 5.0, 5.0), (None, 1.0, 1.0)], "offsets array<array<double>>, x double, y double")
    found = [r.p for r in odd.select(matrices.warp_inverse(F.col("offsets"), 3, F.lit(640), F.lit(480), F.col("x"), F.col("y")).alias("p")).collect()]
    assert [p and tuple(p) for p in found] == [None, None, None, (5.0, 5.0), None]


def test_centring_keeps_relative_rotations(spark):
    cells = spark.range(24).select(F.lit(1).alias("grid"), F.expr("cast(id div 6 as int)").alias("row"), (F.col("id") % 6).cast("int").alias("column"))
    across, down = F.array(F.lit(0.05), F.lit(0.31), F.lit(0.02)), F.array(F.lit(-0.27), F.lit(0.04), F.lit(0.0))
    placed = poses.analytic(cells, ["grid"], across, down)
    of = lambda df: {(r.row, r.column): np.array(r.rotation).reshape(3, 3) for r in df.collect()}
    before, after = of(placed), of(poses.recentred(placed, ["grid"]))
    assert np.abs(after[1, 2] - np.eye(3)).max() < 1e-12 and np.abs(before[1, 2] - np.eye(3)).max() > 0.3
    for a in before:
        assert np.abs(after[a] @ after[a].T - np.eye(3)).max() < 1e-9
        for b in before:
            assert np.abs(after[a].T @ after[b] - before[a].T @ before[b]).max() < 1e-9
    h, v = before[0, 1], before[1, 0]
    assert np.abs(before[3, 5] - np.linalg.matrix_power(h, 5) @ np.linalg.matrix_power(v, 3)).max() < 1e-9
    assert poses.recentred(placed.where("not (row = 1 and column = 2)"), ["grid"]).isEmpty()


def test_loops_compose_rotations(spark):
    """Squares of turned edges against numpy: the residual, the weakest edge, ties, and turns of next to nothing and next to half a turn."""
    from tessella.operators import edges

    rng = np.random.default_rng(4)

    def turn(v):
        t = np.linalg.norm(v)
        k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
        return np.eye(3) + (np.sin(t) / t) * k + ((1 - np.cos(t)) / t**2) * k @ k if t else np.eye(3)

    rows, expected = [], {}
    for capture in range(40):
        size = rng.choice([1e-9, 0.004, 0.3, 1.5])
        four = {k: (turn(rng.normal(0, size, 3)), float(rng.choice([1.0, 1.1, 5.0, 9.0]))) for k in ((0, 1), (1, 3), (2, 3), (0, 2))}
        cycle = four[0, 1][0] @ four[1, 3][0] @ four[2, 3][0].T @ four[0, 2][0].T
        v = np.array([cycle[2, 1] - cycle[1, 2], cycle[0, 2] - cycle[2, 0], cycle[1, 0] - cycle[0, 1]])
        residual = math.atan2(np.linalg.norm(v), np.trace(cycle) - 1) * 1000
        ranked = sorted(four, key=lambda k: (four[k][1], k))
        tied = four[ranked[0]][1] >= 0.85 * four[ranked[1]][1]
        for k, (m, w) in four.items():
            rows.append((capture, *k, m.ravel().tolist(), w))
            bad = residual > 12
            expected[capture, *k] = residual, bool(bad and tied), w * (0.05 if bad and not tied and k == ranked[0] else 1.0)
    df = spark.createDataFrame(rows, "capture int, `from` int, `to` int, rotation array<double>, weight double")
    got = {(r.capture, r["from"], r["to"]): (r.worst_loop, r.ambiguous, r.scaled) for r in edges.loop_weights(df, ["capture"], 2, 1000.0).collect()}
    assert set(got) == set(expected)
    for k, (residual, ambiguous, scaled) in expected.items():
        assert math.isclose(got[k][0], residual, abs_tol=1e-5) and got[k][1] == ambiguous and math.isclose(got[k][2], scaled)
