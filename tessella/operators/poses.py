"""Transforms and rotations of tiles: maximum-confidence spanning forests, transforms along them, centring and even grids.

A forest is grown for all captures at once: in each round every component takes its best edge (Borůvka), so
the rounds grow with the logarithm of the largest capture. What lies along a path is composed by
pointer doubling, again in a logarithm of its length. That is done in Spark for captures of more than SMALL edges, none of which is held in one
task or on the driver. Captures of at most SMALL edges are shuffled once and solved many at a time by the same rounds on arrays; so are the
robust middles of groups of at most SMALL rotations.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import by_size, in_batches, written
from . import matrices, robust

#: Rows of a group that one task may hold.
SMALL = 4096
UNIT = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
c = F.col


def confidence(inliers: Column, ratio: Column, residual: Column) -> Column:
    """What a visual edge is worth: more and better inliers, less residual; a residual that is no number counts as none."""
    return inliers * ratio / (1 + F.greatest(F.nanvl(F.coalesce(residual, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))


def _to_roots(links: DataFrame, keys: list[str], node: str, root: str) -> DataFrame:
    """links (keys, node, root) with every root the end of its chain; an end names itself."""
    while True:
        far = links.select(*keys, c(root).alias("_far"), c(node).alias(root))
        links = written(links.join(far, [*keys, root]).select(*keys, node, c("_far").alias(root), (c("_far") != c(root)).alias("_moved")), "roots")
        if links.where("_moved").isEmpty():
            return links.drop("_moved")


def _fine(edges: DataFrame, keys: list[str], score: str, order: str) -> tuple[DataFrame, DataFrame | None]:
    """The edges that have part in a forest, those of small captures and those of others apart."""
    return by_size(edges.where((c("from") != c("to")) & c(score).isNotNull() & c(order).isNotNull()), keys, SMALL)


def _best_edges(u: np.ndarray, v: np.ndarray, rank: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(which edges the forest of greatest ranks has, the component of each of the n nodes): Borůvka's rounds on arrays."""
    at = np.argsort(rank)  # ranks are 0, 1, ...: the edge of each
    home, picked = np.arange(n), np.zeros(len(u), bool)
    live = np.arange(len(u))
    while len(live := live[home[u[live]] != home[v[live]]]):
        best = np.full(n, -1)
        for end in (u, v):
            np.maximum.at(best, home[end[live]], rank[live])
        part = np.flatnonzero(best >= 0)
        edge = at[best[part]]
        picked[edge] = True
        a, b = home[u[edge]], home[v[edge]]
        hook = np.arange(n)
        hook[part] = np.where(a == part, b, a)
        # of two parts that take the same edge the smaller is the end of the chain
        ends = part[(hook[hook[part]] == part) & (part < hook[part])]
        hook[ends] = ends
        while (hook != (far := hook[hook])).any():
            hook = far
        home = hook[home]
    return picked, home


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[:, :, 0:1] * b[:, 0:1, :] + a[:, :, 1:2] * b[:, 1:2, :] + a[:, :, 2:3] * b[:, 2:3, :]


def _inverse(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverses of (n, 3, 3), and which there are: as matrices.inverse()."""

    def cofactor(r: int, q: int) -> np.ndarray:
        (i, j), (s, t) = ((r + 1) % 3, (r + 2) % 3), ((q + 1) % 3, (q + 2) % 3)
        return m[:, i, s] * m[:, j, t] - m[:, i, t] * m[:, j, s]

    d = sum((m[:, 0, k] * cofactor(0, k) for k in range(3)), np.zeros(len(m)))
    with np.errstate(all="ignore"):
        return np.stack([cofactor(q, r) / d for r in range(3) for q in range(3)], axis=1).reshape(-1, 3, 3), np.abs(d) > 1e-12


def _solved(fine: DataFrame, keys: list[str], score: str, order: str, steps: bool = False) -> DataFrame:
    """keys, tile, root, parent, order of every tile of small captures, and `transform` where the edges have steps.

    A root has no parent and no edge; the others have the edge to the end that is nearer to the root.
    """
    kind = lambda name: fine.schema[name].dataType
    entries = [f"_h{k}" for k in range(9)]
    plain = [c(k) for k in keys] + [c("from").alias("_u"), c("to").alias("_v"), c(score).alias("_score"), c(order).alias("_edge")]
    more = [c("h")[k].alias(n) for k, n in enumerate(entries)] + [c("dx").cast("double").alias("_dx"), c("dy").cast("double").alias("_dy")] if steps else []
    fields = [T.StructField(k, kind(k)) for k in keys] + [T.StructField(n, kind("from")) for n in ("tile", "root", "parent")] + [T.StructField("_edge", kind(order)), T.StructField("_top", T.BooleanType())]
    fields += [T.StructField(n, T.DoubleType()) for n in entries] if steps else []

    def run(f: pd.DataFrame) -> pd.DataFrame:
        group, m = f["_group"].to_numpy(), len(f)
        code, tiles = pd.factorize(pd.concat([f["_u"], f["_v"]], ignore_index=True), sort=True)
        nodes, at = np.unique(np.r_[group, group] * len(tiles) + code, return_inverse=True)
        u, v, n = at[:m], at[m:], len(nodes)
        rank = np.empty(m, np.int64)
        # of equal scores the greater number is better; NaN is the greatest, as in Spark
        rank[np.lexsort((pd.factorize(f["_edge"], sort=True)[0], f["_score"].to_numpy(float)))] = np.arange(m)
        picked, home = _best_edges(u, v, rank, n)
        # nodes are in the order of captures and tiles, so a component's first is its smallest tile
        root = np.full(n, n)
        np.minimum.at(root, home, np.arange(n))
        root = root[home]
        parent, edge = np.arange(n), np.zeros(n, np.int64)
        placed = root == parent
        turned = np.tile(np.eye(3), (n, 1, 1))
        if steps:
            h = f[entries].to_numpy(float).reshape(-1, 3, 3)
            back, fine = _inverse(h)
            shift = np.tile(np.eye(3), (m, 1, 1))
            shift[:, 0, 2], shift[:, 1, 2] = -f["_dx"].to_numpy(float), -f["_dy"].to_numpy(float)
            back = np.where(fine[:, None, None], back, shift)
        live = np.flatnonzero(picked)
        while len(live):
            near = placed[u[live]] | placed[v[live]]
            now, live = live[near], live[~near]
            away = placed[u[now]]
            top, tile = np.where(away, u[now], v[now]), np.where(away, v[now], u[now])
            parent[tile], edge[tile], placed[tile] = top, now, True
            if steps:
                turned[tile] = _product(turned[top], np.where(away[:, None, None], back[now], h[now]))
        first = np.searchsorted(group, nodes // len(tiles))
        out = f[keys].iloc[first].reset_index(drop=True)
        name = lambda i: np.asarray(tiles)[nodes[i] % len(tiles)]
        out = out.assign(tile=name(np.arange(n)), root=name(root), parent=name(parent), _edge=f["_edge"].to_numpy()[edge], _top=parent == np.arange(n))
        return pd.concat([out, pd.DataFrame(turned.reshape(-1, 9), columns=entries)], axis=1) if steps else out

    got = in_batches(fine.select(*plain, *more), keys, run, T.StructType(fields))
    made = [*keys, "tile", "root", F.when(~c("_top"), c("parent")).alias("parent"), F.when(~c("_top"), c("_edge")).alias(order)]
    return got.select(*made, *([F.array(*entries).alias("transform")] if steps else []))


def rooted(edges: DataFrame, keys: list[str], score: str = "score", order: str = "edge") -> DataFrame:
    """keys, tile, root, parent, order of every tile with an edge: in the spanning forest of its capture the tile one nearer to the root and the edge to it, nulls at a root."""
    small, large = _fine(edges, keys, score, order)
    out = _solved(small, keys, score, order)
    if large is None:
        return out
    forest, home = _grown(large, keys, score, order)
    above = parents(forest, home, keys).select(*keys, "tile", "parent", order)
    return out.unionByName(home.join(above, [*keys, "tile"], "left").select(*out.columns))


def spanning_forest(edges: DataFrame, keys: list[str], score: str = "score", order: str = "edge") -> tuple[DataFrame, DataFrame]:
    """(the edges of the forest, keys and tile and root of every tile with an edge): of each capture (keys) the maximum-confidence spanning forest.

    edges: keys, `from`, `to`, a score and a number that is unique in its capture. Of equal scores the greater number
    is better, so the forest is the one that greedy growth from any tile finds. Edges from a tile to itself, without a score
    or without an end have no part. A root is the smallest tile of its component.
    """
    tiles = written(rooted(edges, keys, score, order), "tiles")
    return edges.join(tiles.select(*keys, order), [*keys, order], "left_semi"), tiles.select(*keys, "tile", "root")


def _grown(fine: DataFrame, keys: list[str], score: str, order: str) -> tuple[DataFrame, DataFrame]:
    """spanning_forest() of captures of any size, round by round in Spark, of edges that have part in one."""
    edges = fine
    live = written(fine.select(*keys, c("from").alias("a"), c("to").alias("b"), F.struct(c(score).alias("score"), c(order).alias("edge")).alias("rank")), "live")
    home = written(live.select(*keys, F.explode(F.array("a", "b")).alias("tile")).distinct().withColumn("root", c("tile")), "home")
    picked = live.select(*keys, c("rank.edge").alias(order)).where("false")
    while not live.isEmpty():
        ends = live.select(*keys, c("a").alias("part"), c("b").alias("other"), "rank").unionByName(live.select(*keys, c("b").alias("part"), c("a").alias("other"), "rank"))
        best = written(ends.groupBy(*keys, "part").agg(F.max_by("other", "rank").alias("other"), F.max("rank.score").alias("score"), F.max("rank").alias("rank")), "best")
        picked = picked.unionByName(best.select(*keys, c("rank.edge").alias(order)))
        # of two parts that take the same edge the smaller is the end of the chain
        back = best.select(*keys, c("part").alias("other"), c("other").alias("_back"))
        hooks = best.join(back, [*keys, "other"]).select(*keys, "part", F.when((c("_back") == c("part")) & (c("part") < c("other")), c("part")).otherwise(c("other")).alias("root"))
        hooks = _to_roots(written(hooks, "hooks"), keys, "part", "root")
        to = lambda end: hooks.select(*keys, c("part").alias(end), c("root").alias(f"_{end}"))  # noqa: B023, E731
        live = written(live.join(to("a"), [*keys, "a"]).join(to("b"), [*keys, "b"]).where("_a <> _b").select(*keys, c("_a").alias("a"), c("_b").alias("b"), "rank"), "live")
        moved = hooks.select(*keys, c("part").alias("root"), c("root").alias("_root"))
        home = written(home.join(moved, [*keys, "root"], "left").select(*keys, "tile", F.coalesce("_root", "root").alias("root")), "home")
    least = home.groupBy(*keys, "root").agg(F.min("tile").alias("_least"))
    home = home.join(least, [*keys, "root"]).select(*keys, "tile", c("_least").alias("root"))
    return edges.join(picked.distinct(), [*keys, order], "left_semi"), written(home, "home")


def parents(forest: DataFrame, home: DataFrame, keys: list[str]) -> DataFrame:
    """The forest's edges with `parent` and `tile`: which end is nearer to the root.

    An Euler tour of each tree is a list of its edges taken both ways; doubling ranks the list, and an edge
    is first walked away from the root.
    """
    there = forest.select(*keys, c("from").alias("u"), c("to").alias("v"))
    arcs = there.unionByName(there.select(*keys, c("v").alias("u"), c("u").alias("v"))).join(home.select(*keys, c("tile").alias("u"), "root"), [*keys, "u"])
    around = W.partitionBy(*keys, "u").orderBy("v")
    turned = written(arcs.withColumns({"_next": F.lead("v").over(around), "_first": F.first("v").over(around)}), "arcs")
    # after u -> v comes v -> the neighbour of v after u; at the root the tour ends instead of beginning again
    after = turned.select(*keys, c("u").alias("v"), c("v").alias("u"), F.when(c("_next").isNotNull(), c("_next")).when(c("u") != c("root"), c("_first")).alias("_nv"))
    tour = turned.select(*keys, "u", "v").join(after, [*keys, "u", "v"])
    tour = written(tour.select(*keys, "u", "v", F.when(c("_nv").isNotNull(), c("v")).alias("nu"), c("_nv").alias("nv"), F.when(c("_nv").isNotNull(), 1).otherwise(0).cast("long").alias("left")), "tour")
    while not tour.where("nv is not null").isEmpty():
        far = tour.select(*keys, c("u").alias("nu"), c("v").alias("nv"), c("nu").alias("_nu"), c("nv").alias("_nv"), c("left").alias("_left"))
        tour = written(tour.join(far, [*keys, "nu", "nv"], "left").select(*keys, "u", "v", c("_nu").alias("nu"), c("_nv").alias("nv"), (c("left") + F.coalesce("_left", F.lit(0))).alias("left")), "tour")
    away = forest.join(tour.select(*keys, c("u").alias("from"), c("v").alias("to"), c("left").alias("_out")), [*keys, "from", "to"])
    away = away.join(tour.select(*keys, c("u").alias("to"), c("v").alias("from"), c("left").alias("_in")), [*keys, "from", "to"])
    first = c("_out") > c("_in")
    return away.withColumns({"parent": F.when(first, c("from")).otherwise(c("to")), "tile": F.when(first, c("to")).otherwise(c("from"))}).drop("_out", "_in")


def along_paths(steps: DataFrame, home: DataFrame, keys: list[str], product: Callable[[Column, Column], Column] = matrices.product) -> DataFrame:
    """keys, tile, root, transform: the product of the steps (keys, parent, tile, step) from the root down to every tile."""
    tops = home.where("tile = root").select(*keys, "tile", F.lit(None).cast(steps.schema["parent"].dataType).alias("up"), F.array(*map(F.lit, UNIT)).alias("m"))
    now = written(steps.select(*keys, "tile", c("parent").alias("up"), c("step").alias("m")).unionByName(tops), "paths")
    while not now.where("up is not null").isEmpty():
        far = now.select(*keys, c("tile").alias("up"), c("up").alias("_up"), c("m").alias("_m"))
        now = now.join(far, [*keys, "up"], "left").select(*keys, "tile", c("_up").alias("up"), F.when(c("_m").isNull(), c("m")).otherwise(product(c("_m"), c("m"))).alias("m"))
        now = written(now, "paths")
    return home.join(now.select(*keys, "tile", c("m").alias("transform")), [*keys, "tile"]).select(*keys, "tile", "root", "transform")


def propagated(edges: DataFrame, keys: list[str], score: str = "score", order: str = "edge") -> DataFrame:
    """keys, tile, root, transform of every tile with an edge: the homographies along its capture's maximum-confidence spanning forest.

    edges has also `h`, a homography from `from` to `to` of nine numbers, and its shift dx, dy, which stands for a homography
    without an inverse. A root has the unit transform.
    """
    small, large = _fine(edges, keys, score, order)
    out = _solved(small, keys, score, order, steps=True).select(*keys, "tile", "root", "transform")
    if large is None:
        return out
    forest, home = _grown(large, keys, score, order)
    back = F.coalesce("_i", F.array(F.lit(1.0), F.lit(0.0), -c("dx"), F.lit(0.0), F.lit(1.0), -c("dy"), F.lit(0.0), F.lit(0.0), F.lit(1.0)))
    steps = parents(forest, home, keys).withColumn("_i", matrices.inverse(c("h"))).withColumn("step", F.when(c("parent") == c("from"), back).otherwise(c("h")))
    return out.unionByName(along_paths(steps.select(*keys, "parent", "tile", "step"), home, keys))


def analytic(cells: DataFrame, keys: list[str], across: Column, down: Column) -> DataFrame:
    """cells (keys, row, column) with `rotation`: the turn `across` as often as its column times the turn `down` as often as its row.

    Both are rotation vectors, so a power is a multiple of the vector: rows stay level where columns turn.
    """
    times = lambda v, n: matrices.rotation(F.transform(v, lambda x: x * n))
    turned = cells.withColumns({"_h": times(across, c("column")), "_v": times(down, c("row"))})
    return turned.withColumn("rotation", matrices.product(c("_h"), c("_v"))).drop("_h", "_v")


def recentred(poses: DataFrame, keys: list[str]) -> DataFrame:
    """poses (keys, row, column, rotation) turned so that the upper left of the grid's central cells looks straight ahead.

    Every rotation is multiplied from the left by the transpose of that cell's, so what lies between any two poses stays.
    A grid that lacks its central cell has no row.
    """
    size = poses.groupBy(*keys).agg(F.expr("max(row) div 2").alias("row"), F.expr("max(column) div 2").alias("column"))
    centre = size.join(poses, [*keys, "row", "column"]).select(*keys, matrices.transpose(c("rotation")).alias("_turn"))
    there = poses.join(centre, keys) if keys else poses.crossJoin(F.broadcast(centre))
    return there.withColumn("rotation", matrices.product(c("_turn"), c("rotation"))).drop("_turn")


#: The cutoff of a step's samples in radians, the least angle of a step, and what an estimated edge weighs beside a typical one.
STEP_FLOOR, LEAST_STEP, ESTIMATED, LEAST_WEIGHT, MOST_WEIGHT = 0.005, 1e-6, 0.001, 1e-5, 0.01


def robust_steps(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, vector, rotation, samples, rms: the robust middle of each group's rotations.

    Medians by axis of the rotation vectors, a cutoff of max(0.005, median + 3 * 1.4826 * MAD) on the distances from them, medians of what is
    left, and the root mean square of the angles between those and the middle. Rows without a rotation have no part.
    """
    vectors = edges.where(c("rotation").isNotNull()).select(*keys, "rotation", matrices.rotation_log(c("rotation")).alias("_v"))
    small, large = by_size(vectors, keys, SMALL)
    out = _middles(small, keys)
    return out if large is None else out.unionByName(_middles_of_large(large, keys))


def _middles(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """robust_steps() of small groups, from (keys, rotation, _v): many of them at a time, as arrays."""
    axes, entries = [f"_v{k}" for k in range(3)], [f"_r{k}" for k in range(9)]
    fields = [vectors.schema[k] for k in keys] + [T.StructField(n, T.DoubleType()) for n in (*axes, *entries)] + [T.StructField("samples", T.LongType()), T.StructField("rms", T.DoubleType())]

    def medians(v: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
        """Of each of the n groups the median of its numbers, NaN where it has none."""
        group, v = group[~np.isnan(v)], v[~np.isnan(v)]
        v = v[np.lexsort((v, group))]
        size = np.bincount(group, minlength=n)
        start = np.cumsum(size) - size
        mid = lambda k: v[np.minimum(start + k, max(len(v) - 1, 0))] if len(v) else np.zeros(n)
        return np.where(size > 0, (mid(np.maximum(size - 1, 0) // 2) + mid(size // 2)) / 2, np.nan)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        group, v = f["_group"].to_numpy(), f[axes].to_numpy(float)
        n = int(group[-1]) + 1
        middle = lambda v, group: np.stack([medians(v[:, k], group, n) for k in range(3)], axis=1)
        with np.errstate(all="ignore"):
            off = v - middle(v, group)[group]
            far = np.sqrt(off[:, 0] ** 2 + off[:, 1] ** 2 + off[:, 2] ** 2)
            spread = medians(far, group, n)
            mad = medians(np.abs(far - spread[group]), group, n)
            near = far <= np.maximum(STEP_FLOOR, spread + 3 * 1.4826 * mad)[group]
            group, v, own = group[near], v[near], f[entries].to_numpy(float)[near].reshape(-1, 3, 3)
            vector = middle(v, group)
            turn = _rotations(vector)
            d = _product(turn.transpose(0, 2, 1)[group], own)
            x, y, z = d[:, 2, 1] - d[:, 1, 2], d[:, 0, 2] - d[:, 2, 0], d[:, 1, 0] - d[:, 0, 1]
            angle = np.arctan2(np.sqrt(x * x + y * y + z * z), d[:, 0, 0] + d[:, 1, 1] + d[:, 2, 2] - 1)
            samples = np.bincount(group, minlength=n)
            rms = np.sqrt(np.bincount(group, weights=angle * angle, minlength=n) / samples)
        some = np.flatnonzero(samples)
        first = np.searchsorted(f["_group"].to_numpy(), some)
        out = f[keys].iloc[first].reset_index(drop=True)
        return pd.concat([out, pd.DataFrame(np.c_[vector, turn.reshape(-1, 9)][some], columns=[*axes, *entries])], axis=1).assign(samples=samples[some], rms=rms[some])

    rows = vectors.select(*keys, *[c("_v")[k].alias(n) for k, n in enumerate(axes)], *[c("rotation")[k].alias(n) for k, n in enumerate(entries)])
    got = in_batches(rows, keys, run, T.StructType(fields))
    return got.select(*keys, F.array(*axes).alias("vector"), F.array(*entries).alias("rotation"), "samples", "rms")


def _rotations(v: np.ndarray) -> np.ndarray:
    """matrices.rotation() of vectors (n, 3)."""
    x, y, z = v.T
    t = np.sqrt(x * x + y * y + z * z)
    s, k = np.where(t > 1e-9, np.sin(t) / t, 1 - t * t / 6), np.where(t > 1e-9, (1 - np.cos(t)) / (t * t), 0.5 - t * t / 24)
    u = 1 - k * t * t
    return np.stack([u + k * x * x, k * x * y - s * z, k * x * z + s * y, k * x * y + s * z, u + k * y * y, k * y * z - s * x, k * x * z - s * y, k * y * z + s * x, u + k * z * z], axis=1).reshape(-1, 3, 3)


def _middles_of_large(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """robust_steps() of groups of any size, from (keys, rotation, _v): by counts of buckets and joins in Spark."""

    def middle(rows: DataFrame, name: str) -> DataFrame:
        axes = F.explode(F.array(*[F.struct(F.lit(k).alias("_axis"), c("_v")[k].alias("_w")) for k in range(3)]))
        med = robust.medians(rows.select(*keys, axes.alias("_a")).select(*keys, "_a.*"), [*keys, "_axis"], "_w")
        of = [F.max(F.when(c("_axis") == k, c("median"))) for k in range(3)]
        return written(med.groupBy(*keys).agg(F.array(*of).alias(name), F.max("n").alias("samples")), "middles")

    def apart(a: Column, b: Column) -> Column:
        return F.sqrt(sum(((a[k] - b[k]) * (a[k] - b[k]) for k in range(3)), F.lit(0.0)))

    far = vectors.join(middle(vectors, "_m").drop("samples"), keys).withColumn("_r", apart(c("_v"), c("_m")))
    spread = written(robust.median_mad(far, keys, "_r").select(*keys, c("median").alias("_mr"), "mad"), "spread")
    near = far.join(spread, keys).where(c("_r") <= F.greatest(F.lit(STEP_FLOOR), c("_mr") + 3 * 1.4826 * c("mad"))).select(*keys, "rotation", "_v")
    fit = middle(near, "vector")
    fit = written(fit.withColumn("_t", matrices.rotation(c("vector"))), "fits")
    off = near.join(fit, keys).withColumn("_back", matrices.transpose(c("_t"))).withColumn("_d", matrices.product(c("_back"), c("rotation")))
    rms = off.withColumn("_a", matrices.rotation_angle(c("_d"))).groupBy(*keys).agg(F.sqrt(F.avg(c("_a") * c("_a"))).alias("rms"))
    return fit.join(rms, keys).select(*keys, "vector", c("_t").alias("rotation"), "samples", "rms")


def synthesized(cells: DataFrame, edges: DataFrame, keys: list[str], widest: dict[str, float], nominal: dict[str, list[float]] | None = None) -> DataFrame:
    """keys, from, to, axis, rotation, weight, source, samples, rms of the neighbour edges that a grid lacks.

    cells: keys, row, column, columns, placed; edges: keys, from, to, rotation, weight, a tile's number being row * columns + column. An edge between two placed cells
    (those that visual edges join to the root) is not needed. Its rotation is the robust middle of its row (`horizontal`) or column (`vertical`), else of
    its axis in the capture, if that turns by more than 1e-6 and less than widest[axis]; else the `nominal` rotation of the axis, and without one null
    (source `none`): such a capture can't be placed. Its weight is a thousandth of the capture's median, from 1e-5 to 0.01; 0.001 without edges.
    """
    tile = c("row") * c("columns") + c("column")
    ends = cells.select(*keys, "row", "column", "columns", tile.cast("long").alias("tile"), "placed")
    other = ends.select(*keys, c("tile").alias("to"), c("placed").alias("_there"))
    ways = F.explode(F.array(F.struct(F.lit("horizontal").alias("axis"), (c("tile") + 1).alias("to"), c("row").alias("line")), F.struct(F.lit("vertical").alias("axis"), (c("tile") + c("columns")).alias("to"), c("column").alias("line"))))
    pairs = ends.select(*keys, c("tile").alias("from"), "placed", "column", "columns", ways.alias("_w")).select(*keys, "from", "placed", "column", "columns", "_w.*")
    pairs = pairs.where("axis = 'vertical' or column + 1 < columns").join(other, [*keys, "to"])
    known = edges.where(c("rotation").isNotNull()).select(*keys, "from", "to", "rotation", "weight")
    seen = known.join(pairs.select(*keys, "from", "to", "axis", "line"), [*keys, "from", "to"])
    # the axis of a whole capture is a line of its own
    lines = seen.select(*keys, "axis", F.explode(F.array(c("line").cast("long"), F.lit(-1).cast("long"))).alias("line"), "rotation")
    steps = robust_steps(lines, [*keys, "axis", "line"])
    angle = matrices.rotation_angle(c("rotation"))
    most = F.coalesce(*[F.when(c("axis") == k, F.lit(v)) for k, v in widest.items()])
    usable = written(steps.where((angle > LEAST_STEP) & (angle < most)).select(*keys, "axis", "line", "rotation", "samples", "rms"), "steps")
    whole = usable.where("line = -1").select(*keys, "axis", c("rotation").alias("_r"), c("samples").alias("_n"), c("rms").alias("_e"))
    heavy = robust.medians(known.where((F.abs("weight") < float("inf"))), keys, "weight").drop("n")
    lacking = pairs.where(~(c("placed") & c("_there"))).join(known.select(*keys, "from", "to"), [*keys, "from", "to"], "left_anti").select(*keys, "from", "to", "axis", c("line").cast("long").alias("line"))
    out = lacking.join(usable, [*keys, "axis", "line"], "left").join(whole, [*keys, "axis"], "left").join(heavy, keys, "left")
    spare = F.coalesce(*[F.when(c("axis") == k, F.array(*map(F.lit, v))) for k, v in (nominal or {}).items()], F.lit(None).cast("array<double>"))
    own, all_ = c("rotation").isNotNull(), c("_r").isNotNull()
    source = F.when(own, "line").when(all_, "axis").when(spare.isNotNull(), "nominal").otherwise("none")
    weight = F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce("median", F.lit(1.0)) * ESTIMATED))
    return out.select(*keys, "from", "to", "axis", F.coalesce("rotation", "_r", spare).alias("rotation"), weight.alias("weight"), source.alias("source"), F.when(own, c("samples")).when(all_, c("_n")).alias("samples"), F.when(own, c("rms")).when(all_, c("_e")).alias("rms"))
