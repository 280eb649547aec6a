"""Camera geometry as column arithmetic: rays, rotation, projection and footprints."""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import by_size, dealt, named, once, pieces, written
from . import robust

#: Points of an edge that one task may hold; steps of a fit.
MOST_POINTS, STEPS = 1 << 14, 30


def ray(yaw: Column, pitch: Column) -> list[Column]:
    """Unit ray x right, y down, z ahead."""
    return [F.cos(pitch) * F.sin(yaw), -F.sin(pitch), F.cos(pitch) * F.cos(yaw)]


def angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """Yaw and pitch of a ray of any length."""
    return F.atan2(x, z), F.atan2(-y, F.sqrt(x * x + z * z))


def to_camera(world: list[Column], yaw: Column, pitch: Column) -> list[Column]:
    """A world ray in the axes of a camera that looks to yaw and pitch: the transpose of its rotation."""
    x, y, z = world
    ahead = x * F.sin(yaw) + z * F.cos(yaw)
    return [x * F.cos(yaw) - z * F.sin(yaw), y * F.cos(pitch) + ahead * F.sin(pitch), ahead * F.cos(pitch) - y * F.sin(pitch)]


def footprints(pixels: DataFrame, cameras: DataFrame, cone: float, bin_size: float = 0.25, shown: list[Column] | None = None) -> DataFrame:
    """pixel, camera, u, v, edge, weight, ownership of the cameras that see each pixel (pixel, yaw, pitch); with `shown` those columns made of the last five.

    cameras: camera, yaw, pitch, f, width, height. Rays and cameras that are alike are projected once for a piece of pixels: bands of pitch are an equi-join of
    distinct ones, then comes the cone, then the projection and `shown`; the pixels of the piece and the cameras are spread out last, and nothing is sent after that. Points behind the camera or outside its half-open bounds have no row. `edge` falls from 1 in the
    middle to 0 at the border; `weight` is smooth over the outer 8 % of the shorter side, `ownership` the distance to
    the border as a share of it, 0.5 at most.
    """
    rays, eyes = ["_yaw", "_pitch"], ["yaw", "pitch", "f", "width", "height"]
    by_ray = dealt(pixels.select("pixel", F.col("yaw").alias("_yaw"), F.col("pitch").alias("_pitch"), named("yaw", "pitch").alias("_ray")), "_ray")
    pix = pieces(by_ray, ["_ray", *rays], "pixel").select(*rays, F.col("values").alias("_pixels"), F.floor(F.col("_pitch") / bin_size).alias("_band"), *[c.alias(n) for c, n in zip(ray(F.col("_yaw"), F.col("_pitch")), ("px", "py", "pz"))])
    bands = F.sequence(F.floor((F.col("pitch") - cone) / bin_size), F.floor((F.col("pitch") + cone) / bin_size))
    cams = cameras.select(*eyes).distinct().select(*eyes, F.explode(bands).alias("_band"), *[c.alias(n) for c, n in zip(ray(F.col("yaw"), F.col("pitch")), ("cx", "cy", "cz"))])
    near = F.col("px") * F.col("cx") + F.col("py") * F.col("cy") + F.col("pz") * F.col("cz") >= math.cos(cone)
    x, y, z = to_camera([F.col("px"), F.col("py"), F.col("pz")], F.col("yaw"), F.col("pitch"))
    both = ["_pixels", *eyes]
    # distinct cameras are broadcast, some hundred bytes each, and the names of all: else Spark may broadcast the rays and leave one task
    seen = once(pix.join(F.broadcast(cams), "_band").where(near), both, x.alias("x"), y.alias("y"), z.alias("z")).where("z > 1e-5")
    placed = once(seen, both, (F.col("f") * F.col("x") / F.col("z") + F.col("width") / 2).alias("u"), (F.col("f") * F.col("y") / F.col("z") + F.col("height") / 2).alias("v"))
    inside = placed.where("u >= 0 and v >= 0 and u < width and v < height")
    edge = F.least(F.col("u"), F.col("width") - F.col("u")) / F.col("width") * 2 * F.least(F.col("v"), F.col("height") - F.col("v")) / F.col("height") * 2
    border, side = F.least("u", "v", F.col("width") - F.col("u"), F.col("height") - F.col("v")), F.least("width", "height")
    t = F.least(border / (side * 0.08), F.lit(1.0))
    met = inside.select(*both, "u", "v", edge.alias("edge"), (t * t * (3 - 2 * t)).alias("weight"), F.least(border / side, F.lit(0.5)).alias("ownership"))
    met = once(met, both, *(shown or map(F.col, ("u", "v", "edge", "weight", "ownership"))))
    values = [c for c in met.columns if c not in both]
    alike = cameras.groupBy(*eyes).agg(F.collect_list(F.struct("camera")).alias("_cameras"))
    spread = met.join(F.broadcast(alike), eyes).select(*values, "_cameras", F.inline("_pixels")).select("pixel", *values, F.inline("_cameras"))
    return spread.select("pixel", "camera", *values)


def neighbour_diagnostics(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """id, neighbour, disposition, residual: for every cell (id, row, column) what is known of the edges (from, to, disposition, residual) to the up to eight cells around it."""
    both = edges.select(F.col("from").alias("id"), F.col("to").alias("neighbour"), "disposition", "residual").unionByName(edges.select(F.col("to").alias("id"), F.col("from").alias("neighbour"), "disposition", "residual"))
    at = cells.select("id", "row", "column")
    there = cells.select(F.col("id").alias("neighbour"), F.col("row").alias("_r"), F.col("column").alias("_c"))
    beside = (F.abs(F.col("row") - F.col("_r")) <= 1) & (F.abs(F.col("column") - F.col("_c")) <= 1)
    found = both.join(at, "id").join(there, "neighbour").where(beside & (F.col("id") != F.col("neighbour")))
    return found.select("id", "neighbour", F.coalesce("disposition", F.lit("unknown")).alias("disposition"), "residual")


def fitted_rotations(points: DataFrame, keys: list[str], f: float, cx: float, cy: float, most: int = MOST_POINTS) -> DataFrame:
    """keys, rotation, median, rms: the rotation that takes the source rays of each edge's points (sx, sy, tx, ty) to the target rays.

    Gauss-Newton with weights that fall beyond 3 pixels, at most 30 steps; edges with fewer than 8 points, or a step of
    over half a radian, have no row. The median is the upper middle. An edge of at most `most` points is one group of a task; the normal
    equations of larger ones are summed in Spark, a run over their points for each step.
    """
    import numpy as np
    import pandas as pd

    def cross(v: np.ndarray) -> np.ndarray:
        zero = np.zeros(len(v))
        return np.stack([zero, -v[:, 2], v[:, 1], v[:, 2], zero, -v[:, 0], -v[:, 1], v[:, 0], zero], axis=1).reshape(-1, 3, 3)

    def stepped(turn: np.ndarray, normal: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float] | None:
        """The rotation after a step and the step's size; None where there is no step or too large a one."""
        if not abs(np.linalg.det(normal)) >= 1e-18:
            return None
        step = np.linalg.solve(normal, -right)
        size = np.linalg.norm(step)
        if not size <= 0.5:
            return None
        k = cross(step[None] / max(size, 1e-300))[0]
        return (np.eye(3) + np.sin(size) * k + (1 - np.cos(size)) * k @ k) @ turn, size

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({c: pd.Series([], dtype=object) for c in [*keys, "rotation", "median", "rms"]})
        if len(rows) < 8:
            return none
        rays = []
        for a in "st":
            v = np.stack([(rows[f"{a}x"] - cx) / f, -(rows[f"{a}y"] - cy) / f, np.ones(len(rows))], axis=1)
            rays.append(v / np.linalg.norm(v, axis=1, keepdims=True))
        turn = np.eye(3)
        for _ in range(STEPS):
            v = rays[0] @ turn.T
            off = v - rays[1]
            size = np.linalg.norm(off, axis=1) * f
            w = np.where(size > 3, 3 / np.maximum(size, 1e-300), 1.0)
            j = -cross(v)
            if (now := stepped(turn, np.einsum("n,nri,nrj->ij", w, j, j), np.einsum("n,nri,nr->i", w, j, off))) is None:
                return none
            turn, size = now
            if size < 1e-10:
                break
        off = np.sort(np.linalg.norm(rays[0] @ turn.T - rays[1], axis=1) * f)
        return pd.DataFrame({**{k: [x] for k, x in zip(keys, key)}, "rotation": [turn.ravel().tolist()], "median": [off[len(off) // 2]], "rms": [np.sqrt((off**2).mean())]})

    c = F.col
    kinds = T.StructType([points.schema[k] for k in keys])
    small, large = by_size(points.select(*keys, "sx", "sy", "tx", "ty"), keys, most)
    out = small.groupBy(*keys).applyInPandas(fit, T.StructType([*kinds, *[T.StructField(n, t) for n, t in (("rotation", T.ArrayType(T.DoubleType())), ("median", T.DoubleType()), ("rms", T.DoubleType()))]]))
    if large is None:
        return out

    def unit(x: Column, y: Column, *names: str) -> list[Column]:
        a, b = (x - cx) / f, -(y - cy) / f
        size = F.sqrt(a * a + b * b + 1)
        return [v.alias(n) for v, n in zip((a / size, b / size, 1 / size), names)]

    # the points of large edges as rays, which every step reads again; the edges are few, so their rotations are broadcast
    rays = written(large.select(*keys, *unit(c("sx"), c("sy"), *"abc"), *unit(c("tx"), c("ty"), *"pqr")), "rays")

    def met(state: DataFrame) -> DataFrame:
        """Every point's turned source ray x, y, z, what it is off by dx, dy, dz, and `off`, that in pixels."""
        m = c("rotation")
        turned = once(rays.join(F.broadcast(state), keys), [*keys, "p", "q", "r"], *[(m[3 * k] * c("a") + m[3 * k + 1] * c("b") + m[3 * k + 2] * c("c")).alias(n) for k, n in enumerate("xyz")])
        apart = once(turned, [*keys, *"xyz"], *[(c(n) - c(t)).alias(f"d{n}") for n, t in zip("xyz", "pqr")])
        return apart.withColumn("off", F.sqrt(c("dx") * c("dx") + c("dy") * c("dy") + c("dz") * c("dz")) * f)

    x, y, z, w = c("x"), c("y"), c("z"), F.when(c("off") > 3, 3 / c("off")).otherwise(1.0)
    # w times the products of -cross(v) with itself and with what is off
    sums = {"xx": y * y + z * z, "yy": x * x + z * z, "zz": x * x + y * y, "xy": -x * y, "xz": -x * z, "yz": -y * z, "rx": y * c("dz") - z * c("dy"), "ry": z * c("dx") - x * c("dz"), "rz": x * c("dy") - y * c("dx")}
    fields = T.StructType([*kinds, T.StructField("rotation", T.ArrayType(T.DoubleType())), T.StructField("done", T.BooleanType())])

    def solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            xx, yy, zz, xy, xz, yz = (g[n].to_numpy(float) for n in ("xx", "yy", "zz", "xy", "xz", "yz"))
            normal = np.stack([xx, xy, xz, xy, yy, yz, xz, yz, zz], axis=1).reshape(-1, 3, 3)
            now = [stepped(np.array(m).reshape(3, 3), a, b) for m, a, b in zip(g["rotation"], normal, g[["rx", "ry", "rz"]].to_numpy(float))]
            kept = [i for i, s in enumerate(now) if s is not None]
            if kept:
                yield g.iloc[kept][keys].assign(rotation=[now[i][0].ravel().tolist() for i in kept], done=[bool(now[i][1] < 1e-10) for i in kept])

    enough = rays.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n >= 8").select(*keys)
    state = written(enough.select(*keys, F.array(*[F.lit(float(k % 4 == 0)) for k in range(9)]).alias("rotation"), F.lit(False).alias("done")), "turns")
    for _ in range(STEPS):
        if (live := state.where("not done")).isEmpty():
            break
        summed = met(live.select(*keys, "rotation")).groupBy(*keys).agg(*[F.sum(w * v).alias(n) for n, v in sums.items()]).join(F.broadcast(live.select(*keys, "rotation")), keys)
        state = written(state.where("done").unionByName(summed.mapInPandas(solved, fields)), "turns")
    off = met(state.select(*keys, "rotation")).select(*keys, "off")
    middle = robust.upper_median(off, keys, "off").select(*keys, c("upper_median").alias("median"))
    rms = off.groupBy(*keys).agg(F.sqrt(F.avg(c("off") * c("off"))).alias("rms"))
    return out.unionByName(state.select(*keys, "rotation").join(middle, keys).join(rms, keys).select(*out.columns))


def unwrapped_bounds(rows: DataFrame, keys: list[str], yaw: str, origin: Column) -> DataFrame:
    """Least and greatest yaw of each group, unwrapped around an origin, so a group across the seam is not a full turn."""
    turned = F.pmod(F.col(yaw) - origin + math.pi, F.lit(2 * math.pi)) - math.pi + origin
    return rows.groupBy(*keys).agg(F.min(turned).alias("yaw_min"), F.max(turned).alias("yaw_max"))


def quad_is_safe(points: list[tuple[Column, Column]], scale: Column) -> Column:
    """Whether a transformed quadrilateral keeps an area over 1e-6 and a scale from 0.1 to 10."""
    area = None
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1]):
        part = x0 * y1 - x1 * y0
        area = part if area is None else area + part
    return (F.abs(area) / 2 > 1e-6) & scale.between(0.1, 10)
