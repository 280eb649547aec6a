"""3 x 3 matrices as arrays of nine doubles, rotations, projective transforms, sampling and source-plane warps.

Functions read the entries of their arguments many times: give them columns, not long expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def product(a: Column, b: Column) -> Column:
    return F.array(*[a[3 * r] * b[c] + a[3 * r + 1] * b[3 + c] + a[3 * r + 2] * b[6 + c] for r in range(3) for c in range(3)])


def transpose(a: Column) -> Column:
    return F.array(*[a[3 * c + r] for r in range(3) for c in range(3)])


def _cofactor(a: Column, r: int, c: int) -> Column:
    (p, q), (s, t) = ((r + 1) % 3, (r + 2) % 3), ((c + 1) % 3, (c + 2) % 3)
    return a[3 * p + s] * a[3 * q + t] - a[3 * p + t] * a[3 * q + s]


def determinant(a: Column) -> Column:
    return a[0] * _cofactor(a, 0, 0) + a[1] * _cofactor(a, 0, 1) + a[2] * _cofactor(a, 0, 2)


def inverse(a: Column) -> Column:
    """Null where the determinant is next to 0."""
    d = determinant(a)
    return F.when(F.abs(d) > 1e-12, F.array(*[_cofactor(a, c, r) / d for r in range(3) for c in range(3)]))


def rotation(vector: Column) -> Column:
    """The rotation about a vector by its length; length and factors are lambda variables, so that they are computed once a row."""

    def sized(v: Column) -> Column:
        return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"), F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("t"))

    def factors(p: Column) -> Column:
        t = p["t"]
        s = F.when(t > 1e-9, F.sin(t) / t).otherwise(1 - t * t / 6)
        k = F.when(t > 1e-9, (1 - F.cos(t)) / (t * t)).otherwise(0.5 - t * t / 24)
        return F.struct(*[p[n].alias(n) for n in "xyzt"], s.alias("s"), k.alias("k"))

    def entries(p: Column) -> Column:
        x, y, z, t, s, k = (p[n] for n in "xyztsk")
        u = 1 - k * t * t
        return F.array(u + k * x * x, k * x * y - s * z, k * x * z + s * y, k * x * y + s * z, u + k * y * y, k * y * z - s * x, k * x * z - s * y, k * y * z + s * x, u + k * z * z)

    return F.transform(F.transform(F.transform(F.array(vector), sized), factors), entries)[0]


def rotation_log(a: Column) -> Column:
    """The vector of a rotation by less than half a turn."""
    t = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a[0] + a[4] + a[8] - 1) / 2)))
    k = F.when(t > 1e-7, t / (2 * F.sin(t))).otherwise(0.5)
    return F.array(k * (a[7] - a[5]), k * (a[2] - a[6]), k * (a[3] - a[1]))


def rotation_angle(a: Column) -> Column:
    """By how much a rotation turns, from 0 to half a turn; exact at both ends."""
    x, y, z = a[7] - a[5], a[2] - a[6], a[3] - a[1]
    return F.atan2(F.sqrt(x * x + y * y + z * z), a[0] + a[4] + a[8] - 1)


def applied(h: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point through a projective transform; nulls where it is on the horizon."""
    w = h[6] * x + h[7] * y + h[8]
    seen = F.abs(w) > 1e-12
    return F.when(seen, (h[0] * x + h[1] * y + h[2]) / w), F.when(seen, (h[3] * x + h[4] * y + h[5]) / w)


def normalized(h: Column) -> Column:
    return F.when(F.abs(h[8]) > 1e-12, F.transform(h, lambda v: v / h[8]))


def is_safe(h: Column, width: Column, height: Column) -> Column:
    """Whether a transform has an inverse, keeps a picture's corners, an area over 1e-6, and a scale of 0.1 to 10."""
    zero = F.lit(0.0)
    corners = [applied(h, x, y) for x, y in ((zero, zero), (width, zero), (width, height), (zero, height))]
    area = sum((x0 * y1 - x1 * y0 for (x0, y0), (x1, y1) in zip(corners, corners[1:] + corners[:1])), F.lit(0.0))
    scale = F.sqrt(F.abs(area) / 2 / (width * height))
    return F.coalesce((F.abs(determinant(h)) > 1e-12) & (F.abs(area) / 2 > 1e-6) & scale.between(0.1, 10), F.lit(False))


def bilinear(points: DataFrame, pixels: DataFrame) -> DataFrame:
    """points (id, x, y) with `v` of the four pixels (x, y, v) around them by distance; null unless all that weigh are there."""
    c = F.col
    taps = points.select("id", F.floor("x").alias("x0"), F.floor("y").alias("y0"), (c("x") - F.floor("x")).alias("u"), (c("y") - F.floor("y")).alias("w"))
    four = [F.struct((c("x0") + i).alias("x"), (c("y0") + j).alias("y"), ((c("u") if i else 1 - c("u")) * (c("w") if j else 1 - c("w"))).alias("weight")) for i in (0, 1) for j in (0, 1)]
    taps = taps.select("id", F.explode(F.array(*four)).alias("t")).select("id", "t.*").where("weight > 0")
    return taps.join(pixels, ["x", "y"], "left").groupBy("id").agg(F.when(F.count("v") == F.count("*"), F.sum(c("v") * c("weight"))).alias("v"))


def undistorted(x: Column, y: Column, k1: float, k2: float, p1: float, p2: float) -> tuple[Column, Column]:
    """Where a lens puts a point of the ideal image plane: radial and tangential distortion."""
    r = x * x + y * y
    radial = 1 + k1 * r + k2 * r * r
    return x * radial + 2 * p1 * x * y + p2 * (r + 2 * x * x), y * radial + p1 * (r + 2 * y * y) + 2 * p2 * x * y


def source_place(kind: str, x: Column, y: Column, focal: float, cx: float, cy: float) -> tuple[Column, Column]:
    """The pixel of the flat source that a pixel of a planar, cylindrical or spherical output shows; nulls behind the camera."""
    u, v = (x - cx) / focal, (y - cy) / focal
    if kind == "planar":
        return x, y
    ahead = F.cos(u) > 1e-6
    if kind == "cylindrical":
        return F.when(ahead, cx + focal * F.tan(u)), F.when(ahead, cy + focal * v / F.cos(u))
    return F.when(ahead, cx + focal * F.tan(u)), F.when(ahead & (F.abs(v) < 1.5707), cy + focal * F.tan(v) / F.cos(u))


def warp_offset(offsets: Column, n: int, width: Column, height: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """The displacement of a source pixel by an n x n control grid, an array of (dx, dy) row by row."""
    gx, gy = x * (n - 1) / (width - 1), y * (n - 1) / (height - 1)
    i, j = F.least(F.floor(gx), F.lit(n - 2)).cast("int"), F.least(F.floor(gy), F.lit(n - 2)).cast("int")
    u, v = gx - i, gy - j
    at = lambda r, c, k: F.element_at(F.element_at(offsets, (j + r) * n + i + c + 1), k)
    one = lambda k: (at(0, 0, k) * (1 - u) + at(0, 1, k) * u) * (1 - v) + (at(1, 0, k) * (1 - u) + at(1, 1, k) * u) * v
    inside = (x >= 0) & (y >= 0) & (x <= width - 1) & (y <= height - 1)
    return F.when(inside, one(1)), F.when(inside, one(2))


def warp_is_valid(warps: DataFrame, key: str, n: int, most: float = 64.0, strain: float = 0.10) -> DataFrame:
    """key, valid: n x n offsets of at most `most` pixels whose local strain is at most `strain` in every cell's corners."""
    c = F.col
    size = F.forall("offsets", lambda o: F.sqrt(o[0] * o[0] + o[1] * o[1]) <= most + 1e-9) & (F.size("offsets") == n * n)
    cells = warps.where(F.size("offsets") == n * n).select(key, "offsets", "width", "height", F.explode(F.sequence(F.lit(0), F.lit((n - 1) * (n - 1) - 1))).alias("cell"))
    first = F.expr(f"cast(cell div {n - 1} * {n} + cell % {n - 1} as int)")
    at = lambda r, q, k: F.element_at(F.element_at("offsets", first + r * n + q + 1), k)
    dx, dy = (c("width") - 1) / (n - 1), (c("height") - 1) / (n - 1)
    norms = []
    for u, v in ((0, 0), (1, 0), (0, 1), (1, 1)):
        a, b = ((at(v, 1, k) - at(v, 0, k)) / dx for k in (1, 2))
        d, e = ((at(1, u, k) - at(0, u, k)) / dy for k in (1, 2))
        total, det = a * a + b * b + d * d + e * e, a * e - b * d
        norms.append(F.sqrt((total + F.sqrt(F.greatest(total * total - 4 * det * det, F.lit(0.0)))) / 2))
    bent = cells.groupBy(key).agg(F.max(F.greatest(*norms)).alias("strain"))
    return warps.join(bent, key, "left").select(key, F.coalesce(size & (c("strain") <= strain + 1e-9), F.lit(False)).alias("valid"))


#: Rounds of the inverse warp, the step in pixels that ends it, and how near a round trip must come.
WARP_ROUNDS, WARP_STEP, WARP_NEAR = 8, 0.002, 0.02


def warp_inverse(offsets: Column, n: int, width: Column, height: Column, x: Column, y: Column) -> Column:
    """The source pixel (x, y) that an n x n control grid displaces to a corrected place; null outside the picture, where a round trip misses, or for a grid of another size.

    A fixed-point iteration as a fold over the rounds: place minus the displacement there. Iterates may leave the picture on
    the way; the displacement is then that of the nearest border. Give it columns, not long expressions.
    """
    right, bottom = (width - 1).cast("double"), (height - 1).cast("double")
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(v, most))
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))

    def step(s: Column, _: Column) -> Column:
        moved = F.transform(
            F.array(F.struct(inside(s["x"], right).alias("x"), inside(s["y"], bottom).alias("y"))),
            lambda p: F.struct(*[(a - d).alias(k) for k, a, d in zip("xy", (x, y), warp_offset(offsets, n, width, height, p["x"], p["y"]))]),
        )
        next_ = F.transform(moved, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), (F.hypot(p["x"] - s["x"], p["y"] - s["y"]) <= WARP_STEP).alias("done")))[0]
        return F.when(s["done"], s).otherwise(next_)

    start = F.struct(inside(x, right).alias("x"), inside(y, bottom).alias("y"), F.lit(False).alias("done"))

    def checked(p: Column) -> Column:
        dx, dy = warp_offset(offsets, n, width, height, p["x"], p["y"])
        return F.when(F.hypot(p["x"] + dx - x, p["y"] + dy - y) <= WARP_NEAR, F.struct(p["x"].alias("x"), p["y"].alias("y")))

    found = F.transform(F.array(F.aggregate(F.sequence(F.lit(1), F.lit(WARP_ROUNDS)), start, step)), checked)[0]
    return F.when(finite(x) & finite(y) & (F.size(offsets) == n * n) & (width >= 2) & (height >= 2), found)
