"""Edges between neighbouring tiles: priors, acceptance, overlap estimates, loops and relaxation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import dealt, written
from . import matrices, robust

#: What an overlap sample must reach.
MIN_INLIERS, MIN_RATIO, MAX_RESIDUAL, MIN_OVERLAP, MAX_OVERLAP = 12, 0.25, 3.0, 0.05, 0.95


def expected_step(angle_a: Column, angle_b: Column, fov_a: Column, fov_b: Column, pixels: Column) -> Column:
    """Shift of the neighbour along its axis by the angles that were asked for: negative, null without both fields of view."""
    step = F.abs(angle_b - angle_a) / ((fov_a + fov_b) * 0.5) * pixels
    return F.when((fov_a > 0) & (fov_b > 0) & (step > 0) & (step < float("inf")), -step)


def nominal_step(measured: Column, pixels: Column, overlap: Column) -> Column:
    return F.coalesce(measured, -(pixels * (1 - overlap)))


def reason_label(reason: Column, matches: Column, inliers: Column) -> Column:
    by_code = F.when(reason == 1, "NO_DESCRIPTORS").when(reason == 2, "TOO_FEW_MUTUAL_RATIO_MATCHES").when(reason == 3, "RANSAC_FAILED")
    return by_code.when((matches > 0) & (inliers < 10), "LOW_INLIER_SUPPORT").otherwise("REGISTRATION_FAILED")


def accepted(horizontal: Column, dx: Column, dy: Column, expected_x: Column, expected_y: Column, matches: Column, inliers: Column, ratio: Column, width: Column, height: Column, least: int = 16) -> Column:
    """Whether a visual edge counts: enough support, and near its prior or at least like a neighbour's shift."""
    least = max(least, 16)
    prior = (F.abs(dx - expected_x) <= F.greatest(F.lit(24.0), width * 0.40)) & (F.abs(dy - expected_y) <= F.greatest(F.lit(18.0), height * 0.35))
    pick = lambda a, b: F.when(horizontal, a).otherwise(b)
    along, across, extent, cross, wanted = pick(dx, dy), pick(dy, dx), pick(width, height), pick(height, width), pick(expected_x, expected_y)
    like = (F.abs(along) >= 8) & (F.abs(along) <= extent * 0.95) & (F.abs(across) <= F.greatest(F.lit(18.0), cross * 0.45)) & ((F.abs(wanted) < 1e-6) | (F.signum(along) == F.signum(wanted)))
    return (matches >= least) & (inliers >= least) & (ratio >= 0.25) & (prior | like)


def overlap_status(samples: DataFrame, dimension: float) -> DataFrame:
    """samples (axis_step, cross_step, reason, inliers, ratio, residual) with `overlap` and `status`, the first rule that they break."""
    c = F.col
    size = F.abs("axis_step")
    out = samples.withColumn("overlap", 1 - size / dimension)
    cross, ahead = F.abs("cross_step") <= size * 0.15 + 2.0, c("axis_step") < 0
    inside, exact = c("overlap").between(MIN_OVERLAP, MAX_OVERLAP), c("residual") <= MAX_RESIDUAL
    enough = (c("inliers") >= MIN_INLIERS) & (c("ratio") >= MIN_RATIO)
    status = F.when((c("reason") == 0) & enough & exact & ahead & inside & cross, "accepted").when(~cross, "rejected-cross-axis-motion").when(~ahead, "rejected-grid-direction")
    status = status.when(~inside, "rejected-overlap-range").when(~exact, "rejected-reprojection-residual").when(~enough, "rejected-insufficient-inliers").otherwise("rejected-homography")
    return out.withColumn("status", status)


def overlap_estimate(samples: DataFrame, keys: list[str], dimension: float) -> DataFrame:
    """keys, accepted, step, overlap: the median step of the accepted samples where they agree, else null."""
    found = robust.axis_summary(overlap_status(samples, dimension), keys, "axis_step", F.col("status") == "accepted")
    step = F.when(F.col("reliable"), F.col("median"))
    return found.select(*keys, "accepted", step.alias("step"), (1 - F.abs(step) / dimension).alias("overlap"))


def central_pairs(grids: DataFrame, key: str, most: int = 12) -> DataFrame:
    """key, axis, from, to, place: of every grid (key, rows, columns) the neighbour pairs nearest to its centre on each axis.

    Two pairs beside the anchor cell (10, 10), or as near to it as the grid allows, come first.
    """
    c = F.col
    axes = F.explode(F.array(F.lit("horizontal"), F.lit("vertical")))
    cells = grids.where("rows > 0 and columns > 0").withColumn("axis", axes).withColumn("id", F.explode(F.sequence(F.lit(0).cast("long"), c("rows") * c("columns") - 1)))
    cells = cells.withColumns({"row": F.expr("id div columns"), "column": c("id") % c("columns"), "flat": c("axis") == "horizontal"})
    cells = cells.where((c("flat") & (c("column") < c("columns") - 1)) | (~c("flat") & (c("row") < c("rows") - 1)))
    half = lambda on: F.when(on, 0.5).otherwise(0.0)
    y = (c("row") + half(~c("flat")) - (c("rows") - 1) * 0.5) / c("rows")
    x = (c("column") + half(c("flat")) - (c("columns") - 1) * 0.5) / c("columns")
    anchor_row, anchor_column = F.greatest(F.lit(0), F.least(F.lit(10), c("rows") - 3)), F.greatest(F.lit(0), F.least(F.lit(10), c("columns") - 3))
    seed_x = c("flat") & (c("rows") > 1) & (c("columns") > 2) & (c("row") == anchor_row) & c("column").between(anchor_column, anchor_column + 1)
    seed_y = ~c("flat") & (c("rows") > 2) & (c("columns") > 1) & (c("column") == anchor_column) & c("row").between(anchor_row, anchor_row + 1)
    order = F.row_number().over(W.partitionBy(key, "axis").orderBy(F.desc("seed"), "far", "id"))
    placed = cells.withColumns({"far": F.when(seed_x | seed_y, 0.0).otherwise(x * x + y * y), "seed": seed_x | seed_y}).withColumn("place", order)
    to = c("id") + F.when(c("flat"), 1).otherwise(c("columns"))
    return placed.where(c("place") <= most).select(key, "axis", c("id").alias("from"), to.alias("to"), "place")


def loop_weights(edges: DataFrame, keys: list[str], columns: int, focal: float, limit: float = 12.0) -> DataFrame:
    """edges (keys, from, to, rotation, weight) with worst_loop, ambiguous and the weight after the loop rule.

    Around every elementary square of edges the rotations are composed: over the top and the right, and back over the bottom
    and the left. What they turn by in all, times the focal length, is the square's residual; one that is no number is left out. Beyond `limit` pixels the weakest of the four keeps a twentieth of its weight, unless the
    next is within 15 % of it: then all four are ambiguous, but for those that another loop has weakened.
    """
    c = F.col
    start = c("from")
    across, down = edges.where(c("to") == start + 1), edges.where(c("to") == start + columns)
    side = lambda df, shift, name: df.select(*keys, (start - shift).alias("cell"), F.struct("from", "to", "rotation", "weight").alias(name))
    on = [*keys, "cell"]
    loops = side(across, 0, "top").join(side(down, 1, "right"), on).join(side(across, columns, "bottom"), on).join(side(down, 0, "left"), on).where(c("cell") % columns < columns - 1)
    loops = loops.withColumns({"_way": matrices.product(c("top.rotation"), c("right.rotation")), "_back": matrices.product(c("left.rotation"), c("bottom.rotation"))})
    loops = loops.withColumn("_cycle", matrices.product(c("_way"), matrices.transpose(c("_back"))))
    residual = matrices.rotation_angle(c("_cycle")) * focal
    four = F.array_sort(F.array(*[F.struct(c(f"{s}.weight").alias("weight"), c(f"{s}.from").alias("from"), c(f"{s}.to").alias("to")) for s in ("top", "right", "bottom", "left")]))
    loops = loops.select(*keys, "cell", residual.alias("residual"), four.alias("four")).where("residual < double('infinity')")
    tied = F.element_at("four", 1)["weight"] >= F.element_at("four", 2)["weight"] * 0.85
    each = loops.withColumns({"bad": c("residual") > limit, "tied": tied}).select(*keys, "residual", "bad", "tied", F.posexplode("four").alias("rank", "e"))
    each = each.select(*keys, "residual", c("e.from").alias("from"), c("e.to").alias("to"), (c("bad") & ~c("tied") & (c("rank") == 0)).alias("weak"), (c("bad") & c("tied")).alias("unclear"))
    judged = each.groupBy(*keys, "from", "to").agg(F.max("residual").alias("worst_loop"), F.bool_or("weak").alias("weak"), F.bool_or("unclear").alias("unclear"))
    out = edges.join(judged, [*keys, "from", "to"], "left")
    weak = F.coalesce("weak", F.lit(False))
    return out.select(*edges.columns, "worst_loop", (F.coalesce("unclear", F.lit(False)) & ~weak).alias("ambiguous"), (c("weight") * F.when(weak, 0.05).otherwise(1.0)).alias("scaled"))


def thin_support(points: DataFrame, edges: DataFrame, width: float, height: float, most: int = 16, thin: float = 0.125, conflict: float = 48.0) -> DataFrame:
    """Edges (from, to, worst_loop) with `removed`: fewer than `most` distinct points (from, to, sx, sy, tx, ty), in
    both pictures within one row, column or cell of 8 x 8 and no wider than `thin` across, and a loop conflict of at least `conflict` pixels."""
    c = F.col
    cell = lambda v, size: F.least(F.greatest(F.floor(c(v) * 8 / size), F.lit(0)), F.lit(7)).cast("int")
    # a bit for each of the eight: distinct counts would send every point as often as there are counts
    places = lambda v, size: F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1), cell(v, size)))).cast("long")
    # dealt by edge first, so that neither the distinct points nor their counts are shuffled again
    once = dealt(points.select("from", "to", "sx", "sy", "tx", "ty"), "from", "to").distinct()
    shape = [F.count("*").alias("unique")]
    for p in "st":
        shape += [F.coalesce(places(f"{p}y", height), F.lit(0)).alias(f"{p}rows"), F.coalesce(places(f"{p}x", width), F.lit(0)).alias(f"{p}columns")]
        shape.append(F.least((F.max(f"{p}x") - F.min(f"{p}x")) / width, (F.max(f"{p}y") - F.min(f"{p}y")) / height).alias(f"{p}thin"))
    support = once.groupBy("from", "to").agg(*shape)
    flat = lambda p: ((c(f"{p}rows") <= 1) | (c(f"{p}columns") <= 1)) & (c(f"{p}thin") <= thin)
    removed = (c("worst_loop") >= conflict) & (c("unique") < most) & flat("s") & flat("t")
    return edges.join(support, ["from", "to"], "left").select(*edges.columns, "unique", F.coalesce(removed, F.lit(False)).alias("removed"))


def relaxed(nodes: DataFrame, edges: DataFrame, rounds: int = 80, keep: float = 0.35, fixed: int = 0) -> DataFrame:
    """Places (id, x) of nodes that edges (from, to, dx, w) pull: each round mixes a node's place with the weighted
    mean of what its neighbours say, x[from] - dx and x[to] + dx. The node `fixed` stays. A table is written every eighth round."""
    c = F.col
    both = edges.select(c("to").alias("id"), c("from").alias("other"), (-c("dx")).alias("off"), "w").unionByName(edges.select(c("from").alias("id"), c("to").alias("other"), c("dx").alias("off"), "w"))
    both, now = written(both, "pulls"), nodes.select("id", "x")
    for k in range(rounds):
        says = both.join(now.select(c("id").alias("other"), c("x").alias("there")), "other").groupBy("id").agg((F.sum((c("there") + c("off")) * c("w")) / F.sum("w")).alias("said"))
        moved = F.when(c("said").isNull() | (c("id") == fixed), c("x")).otherwise(c("x") * keep + c("said") * (1 - keep))
        now = now.join(says, "id", "left").select("id", moved.alias("x"))
        if k % 8 == 7 or k == rounds - 1:
            now = written(now, "places")
    return now


def synthesized(expected: DataFrame, edges: DataFrame, fallback: float) -> DataFrame:
    """All expected edges (from, to, line): the measured step where there is one, else the median of its line, else of all, else `fallback`."""
    known = expected.join(edges.select("from", "to", "step"), ["from", "to"], "left")
    line = robust.medians(known, ["line"], "step", "of_line").drop("n")
    whole = robust.medians(known, [], "step", "of_all").agg(F.max("of_all").alias("of_all"))
    out = known.join(line, "line", "left").crossJoin(F.broadcast(whole))
    kind = F.when(F.col("step").isNotNull(), "visual").when(F.col("of_line").isNotNull(), "line").when(F.col("of_all").isNotNull(), "all").otherwise("nominal")
    return out.select("from", "to", "line", F.coalesce("step", "of_line", "of_all", F.lit(fallback)).alias("step"), kind.alias("source"))


def chosen(edges: DataFrame, key: str, cells: str, p95: str, rms: str, *ties: str) -> DataFrame:
    """One row for each key: the representative edge (most hold-out cells, then lowest p95 and RMS) and the worst (highest p95, then RMS)."""
    low, high = F.coalesce(p95, F.lit(float("inf"))), F.coalesce(p95, F.lit(float("-inf")))
    low_rms, high_rms = F.coalesce(rms, F.lit(float("inf"))), F.coalesce(rms, F.lit(float("-inf")))
    row = F.struct(*ties)
    return edges.groupBy(key).agg(F.min_by(row, F.struct(-F.col(cells), low, low_rms, *ties)).alias("representative"), F.max_by(row, F.struct(high, high_rms, *[-F.col(t) for t in ties])).alias("worst"))
