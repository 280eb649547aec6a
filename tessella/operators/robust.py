"""Robust and weighted statistics of groups.

Three percentiles are told apart: the median that averages the middle pair, the upper median v[n / 2],
and the floor-index p95 v[(n - 1) * 95 / 100]; a fourth interpolates between neighbours. All are exact and
come from counts: a group is cut into buckets by sign and power of two, the bucket with a wanted rank into even buckets, these
again, until few rows are left to be put in order. A power of two has 2**52 doubles and a cut divides
by BUCKETS, so six rounds end it whatever the values, infinite ones included. No group, however large, is sorted or held in one task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import by_size, written

BUCKETS = 4096
#: Rows that one window may put in order.
CELL = 100_000


def _magnitude(v: Column) -> Column:
    """A whole number that never falls as v rises: the sign and the power of two; zero and the infinities have their own."""
    size = F.floor(F.log2(F.abs(v.cast("double")))) + 1100
    far = F.when(F.abs(v.cast("double")) == float("inf"), F.lit(9999)).otherwise(size)
    return F.when(v == 0, F.lit(0)).when(v > 0, far).otherwise(-far).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, cell: int = CELL, **index: str) -> DataFrame:
    """keys, n and, for each name, the value at that place (from 0, as SQL over the count n) of the sorted group.

    Nulls and NaN are left out, as are groups of nothing else and groups with a null key. Infinite values are in order like others.
    Groups of at most `cell` rows are shuffled once and put in order; larger ones are cut.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).alias("_v"))
    one = [*keys, "_all"]
    small, large = by_size(rows.withColumn("_all", F.lit(0)), one, min(cell, CELL))
    group = W.partitionBy(*one)
    placed = small.withColumns({"_i": F.row_number().over(group.orderBy("_v")) - 1, "n": F.count("*").over(group)})
    at = {name: F.col("_i") == F.expr(e).cast("long") for name, e in index.items()}
    wanted = placed.where(functools.reduce(lambda a, b: a | b, at.values()))
    out = wanted.groupBy(*one).agg(F.max("n").alias("n"), *[F.max(F.when(hit, F.col("_v"))).alias(name) for name, hit in at.items()]).drop("_all")
    return out if large is None else out.unionByName(_cut(large, keys, cell, **index))


def _cut(rows: DataFrame, keys: list[str], cell: int, **index: str) -> DataFrame:
    """order_statistics() of groups of any size, from (keys, _v, _all), by counts of buckets."""
    one = [*keys, "_all"]
    ends = rows.groupBy(*one).agg(F.count("*").alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.expr(e).cast("long").alias("rank")) for name, e in index.items()]))
    wanted = written(ends.withColumn("_r", ranks).select(*one, "n", "_lo", "_hi", "_r.*", F.lit(0).cast("long").alias("_before"), F.col("n").alias("_rows")), "ranks")
    where = [*one, "_lo", "_hi"]
    inside = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    # after the first cut a bucket's ends have one sign and size, so their difference is finite and over 0
    share = (F.col("_v") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double")
    place = _magnitude(F.col("_v"))
    while not wanted.where((F.col("_lo") < F.col("_hi")) & (F.col("_rows") > min(cell, CELL))).isEmpty():
        cells = wanted.where("_lo < _hi").select(*where).distinct()
        own = rows.join(cells, one).where(inside).groupBy(*where, place.alias("_b")).agg(F.count("*").alias("_k"), F.min("_v").alias("_min"), F.max("_v").alias("_max"))
        upto = W.partitionBy(*where).orderBy("_b")
        own = own.withColumn("_start", F.sum("_k").over(upto) - F.col("_k"))
        hit = (F.col("rank") >= F.col("_before") + F.col("_start")) & (F.col("rank") < F.col("_before") + F.col("_start") + F.col("_k"))
        open_ = wanted.where("_lo < _hi").join(own, where).where(hit).select(*one, "n", F.col("_min").alias("_lo"), F.col("_max").alias("_hi"), "name", "rank", (F.col("_before") + F.col("_start")).alias("_before"), F.col("_k").alias("_rows"))
        wanted, place = written(wanted.where("_lo = _hi").union(open_), "ranks"), F.floor(share * BUCKETS)
    cells = wanted.where("_lo < _hi").select(*where).distinct()
    placed = rows.join(cells, one).where(inside).withColumn("_i", F.row_number().over(W.partitionBy(*where).orderBy("_v")) - 1)
    found = wanted.where("_lo < _hi").join(placed.select(*where, "_i", "_v"), where).where("_i = rank - _before").select(*keys, "n", "name", "_v")
    found = found.union(wanted.where("_lo = _hi").select(*keys, "n", "name", F.col("_lo").alias("_v")))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in index])


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys, the median that averages the middle pair, and n."""
    got = order_statistics(df, keys, value, _a="(n - 1) div 2", _b="n div 2")
    return got.select(*keys, ((F.col("_a") + F.col("_b")) / 2).alias(name), "n")


def percentiles(df: DataFrame, keys: list[str], value: str, **share: float) -> DataFrame:
    """keys, n and, for each name, the percentile that interpolates between neighbours."""
    index = {f"_{side}{name}": f"cast({kind}((n - 1) * {p}d) as long)" for name, p in share.items() for side, kind in (("a", "floor"), ("b", "ceil"))}
    got = order_statistics(df, keys, value, **index)
    between = lambda name, p: F.col(f"_a{name}") + (F.col(f"_b{name}") - F.col(f"_a{name}")) * ((F.col("n") - 1) * p - F.floor((F.col("n") - 1) * p))
    return got.select(*keys, "n", *[between(name, p).alias(name) for name, p in share.items()])


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return order_statistics(df, keys, value, upper_median="n div 2")


def p95_floor(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return order_statistics(df, keys, value, p95="((n - 1) * 95) div 100")


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median and median absolute deviation; the groups' medians are joined back."""
    med = written(medians(df, keys, value).drop("n"), "medians")
    off = df.join(med, keys).withColumn("_d", F.abs(F.col(value) - F.col("median")))
    return medians(off, keys, "_d", "mad").join(med, keys).select(*keys, "median", "mad", "n")


def robust_step(df: DataFrame, keys: list[str], x: str, y: str, floor: float = 0.005) -> DataFrame:
    """Median of both axes, cutoff max(floor, median + 3 * 1.4826 * MAD) of distances, refit on inliers."""

    def both(rows: DataFrame, a: str, b: str) -> DataFrame:
        """The medians of both axes and n, from one run over the rows."""
        axes = F.explode(F.array(F.struct(F.lit(a).alias("_axis"), F.col(x).cast("double").alias("_w")), F.struct(F.lit(b).alias("_axis"), F.col(y).cast("double").alias("_w"))))
        med = medians(rows.select(*keys, axes.alias("_a")).select(*keys, "_a.*"), [*keys, "_axis"], "_w")
        of = lambda name, v: F.max(F.when(F.col("_axis") == name, F.col(v)))
        return written(med.groupBy(*keys).agg(of(a, "median").alias(a), of(b, "median").alias(b), of(b, "n").alias("n")), "axes")

    far = df.join(both(df, "mx", "my").drop("n"), keys).withColumn("r", F.sqrt((F.col(x) - F.col("mx")) ** 2 + (F.col(y) - F.col("my")) ** 2))
    spread = written(median_mad(far, keys, "r").select(*keys, F.col("median").alias("mr"), "mad"), "spread")
    inlier = far.join(spread, keys).where(F.col("r") <= F.greatest(F.lit(floor), F.col("mr") + 3 * 1.4826 * F.col("mad")))
    fit = both(inlier, "step_x", "step_y").withColumnRenamed("n", "inliers")
    off = (F.col(x) - F.col("step_x")) ** 2 + (F.col(y) - F.col("step_y")) ** 2
    return inlier.join(fit, keys).groupBy(*keys, "step_x", "step_y", "inliers").agg(F.sqrt(F.avg(off)).alias("rms"))


def axis_summary(df: DataFrame, keys: list[str], value: str, accepted: Column, pixels: float = 3.0, share: float = 0.1) -> DataFrame:
    """At least two accepted samples, all of one sign and within max(pixels, share * |median|) of the median."""
    good = df.where(accepted)
    med = medians(good, keys, value).drop("n")
    near = F.abs(F.col(value) - F.col("median")) <= F.greatest(F.lit(pixels), share * F.abs("median"))
    agg = good.join(med, keys).groupBy(*keys, "median").agg(F.count("*").alias("accepted"), F.bool_and(near).alias("near"), F.bool_and(F.signum(value) == F.signum("median")).alias("same_sign"))
    return agg.select(*keys, "median", "accepted", ((F.col("accepted") >= 2) & F.col("near") & F.col("same_sign")).alias("reliable"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def weighted_rms(value: str, weight: str) -> Column:
    return F.sqrt(F.sum(F.col(weight) * F.col(value) ** 2) / F.sum(weight))


def rms_report(df: DataFrame, keys: list[str], residual: str) -> DataFrame:
    """RMS, greatest and count for each edge and, with null keys, in all: one pass of grouping sets."""
    return df.groupingSets([keys, []], *keys).agg(F.sqrt(F.avg(F.col(residual) ** 2)).alias("rms"), F.max(residual).alias("max_residual"), F.count("*").alias("n"))


def coverage(df: DataFrame, keys: list[str], x: Column, y: Column, width: float, height: float, cells: int = 4) -> DataFrame:
    """Occupied cells of a cells x cells raster, as a bit mask and its count."""
    clip = lambda v, size: F.least(F.greatest(F.floor(v * cells / size), F.lit(0)), F.lit(cells - 1))
    cell = clip(y, height) * cells + clip(x, width)
    mask = F.bit_or(F.call_function("shiftleft", F.lit(1), cell.cast("int")))
    return df.groupBy(*keys).agg(mask.cast("int").alias("mask"), F.bit_count(mask).cast("int").alias("cells"))


def reliability(df: DataFrame, weight: str) -> DataFrame:
    """weight over the median weight, between 0.001 and 1, as `scale`."""
    med = medians(df, [], weight, "_m").select("_m")
    scale = F.least(F.lit(1.0), F.greatest(F.lit(0.001), F.col(weight) / F.col("_m")))
    return df.crossJoin(F.broadcast(med)).withColumn("scale", scale).drop("_m")


def run_report(edges: DataFrame, matched: Column, strong: Column, score: str, worst: str) -> DataFrame:
    """One row for a run: edges, matched, strong, the mean score of the matched and the worst value."""
    return edges.agg(F.count("*").alias("edges"), F.count_if(matched).alias("matched"), F.count_if(matched & strong).alias("strong"), F.avg(F.when(matched, F.col(score))).alias("mean_matched"), F.max(worst).alias("worst"))


def endpoint_totals(edges: DataFrame, key: str, endpoint: str, features: str) -> DataFrame:
    """key, its distinct endpoints and the features of each counted once."""
    return edges.groupBy(key, endpoint).agg(F.max(features).alias("_f")).groupBy(key).agg(F.count("*").alias("endpoints"), F.sum("_f").alias("features"))


def window_confidence(samples: DataFrame, pixel: str, confidence: Column, edge: Column) -> DataFrame:
    """The greatest confidence of a pixel over all windows, each weighted by its distance from the window's edge."""
    return samples.groupBy(pixel).agg(F.max(confidence * edge).alias("confidence"))


def cell_energy(pixels: DataFrame, cell: list[str], x: str, y: str, value: str) -> DataFrame:
    """Mean, variance, mean squared gradient and mean squared Laplacian of the pixels (x, y, value) of each cell; neighbours are of the same cell."""
    along = lambda a, b: W.partitionBy(*cell, a).orderBy(b)
    v = F.col(value)
    near = lambda a, b, k: F.when(F.lead(b, k).over(along(a, b)) == F.col(b) + k, F.lead(v, k).over(along(a, b))) if k > 0 else F.when(F.lag(b, -k).over(along(a, b)) == F.col(b) + k, F.lag(v, -k).over(along(a, b)))
    right, down, left, up = near(y, x, 1), near(x, y, 1), near(y, x, -1), near(x, y, -1)
    marked = pixels.withColumns({"_gx": right - v, "_gy": down - v, "_l": right + left + up + down - 4 * v})
    return marked.groupBy(*cell).agg(F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.avg(F.col("_gx") ** 2 + F.col("_gy") ** 2).alias("gradient"), F.avg(F.col("_l") ** 2).alias("laplacian"))


def edge_quality(samples: DataFrame, keys: list[str], residual: str, expected: str) -> DataFrame:
    """Of every edge RMS, floor-index p95, greatest, count, and whether it has all samples that were expected."""
    p95 = order_statistics(samples, keys, residual, p95="((n - 1) * 95) div 100")
    rest = samples.groupBy(*keys).agg(F.sqrt(F.avg(F.col(residual) ** 2)).alias("rms"), F.max(residual).alias("greatest"), (F.count(residual) >= F.max(expected)).alias("complete"))
    return p95.join(rest, keys)
