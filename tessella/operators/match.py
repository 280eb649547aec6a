"""Matching of descriptor vectors and records of matched edges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import dealt, written


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v))


def closest(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the k nearest rows j of y for each row i of x; of equal distances the lower j comes first."""
    size, out = (y * y).sum(axis=1), []
    for lo in range(0, len(x), 256):
        some = x[lo : lo + 256]
        own = (some * some).sum(axis=1)[:, None]
        near = own + size - 2 * (some @ y.T)
        bound = np.partition(near, k - 1, axis=1)[:, k - 1 : k] if k < len(y) else np.full_like(own, np.inf)
        # the product rounds: all that may be nearest are measured again
        at, to = np.nonzero(near <= bound + 1e-9 * (own + size.max()))
        d = np.sqrt(((some[at] - y[to]) ** 2).sum(axis=1))
        order = np.lexsort((to, d, at))
        at, to, d = at[order], to[order], d[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        out.append((lo + at[first], to[first], d[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrices(*rows: pd.DataFrame) -> list[tuple[pd.Series, np.ndarray]]:
    """ids and vectors of each, in the order of the ids."""
    ordered = [df.sort_values("id", ignore_index=True) for df in rows]
    return [(df["id"], np.stack(df["v"].to_numpy()).astype(float)) for df in ordered]


def _in_blocks(df: DataFrame, mine: str, theirs: str, n: int, m: int) -> DataFrame:
    """Every row with its block's number of n as `mine`, once for each of the m blocks that it meets, `theirs`."""
    own = df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(n)))
    return own.withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))


def mutual_nearest(left: DataFrame, right: DataFrame, tile: str, ratio: float = 0.78, block: int = 4096) -> DataFrame:
    """Pairs (a, b, distance) of ids that are each other's nearest and pass the ratio test on both sides.

    left and right are (tile, id, v). Only vectors of the same tile pair meet, in blocks of at most about `block` by `block`, a product of
    matrices each; only each vector's two nearest leave a block. Vectors are whole and as long as each other.
    """
    keys = [tile, "i", "j"]
    parts = [max(1, -(-df.count() // block)) for df in (left, right)]
    own, other = (dealt(_in_blocks(df.where("v is not null").select(tile, "id", "v"), *at), *keys) for df, at in ((left, ("i", "j", *parts)), (right, ("j", "i", *parts[::-1]))))

    def two(key: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        if not len(l) or not len(r):
            return pd.DataFrame({tile: [], "a": [], "b": [], "d": [], "of_a": []})
        (a, x), (b, y) = _matrices(l, r)
        i, j, d = closest(x, y, 2)
        q, p, e = closest(y, x, 2)
        both = pd.DataFrame({"a": np.r_[a.to_numpy()[i], a.to_numpy()[p]], "b": np.r_[b.to_numpy()[j], b.to_numpy()[q]], "d": np.r_[d, e], "of_a": np.arange(len(d) + len(e)) < len(d)})
        return both.assign(**{tile: key[0]})[[tile, "a", "b", "d", "of_a"]]

    kind = [df.schema[c].dataType.simpleString() for df, c in ((left, tile), (left, "id"), (right, "id"))]
    pairs = written(own.groupBy(*keys).cogroup(other.groupBy(*keys)).applyInPandas(two, f"`{tile}` {kind[0]}, a {kind[1]}, b {kind[2]}, d double, of_a boolean"), "nearest")

    def nearest(rows: DataFrame, own: str, other: str) -> DataFrame:
        w = W.partitionBy(tile, own).orderBy("d", other)
        two = rows.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
        one = two.groupBy(tile, own).agg(F.min_by(other, "_r").alias(other), F.min("d").alias("d"), F.max(F.when(F.col("_r") == 2, F.col("d"))).alias("_two"))
        return one.where(F.col("_two").isNull() | (F.col("d") < ratio * F.col("_two"))).select(tile, "a", "b", "d")

    return nearest(pairs.where("of_a"), "a", "b").join(nearest(pairs.where("not of_a"), "b", "a").select(tile, "a", "b"), [tile, "a", "b"]).select("a", "b", F.col("d").alias("distance"))


def retry_ladder(edges: DataFrame, *attempts: DataFrame) -> DataFrame:
    """edges (from, to) with the first attempt (from, to, inliers) that succeeded, and which it was (from 1; 0: none)."""
    out = edges
    for k, a in enumerate(attempts, 1):
        out = out.join(a.select("from", "to", F.col("inliers").alias(f"_a{k}")), ["from", "to"], "left")
    cols = [F.col(f"_a{k}") for k in range(1, len(attempts) + 1)]
    used = F.coalesce(*[F.when(c.isNotNull(), k) for k, c in enumerate(cols, 1)], F.lit(0))
    return out.select(*edges.columns, F.coalesce(*cols).alias("inliers"), used.alias("attempt"))


def worst(edges: DataFrame, residual: str, k: int = 5, *ties: str) -> DataFrame:
    return edges.orderBy(F.desc(residual), *ties).limit(k)


def over_limit(edges: DataFrame, residual: str, limit: float) -> DataFrame:
    """One row for each unordered pair over the limit: the worst of both directions, ranked from the worst."""
    pair = edges.where(F.col(residual) > limit).groupBy(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.max(residual).alias(residual))
    # ranks over all issues: they are the few edges over the limit
    return pair.withColumn("rank", F.row_number().over(W.orderBy(F.desc(residual), "a", "b")))


def first_match(constraints: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """Each constraint with the first edge of its (from, to); `complete` tells whether there is one."""
    first = edges.groupBy("from", "to").agg(F.min_by(F.struct(*[c for c in edges.columns if c not in ("from", "to")]), order).alias("edge"))
    return constraints.join(first, ["from", "to"], "left").select(*constraints.columns, "edge.*", F.col("edge").isNotNull().alias("complete"))


def approximate_nearest(left: DataFrame, right: DataFrame, width: float, tables: int = 8, within: float = 1.0, seed: int = 7, block: int = 4096) -> DataFrame:
    """(a, b, distance) of each left vector's nearest right one (id, v) among those that share a random projection's bucket and are within a distance.

    The vectors of a bucket meet in blocks of about `block` by `block`, a product of matrices each, and only each vector's nearest leaves a block, so
    a bucket that holds all vectors is many tasks of bounded memory. Where buckets tell little apart the work grows with the square of the vectors.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own, other = (df.select("id", "v", array_to_vector(F.col("v").cast("array<double>")).alias("f")) for df in (left, right))
    model = BucketedRandomProjectionLSH(inputCol="f", outputCol="h", bucketLength=width, numHashTables=tables, seed=seed).fit(own)
    parts = [max(1, -(-df.count() // block)) for df in (left, right)]
    keys = ["t", "bucket", "i", "j"]

    def blocks(df: DataFrame, *at: str | int) -> DataFrame:
        hashed = model.transform(df).select("id", "v", F.posexplode("h").alias("t", "_h")).select("id", "v", "t", vector_to_array("_h")[0].alias("bucket"))
        return dealt(_in_blocks(hashed, *at), *keys).groupBy(*keys)

    def nearest(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        if not len(l) or not len(r):
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        (a, x), (b, y) = _matrices(l, r)
        i, j, d = closest(x, y, 1)
        return pd.DataFrame({"a": a.to_numpy()[i], "b": b.to_numpy()[j], "distance": d})[d < within]

    kind = [df.schema["id"].dataType.simpleString() for df in (left, right)]
    met = blocks(own, "i", "j", *parts).cogroup(blocks(other, "j", "i", *parts[::-1])).applyInPandas(nearest, f"a {kind[0]}, b {kind[1]}, distance double")
    return met.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("_n")).select("a", "_n.b", "_n.distance")


def without(edges: DataFrame, others: DataFrame) -> DataFrame:
    """Edges (from, to) that are not among the others."""
    return edges.join(others.select("from", "to"), ["from", "to"], "left_anti")


def stored(edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the SHA-256 of a capture's correspondences (from, to, points), in the order of the edges: what a replay is checked against."""
    own = F.sha2(F.to_json(F.struct("from", "to", "points")), 256)
    return edges.select(*keys, "from", "to", own.alias("_h")).groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("from", "to", "_h"))), lambda e: e["_h"]), ""), 256).alias("sha256"), F.count("*").alias("edges"))
