"""Exact top-k search by a vector-approximation file.

The file has, for every row, a cell number of CELL_BITS bits for each component: its place in an even grid
between the least and greatest value of that component in the row's block. It is written once, apart from
the exact vectors, and is all that is scanned: queries are broadcast in waves of at most QUERY_BYTES, and
the cells give each row's bounds for each query, since a component differs from its cell's middle by at
most half a cell. A scanning task keeps the rows that can still be among the k best it has seen; of those,
the rows that can be among the k best of all are put in the order of their upper bounds. Exact vectors are
then read in that order, FIRST for each query and four times as many in each further step, until no unread
row can reach the kth score found.

The scan costs queries times rows of small integers and is dealt over all tasks. No block, broadcast or
group grows with the input.

Nulls and odd input: vectors that are null or hold a null or non-finite component take no part, nor do rows
with a null id; vectors meet only vectors of their own length, empty ones included (score 0); equal scores
go to the smaller id; components and scores beyond a bigint become its nearest value (a score as a whole: partial sums may
pass it), and scores that do so are equal; rows that repeat an id are separate candidates, and none of them is a candidate of a
query with that id; a query row that is repeated is one query; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, written

CELL_BITS = 6
BLOCK_ROWS = 4096
QUERY_BYTES = 32 << 20
#: Queries that meet a block at once.
QUERY_ROWS = 256
#: Bounds that a task holds before it lets go of those that others have ruled out.
HELD = 1 << 20
FIRST = 32
#: The greatest bigint as a double.
MOST_SCORE = 2.0**63

CELLS = "dim int, keys binary, ids binary, low binary, step binary, cells binary"
BOUNDS = "query_id long, key long, vec_id long, lower double, upper double"


def approximation(exact: DataFrame) -> DataFrame:
    """Blocks of at most BLOCK_ROWS rows of one length from exact (key, id, v): keys, ids and cells."""
    schema = pa.schema([("dim", pa.int32()), *((c, pa.binary()) for c in ("keys", "ids", "low", "step", "cells"))])

    def block(keys: list, ids: list, vectors: list) -> pa.RecordBatch:
        v = np.stack(vectors).astype(np.float64)
        low = v.min(axis=0)
        step = np.maximum((v.max(axis=0) - low) / (1 << CELL_BITS), 1e-300)
        cells = np.minimum((v - low) / step, (1 << CELL_BITS) - 1).astype(np.uint8)
        return batch(schema, [[v.shape[1]], *([x.tobytes()] for x in (np.array(keys, "<i8"), np.array(ids, "<i8"), low, step, cells))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}
        for rb in batches:
            offsets, values = rb.column(2).offsets.to_numpy(), rb.column(2).values.to_numpy()
            for key, i, a, b in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), offsets.tolist(), offsets[1:].tolist()):
                own = held.setdefault(b - a, ([], [], []))
                for into, x in zip(own, (key, i, values[a:b])):
                    into.append(x)
                if len(own[0]) == BLOCK_ROWS:
                    yield block(*held.pop(b - a))
        for own in held.values():
            yield block(*own)

    return exact.mapInArrow(run, CELLS)


class Wave:
    """Queries of one length, and the greatest lower bounds that a scan has found for each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors.astype(np.float64), k
        self.best = np.full((len(ids), k), -np.inf)
        self.kept: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def scan(self, keys: np.ndarray, ids: np.ndarray, low: np.ndarray, step: np.ndarray, cells: np.ndarray) -> None:
        cells = cells.T.astype(np.float64)
        for lo in range(0, len(self.ids), QUERY_ROWS):
            own, q = self.ids[lo : lo + QUERY_ROWS], self.vectors[lo : lo + QUERY_ROWS]
            middle = (q * step) @ cells + (q @ (low + step / 2))[:, None]
            # half a cell to either side, and room for rounding
            slack = np.abs(q) @ (step / 2) + 1e-9 * (np.abs(q) @ (np.abs(low) + step * (1 << CELL_BITS))) + 1e-6
            middle[own[:, None] == ids[None, :]] = -np.inf
            lower = middle - slack[:, None]
            if lower.shape[1] > self.k:
                lower = np.partition(lower, -self.k, axis=1)[:, -self.k :]
            best = np.sort(np.concatenate([self.best[lo : lo + QUERY_ROWS], lower], axis=1), axis=1)[:, -self.k :]
            self.best[lo : lo + QUERY_ROWS] = best
            # scores beyond a bigint are equal there, so bounds are
            i, j = np.nonzero((middle + slack[:, None] >= np.minimum(best[:, :1], MOST_SCORE)) & (middle > -np.inf))
            self.kept.append((lo + i, keys[j], ids[j], middle[i, j] - slack[i], middle[i, j] + slack[i]))
            self.size += len(i)

    def rows(self) -> pa.RecordBatch:
        query, key, vec, lower, upper = (np.concatenate(c) for c in zip(*self.kept))
        lower, upper = (np.clip(x, -MOST_SCORE, MOST_SCORE) for x in (lower, upper))
        near = upper >= np.minimum(self.best[query, 0], MOST_SCORE)
        self.kept, self.size = [], 0
        return batch(_bounds, [self.ids[query[near]], key[near], vec[near], lower[near], upper[near]])


_bounds = pa.schema([("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("lower", pa.float64()), ("upper", pa.float64())])


def bounds(cells: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """For every query (id, v) the rows that may be among its k best, by the cells alone, wave by wave."""
    spark = cells.sparkSession
    waves, held, size = [], [], 0
    for r in queries.toLocalIterator():
        held.append((r.id, np.array(r.v, np.int64)))
        size += 8 * (len(r.v) + 1 + k)
        if size >= QUERY_BYTES:
            waves.append(_scan(spark, cells, held, k))
            held, size = [], 0
    if held or not waves:
        waves.append(_scan(spark, cells, held, k))
    out = waves[0]
    for other in waves[1:]:
        out = out.union(other)
    return out


def _scan(spark: SparkSession, cells: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(v) for _, v in queries}:
        own = [(i, v) for i, v in queries if len(v) == dim]
        by[dim] = np.array([i for i, _ in own]), np.stack([v for _, v in own])
    shared = spark.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {dim: Wave(ids, v, k) for dim, (ids, v) in shared.value.items()}
        for rb in batches:
            for dim, keys, ids, low, step, raw in zip(*(c.to_pylist() for c in rb.columns)):
                if dim not in own:
                    continue
                ids = np.frombuffer(ids, "<i8")
                own[dim].scan(np.frombuffer(keys, "<i8"), ids, np.frombuffer(low), np.frombuffer(step), np.frombuffer(raw, np.uint8).reshape(len(ids), dim))
                if own[dim].size > HELD:
                    yield own[dim].rows()
        for wave in own.values():
            if wave.kept:
                yield wave.rows()

    found = written(cells.mapInArrow(run, BOUNDS), "bounds")
    shared.unpersist()
    return found


def inner_product(a: Column, b: Column) -> Column:
    """The sum of products of two arrays of bigints of one length, exact; beyond a bigint its nearest value.

    Where the products' sizes add up to less than 2**62 bigints hold every partial sum. Else each a is cut into 31 low bits and the rest,
    both are multiplied and added as decimals, and the high sum, if it is beyond 2**80, decides alone.
    """
    wide = "decimal(38,0)"
    size = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") * y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    plain = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    high = F.zip_with(a, b, lambda x, y: (F.shiftright(x, 31).cast("decimal(12,0)") * y.cast("decimal(19,0)")).cast(wide))
    low = F.zip_with(a, b, lambda x, y: (x.bitwiseAND(F.lit((1 << 31) - 1)).cast("decimal(12,0)") * y.cast("decimal(19,0)")).cast(wide))
    total = lambda parts: F.aggregate(parts, F.lit(0).cast(wide), lambda s, x: (s + x).cast(wide))
    least, most = F.lit(-(1 << 63)), F.lit((1 << 63) - 1)

    def joined(h: Column, lo: Column) -> Column:
        whole = (h.cast("decimal(26,0)") * F.lit(1 << 31).cast("decimal(10,0)")).cast(wide) + lo
        inside = F.when(whole > most, most).when(whole < least, least).otherwise(whole.cast("long"))
        return F.when(h > F.lit(str(1 << 80)).cast(wide), most).when(h < F.lit(str(-(1 << 80))).cast(wide), least).otherwise(inside)

    exact = F.transform(F.array(F.struct(total(high).alias("h"), total(low).alias("l"))), lambda p: joined(p["h"], p["l"]))[0]
    return F.when(size < float(1 << 62), plain).otherwise(exact)


def search(rows: DataFrame, queries: DataFrame, k: int = 10) -> tuple[DataFrame, list[int]]:
    """(query_id, rank, vec_id, score) of the k rows (id, v) with the greatest inner product for each query
    (id, v), and how many exact vectors each step read."""
    exact = written(rows.select(F.monotonically_increasing_id().alias("key"), "id", "v"), "vectors")
    asked = written(queries.dropDuplicates(["id"]).select("id", "v"), "queries")
    found = bounds(written(approximation(exact), "cells"), asked, k)
    first = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("lower"), "key"))
    floor = found.withColumn("n", first).where(F.col("n") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("lower")).alias("floor"))
    near = found.join(floor, "query_id").where("floor is null or upper >= floor")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("upper"), "key"))
    left = written(near.select("query_id", "key", "vec_id", "upper", order.alias("place")), "ordered")
    product = inner_product(F.col("v"), F.col("q"))
    best, upto, read = None, FIRST, []
    while True:
        some = left.where(F.col("place") <= upto)
        scores = some.join(exact.select("key", "v"), "key").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        scores = written(scores.select("query_id", "vec_id", product.alias("score")), "scores")
        read.append(scores.count())
        best = scores if best is None else best.union(scores)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        best = written(best.withColumn("rank", rank).where(F.col("rank") <= k), "best")
        kth = best.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
        left = written(left.where(F.col("place") > upto).join(kth, "query_id", "left").where("kth is null or upper >= kth").drop("kth"), "ordered")
        if left.isEmpty():
            return best.select("query_id", "rank", "vec_id", "score"), read
        best, upto = best.drop("rank"), 4 * upto


def whole_vectors(rows: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(id, v) with v the floor of 1024 times each component, of rows that take part."""
    v = F.col(vector)
    fine: Column = F.col(vec_id).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * 1024)).alias("v"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return search(rows, rows.where("id % 100 = 0"))[0]


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 10
"""
