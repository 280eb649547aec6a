"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, shared_dir, tables_written, written  # noqa: F401

#: Code points that one numpy block holds at most; a longer text is walked in slices of this many.
BLOCK_CHARS = 1 << 18
#: Rows of an Arrow batch that become Python objects at once.
ROWS = 1000
#: ASCII white space, as bytes.split() and the contracts see it.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """Column names for internal use that no column of the input has, whatever its case."""
    low, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in low:
            name = "_" + name
        low.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text is divisible by 5; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


#: The bitmap that likely() broadcasts has 2**FILTER_BITS bits (8 MB), whatever the input.
FILTER_BITS = 26


def likely(rows: DataFrame, known: DataFrame, key: str, mark: str | None = None) -> DataFrame:
    """rows without most of those whose bigint `key` is not in known: those whose bit in a bitmap of hashed keys is unset.
    With a mark all rows stay, and that boolean column tells them apart.

    The join that follows decides; the bitmap spares it rows that can't match, and as it fills up it only
    spares fewer. Rows with a null key go.
    """
    place = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << FILTER_BITS))
    parts = known.where(F.col(key).isNotNull()).select(place.alias("p")).groupBy(F.expr("p div 32768").alias("k")).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias("bits")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    for k, own in zip(parts["k"].to_pylist(), parts["bits"].to_pylist()):
        bits[4096 * k : 4096 * (k + 1)] = np.frombuffer(own, np.uint8)
    shared = rows.sparkSession.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def maybe(p: pd.Series) -> pd.Series:
        p = p.to_numpy()
        return pd.Series((shared.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1)

    found = F.col(key).isNotNull() & maybe(place)
    return rows.withColumn(mark, found) if mark else rows.where(found)


def blocks(sizes: Sequence[int], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items whose sizes sum to about limit; every item is in one of them."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def xxhash_long(x: np.ndarray, seed: np.ndarray | np.uint64 = np.uint64(42)) -> np.ndarray:
    """Spark's xxhash64 of a bigint column (XXH64 of 8 bytes), on uint64 arrays; the seed of a further column is the hash so far."""
    p1, p2, p3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    p4, p5 = np.uint64(0x85EBCA77C2B2AE63), np.uint64(0x27D4EB2F165667C5)

    def rotl(v: np.ndarray, r: int) -> np.ndarray:
        return (v << np.uint64(r)) | (v >> np.uint64(64 - r))

    with np.errstate(over="ignore"):
        h = seed + p5 + np.uint64(8)
        h = h ^ (rotl(x.astype(np.uint64) * p2, 31) * p1)
        h = rotl(h, 27) * p1 + p4
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many rows; after the last, memory that was freed goes back to the system.

    A worker lives on for other stages, beside an executor that fills its own heap.
    """
    for rb in batches:
        for lo in range(0, rb.num_rows, rows):
            yield rb.slice(lo, rows)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def batch(schema: pa.Schema, columns: Sequence) -> pa.RecordBatch:
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
