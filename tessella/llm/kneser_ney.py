"""Character grams and the sorted hash arrays of Kneser-Ney models.

A gram of up to six characters is two 63-bit integers: `lo` has its last three code points, `hi` the three
before, 21 bits each, so no code point is cut. A table of a model is the sorted 64-bit hashes of its grams
beside their counts. A model's tables are one file that Spark hands to every executor once (SparkContext.addFile) and that
all its workers map into memory, so a model is never cut and its size counts once a machine; the driver writes it piece by piece.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, xxhash_long

CHAR = 21
_MASK = [(1 << (CHAR * k)) - 1 for k in range(4)]
_MIX = np.uint64(0x9E3779B97F4A7C15)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def grams(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(hi, lo) of the gram that ends at each code point from order - 1 on."""
    n = len(codes) - order + 1
    at = lambda k: codes[order - 1 - k : order - 1 - k + n]
    parts = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for k in range(order):
        parts[k // 3] |= at(k) << np.uint64(CHAR * (k % 3))
    return parts[1], parts[0]


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of the distinct grams, and which of them each gram is.

    They are told apart by a 64-bit mix; that two of a block of BLOCK_CHARS share it has a chance of 1 in 10**8.
    """
    with np.errstate(over="ignore"):
        key = lo * _MIX ^ (hi + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    code, unique = pd.factorize(key)
    first = np.empty(len(unique), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    return hi[first], lo[first], code


class Counts:
    """Counts of grams by part, merged when many are held."""

    def __init__(self):
        self.held: dict[object, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, part: object, hi: np.ndarray, lo: np.ndarray) -> None:
        for a in range(0, len(lo), BLOCK_CHARS):
            h, g, code = distinct(hi[a : a + BLOCK_CHARS], lo[a : a + BLOCK_CHARS])
            self.held.setdefault(part, []).append((h, g, np.bincount(code)))
            self.size += len(g)

    def merged(self) -> int:
        """Merges the blocks of each part and sorts them; the distinct grams held."""
        self.size = 0
        for part, own in self.held.items():
            hi, lo, n = (np.concatenate(c) for c in zip(*own))
            h, g, code = distinct(hi, lo)
            n = np.bincount(code, weights=n).astype(np.int64)
            order = np.lexsort((g, h))
            self.held[part] = [(h[order], g[order], n[order])]
            self.size += len(g)
        return self.size

    def take(self):
        """(part, hi, lo, n) of all that is held, which is then forgotten."""
        self.merged()
        for part, own in self.held.items():
            for hi, lo, n in own:
                yield part, hi.view(np.int64), lo.view(np.int64), n
        self.held.clear()
        self.size = 0


def suffix(k: int) -> tuple[Column, Column]:
    """hi and lo of the last k characters of a gram."""
    if k >= 3:
        return F.col("hi").bitwiseAND(F.lit(_MASK[k - 3])), F.col("lo")
    return F.lit(0).cast("long"), F.col("lo").bitwiseAND(F.lit(_MASK[k]))


def context() -> tuple[Column, Column]:
    """hi and lo of a gram without its last character."""
    carried = F.shiftleft(F.col("hi").bitwiseAND(F.lit(_MASK[1])), 2 * CHAR)
    return F.shiftright("hi", CHAR), F.shiftright("lo", CHAR).bitwiseOR(carried)


def np_suffix(hi: np.ndarray, lo: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if k >= 3:
        return hi & np.uint64(_MASK[k - 3]), lo
    return np.zeros_like(hi), lo & np.uint64(_MASK[k])


def np_context(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return hi >> np.uint64(CHAR), (lo >> np.uint64(CHAR)) | ((hi & np.uint64(_MASK[1])) << np.uint64(2 * CHAR))


def hashed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Spark's xxhash64(hi, lo), unsigned."""
    return xxhash_long(lo, xxhash_long(hi))


#: Rows of a table that the driver takes at a time.
PIECE = 1 << 22


class Table:
    """Sorted hashes and the counts beside them; an index by the hashes' first bits finds a place in a step or two.

    A count takes a byte; those of 255 and more are kept apart, by place.
    """

    def __init__(self, keys: np.ndarray, first: np.ndarray, values: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.keys, self.first, self.coded = keys, first, values
        self.bits = max(1, int(len(keys)).bit_length() - 1)
        self.near = [self._stretches(place, len(keys)) for _, place, _ in values]

    @staticmethod
    def _stretches(place: np.ndarray, n: int) -> tuple[int, np.ndarray]:
        """Bits of a stretch of places that has one count kept apart on average, and the first such count from each stretch on."""
        bits = max(0, (n // max(1, len(place))).bit_length() - 1)
        return bits, np.searchsorted(place, np.arange(0, n + 1, 1 << bits)).astype(np.uint32)

    @staticmethod
    def index(keys: np.ndarray) -> np.ndarray:
        bits = max(1, int(len(keys)).bit_length() - 1)
        edges = np.arange((1 << bits) + 1, dtype=np.float64) * 2.0 ** (64 - bits)
        edges = np.minimum(edges, 2.0**64 - 4096).astype(np.uint64)
        return np.searchsorted(keys, edges).astype(np.uint32)

    def look(self, h: np.ndarray) -> list[np.ndarray]:
        """The values of hashes, 0 where there is none."""
        if not len(self.keys):
            return [np.zeros(len(h)) for _ in self.coded]
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)].astype(np.int64)
        at = np.minimum(at, len(self.keys) - 1)
        behind = np.flatnonzero(self.keys[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[at[behind] < len(self.keys)]
            behind = behind[self.keys[at[behind]] < h[behind]]
        at = np.minimum(at, len(self.keys) - 1)
        hit = self.keys[at] == h
        out = []
        for (code, place, count), (bits, first) in zip(self.coded, self.near):
            v = code[at]
            large = np.flatnonzero(v == 255)
            v = v.astype(np.float64)
            # as for the keys: a place or two behind the first of its stretch
            own = at[large]
            i = first[own >> bits].astype(np.int64)
            behind = np.flatnonzero(place[i] < own)
            while len(behind):
                i[behind] += 1
                behind = behind[place[i[behind]] < own[behind]]
            v[large] = count[i]
            out.append(np.where(hit, v, 0))
        return out


class Tables(dict):
    """Tables by name, mapped from one file; what travels with a task is where each array begins."""

    def __init__(self, file: str, arrays: dict[object, list[tuple[int, str, int]]]):
        super().__init__()
        self.file, self.arrays = file, arrays
        whole = np.asarray(np.memmap(SparkFiles.get(file), np.uint8, "r"))
        for name, parts in arrays.items():
            keys, first, *values = (whole[at : at + n * np.dtype(kind).itemsize].view(kind) for at, kind, n in parts)
            self[name] = Table(keys, first, [tuple(values[i : i + 3]) for i in range(0, len(values), 3)])

    def __reduce__(self):
        return Tables, (self.file, self.arrays)


class Writer:
    """Writes tables into a file that every executor gets."""

    def __init__(self, spark: SparkSession):
        self.spark, self.file, self.arrays, self.at = spark, f"model-{uuid.uuid4().hex}", {}, 0
        self.path = SparkFiles.get(self.file)
        self.out = open(self.path, "wb")
        self._put(np.zeros(1, np.uint64))  # an empty file can't be mapped

    def _put(self, array: np.ndarray) -> tuple[int, str, int]:
        self.out.write(array.tobytes())
        self.out.write(bytes(-array.nbytes % 8))
        at, self.at = self.at, self.at + array.nbytes + -array.nbytes % 8
        return at, array.dtype.str, len(array)

    def add(self, name: object, rows: DataFrame, *counts: str) -> None:
        """A table from rows (key, counts), a range of hashes at a time."""
        parts = min(256, 1 + rows.count() // PIECE)
        keys, coded = [], [[] for _ in counts]
        for p in range(parts):
            bits = F.shiftrightunsigned("key", 56)
            got = (rows.where((bits >= 256 * p // parts) & (bits < 256 * (p + 1) // parts)) if parts > 1 else rows).toArrow()
            self._range(keys, coded, got["key"].to_numpy(), [got[c].to_numpy() for c in counts])
        self._end(name, keys, coded)

    def add_arrays(self, name: object, key: np.ndarray, counts: list[np.ndarray]) -> None:
        keys, coded = [], [[] for _ in counts]
        self._range(keys, coded, key, counts)
        self._end(name, keys, coded)

    def _range(self, keys: list, coded: list, key: np.ndarray, counts: list[np.ndarray]) -> None:
        key = key.view(np.uint64) if key.dtype == np.int64 else key.astype(np.int64).view(np.uint64)
        order = np.argsort(key, kind="stable")
        base = sum(map(len, keys))
        keys.append(key[order])
        for own, v in zip(coded, counts):
            v = v[order]
            large = np.flatnonzero(v >= 255)
            own.append((np.minimum(v, 255).astype(np.uint8), base + large, v[large].astype(np.float64)))

    def _end(self, name: object, keys: list, coded: list) -> None:
        keys = np.concatenate(keys)
        parts = [self._put(keys), self._put(Table.index(keys))]
        for own in coded:
            parts += [self._put(np.concatenate(v)) for v in zip(*own)]
        self.arrays[name] = parts

    def tables(self) -> Tables:
        self.out.close()
        self.spark.sparkContext.addFile(self.path)
        return Tables(self.file, self.arrays)


def interpolated(n: np.ndarray, total: np.ndarray, follow: np.ndarray, discount: float, lower: np.ndarray) -> np.ndarray:
    """Kneser-Ney: the discounted share of n, and what the discounts leave for the order below; that alone for an unseen context."""
    seen = total > 0
    safe = np.where(seen, total, 1)
    return np.where(seen, np.maximum(n - discount, 0) / safe + np.minimum(discount * follow / safe, 1) * lower, lower)


def least_count(sizes: DataFrame, most: int) -> int:
    """The least count with which at most `most` entries are left, from a table of column n: 1 as long as all may stay."""
    rows = sizes.groupBy(F.floor(F.log2("n")).alias("b")).agg(F.count("*").alias("k")).collect()
    left, least = sum(r.k for r in rows), 1
    for r in sorted(rows, key=lambda r: r.b):
        if left <= most:
            break
        left, least = left - r.k, 2 << r.b
    return least
