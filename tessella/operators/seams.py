"""Ownership of a picture's coarse cells: the cheapest source of each, made coherent with its neighbours."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: sweeps at most.
SWEEPS = 4
NOBODY = np.iinfo(np.int64).max


def smoothed(source: np.ndarray, cost: np.ndarray, pair: np.float32, sweeps: int) -> np.ndarray:
    """Owners (h, w) of cells with up to k candidates: source (h, w, k), NOBODY where there is none, and cost in single precision.

    A sweep takes cells row by row and sees what it has just set. A cell depends on its left and upper neighbours of this sweep
    and on its right and lower ones of the last, so the cells of an anti-diagonal are independent of each other: they are set together.
    """
    h, w, _ = source.shape
    known = source != NOBODY
    order = np.lexsort((source, np.where(known, cost, np.float32(np.inf)), ~known))[..., :1]
    owner = np.full((h + 2, w + 2), NOBODY)
    owner[1:-1, 1:-1] = np.take_along_axis(source, order, 2)[..., 0]
    many = known.sum(axis=2) >= 2
    diagonals = []
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        some = many[y, d - y]
        if some.any():
            diagonals.append((y[some], (d - y)[some]))
    for _ in range(sweeps):
        changed = False
        for y, x in diagonals:
            own, price = source[y, x], cost[y, x]
            for dy, dx in ((0, -1), (0, 1), (-1, 0), (1, 0)):
                there = owner[y + 1 + dy, x + 1 + dx][:, None]
                price = np.where((there != NOBODY) & (there != own), price + pair, price)
            price = np.where(own == NOBODY, np.float32(np.inf), price)
            price = np.where(np.isnan(price), np.float32(np.inf), price)
            least = price.min(axis=1, keepdims=True)
            best = np.where((price == least) & (price < np.inf), own, NOBODY).min(axis=1)
            changed |= bool((best != owner[y + 1, x + 1]).any())
            owner[y + 1, x + 1] = best
        if not changed:
            break
    return owner[1:-1, 1:-1]


def regularised(candidates: DataFrame, keys: list[str], pair: float, sweeps: int = SWEEPS) -> DataFrame:
    """keys, y, x, source of every cell (keys, y, x) with a candidate (source, cost): Potts smoothing with the pairwise cost `pair`.

    Ties go to the smaller source. A null cost is no candidate, an infinite one is only taken where there is no other; a pairwise cost that is
    negative or not finite counts as 0. A picture's coarse cells are one group: some thousand for the largest pictures.
    """
    pair = np.float32(max(pair, 0.0)) if np.isfinite(pair) else np.float32(0)
    rows = candidates.where("source is not null and cost is not null").select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col("source").cast("long").alias("source"), F.col("cost").cast("float").alias("cost"))

    def sweep(table: pa.Table) -> pa.Table:
        y, x, source, cost = (table.column(n).to_numpy() for n in ("y", "x", "source", "cost"))
        y0, x0 = y.min(), x.min()
        y, x = y - y0, x - x0
        order = np.lexsort((source, x, y))
        y, x, source, cost = y[order], x[order], source[order], cost[order]
        cell = y * (x.max() + 1) + x
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        place = np.arange(len(cell)) - np.repeat(starts, np.diff(np.r_[starts, len(cell)]))
        shape = int(y.max()) + 1, int(x.max()) + 1, int(place.max()) + 1
        sources, costs = np.full(shape, NOBODY), np.full(shape, np.inf, np.float32)
        sources[y, x, place], costs[y, x, place] = source, cost
        owner = smoothed(sources, costs, pair, sweeps)
        at = np.nonzero((sources != NOBODY).any(axis=2))
        found = owner[at]
        same = {k: pa.repeat(table.column(k)[0], len(found)) for k in keys}
        return pa.table({**same, "y": at[0] + y0, "x": at[1] + x0, "source": pa.array(found, mask=found == NOBODY)})

    fields = ", ".join(f"`{k}` {candidates.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInArrow(sweep, f"{fields}, y long, x long, source long")
