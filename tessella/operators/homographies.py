"""Robust homographies of matched edges: four-point samples, inlier consensus and a refit, many edges in a batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The fewest matches, the greatest distance in pixels, samples at most, and the confidence that ends sampling.
LEAST, NEAR, SAMPLES, SURE = 12, 3.0, 4000, 0.997
#: Samples that are tried at once, and times that a refit may widen the consensus.
CHUNK, GROWTHS = 128, 5
RESULT = "reason int, matches int, inliers int, ratio double, dx double, dy double, residual double, homography array<double>"


def _adjugate(m: np.ndarray) -> np.ndarray:
    """Inverse of 3 x 3 matrices but for the scale, which a homography does not have."""
    return np.stack([np.cross(m[..., 1, :], m[..., 2, :]), np.cross(m[..., 2, :], m[..., 0, :]), np.cross(m[..., 0, :], m[..., 1, :])], axis=-1)


def of_four(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Homographies (m, 3, 3) that take four points (m, 4, 2) to four others, by way of the projective basis."""

    def basis(p: np.ndarray) -> np.ndarray:
        h = np.concatenate([p, np.ones((*p.shape[:-1], 1))], axis=-1)
        three = np.swapaxes(h[:, :3], 1, 2)
        scale = (_adjugate(three) @ h[:, 3, :, None])[..., 0]
        return three * scale[:, None, :]

    return basis(target) @ _adjugate(basis(source))


def distances(h: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """How far (m, n) each homography (m, 3, 3) takes each source point from its target; infinite on the horizon."""
    with np.errstate(all="ignore"):
        p = h[:, :, :2] @ source.T + h[:, :, 2:]
        d = np.hypot(p[:, 0] / p[:, 2] - target[:, 0], p[:, 1] / p[:, 2] - target[:, 1])
    return np.where(np.isfinite(d), d, np.inf)


def _normal(p: np.ndarray) -> np.ndarray:
    centre = p.mean(axis=0)
    scale = math.sqrt(2) / max(np.hypot(*(p - centre).T).mean(), 1e-12)
    return np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]])


def refit(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The homography of many points: a normalised direct linear solve, then Gauss-Newton on the distances while they fall."""
    a, b = _normal(source), _normal(target)
    s, t = source @ a[:2, :2].T + a[:2, 2], target @ b[:2, :2].T + b[:2, 2]
    one, zero = np.ones(len(s)), np.zeros((len(s), 3))
    row = np.column_stack([s, one])
    system = np.concatenate([np.column_stack([row, zero, -t[:, :1] * row]), np.column_stack([zero, row, -t[:, 1:] * row])])
    h = np.linalg.eigh(system.T @ system)[1][:, 0]
    error = np.inf
    for _ in range(10):
        w = row @ h[6:]
        x, y = row @ h[:3] / w, row @ h[3:6] / w
        off = np.concatenate([x - t[:, 0], y - t[:, 1]])
        if not (now := off @ off) < error * (1 - 1e-12):
            break
        best, error = h, now
        j = np.concatenate([np.column_stack([row, zero, -x[:, None] * row]), np.column_stack([zero, row, -y[:, None] * row])]) / np.concatenate([w, w])[:, None]
        h = h - np.linalg.lstsq(j, off, rcond=1e-10)[0]
    return np.linalg.inv(b) @ best.reshape(3, 3) @ a


def consensus(source: np.ndarray, target: np.ndarray, near: float, rng: np.random.Generator) -> np.ndarray | None:
    """The inliers of the homography that most points agree with, or None; sampling ends when a better one is unlikely."""
    n, tried, wanted, best = len(source), 0, SAMPLES, None
    while tried < wanted:
        four = np.argsort(rng.random((CHUNK, n)), axis=1)[:, :4] if n < 64 else rng.integers(0, n, (CHUNK, 4))
        found = of_four(source[four], target[four])
        with np.errstate(invalid="ignore"):
            inside = distances(found, source, target) <= near
        count = inside.sum(axis=1)
        k = int(count.argmax())
        if count[k] >= 4 and (best is None or count[k] > best.sum()):
            best = inside[k]
            miss = 1 - (count[k] / n) ** 4
            wanted = min(wanted, math.ceil(math.log(1 - SURE) / math.log(miss))) if 0 < miss < 1 else tried
        tried += CHUNK
    return best


def fitted(points: np.ndarray, near: float, seed: int) -> tuple:
    """A row of RESULT for the points (n, 4) of one edge: sx, sy, tx, ty."""
    n = len(points)
    nothing = (n, None, None, None, None, None, None)
    if n < LEAST:
        return 2, *nothing
    source, target = points[:, :2], points[:, 2:]
    inside = consensus(source, target, near, np.random.default_rng(seed))
    if inside is None:
        return 3, *nothing
    try:
        h = refit(source[inside], target[inside])
        for _ in range(GROWTHS):  # a sample of four points with noise misses some that the refit reaches
            wider = distances(h[None], source, target)[0] <= near
            if wider.sum() <= inside.sum():
                break
            inside = wider
            h = refit(source[inside], target[inside])
    except np.linalg.LinAlgError:
        return 3, *nothing
    if not np.isfinite(h).all() or abs(h[2, 2]) < 1e-12 * np.abs(h).max():
        return 3, *nothing
    inside = inside & np.isfinite(off := distances(h[None], source, target)[0])
    if not inside.any():
        return 3, *nothing
    shift = np.median(target[inside] - source[inside], axis=0)
    return 0, n, int(inside.sum()), inside.sum() / n, *shift.tolist(), float(np.median(off[inside])), (h / h[2, 2]).ravel().tolist()


def robust(points: DataFrame, keys: list[str], scale: str | None = None) -> DataFrame:
    """keys and, for each edge, its homography with reason (0 found, 2 fewer than 12 matches, 3 none), matches, inliers,
    ratio, dx, dy (medians over the inliers) and residual (their median distance).

    points: keys, sx, sy, tx, ty; rows with a coordinate that is null or not finite have no part. `scale` names a column by which the 3 pixels of
    an edge are multiplied. An edge is one row with its points, bounded by the features that a picture keeps, so a batch holds many edges and
    none is split. Points are put in order and samples seeded by the edge, so reruns agree.
    """
    xy = ["sx", "sy", "tx", "ty"]
    fine = points.where(" and ".join(f"{x} is not null and abs({x}) < double('infinity')" for x in xy))
    near = F.lit(NEAR) if scale is None else NEAR * F.max(scale)
    rows = fine.groupBy(*keys).agg(F.sort_array(F.collect_list(F.array(*[F.col(x).cast("double") for x in xy]))).alias("_p"), near.cast("double").alias("_near"))
    rows = rows.withColumn("_seed", F.xxhash64(*keys))
    fields = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys)
    kinds = pa.schema([("reason", pa.int32()), ("matches", pa.int32()), ("inliers", pa.int32()), ("ratio", pa.float64()), ("dx", pa.float64()), ("dy", pa.float64()), ("residual", pa.float64()), ("homography", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = []
            for p, near, seed in zip(*(rb.column(x) for x in ("_p", "_near", "_seed"))):
                own = p.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
                found.append(fitted(own, near.as_py(), seed.as_py() % (1 << 64)))
            columns = [pa.array(x, f.type) for x, f in zip(zip(*found) if found else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*(rb.column(k) for k in keys), *columns], names=[*keys, *kinds.names])

    return rows.mapInArrow(run, f"{fields}, {RESULT}")
