"""Toxicity by class-conditional Kneser-Ney models.

Toxic and ordinary training texts get a character model of order 6 each. Orders 6 to 4 have counts of
their class (raw at the top, continuation counts below), orders 3 to 1 have continuation counts that
both classes share, so an expression that a class has hardly seen is judged by what all texts have in
common and speaks for neither class. A text is compared by its log-likelihood under both models,
normalised by length: over the whole text and over its most toxic run of RUN words. A logistic curve
turns both into a probability; its four coefficients are fitted on at most SAMPLE labelled training
texts, each scored by models that leave out its half of the training texts.

Counts cover all labelled training texts, of whole code points. All grams and contexts are kept, in files that the workers of an executor
map together. Who wants a smaller model may give `most`: beyond so many entries grams and contexts seen fewer than a least count of times (doubled
until the rest fits) back off to shorter ones. Discounts and totals are those of all training texts in any case.

Nulls and odd input: null, empty and letterless texts get the score of no evidence; rows with a null
doc_id or null label teach nothing; a document with several labels has the greatest; without labels of
both classes every score is 0. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLOCK_CHARS, batch, blocks, documents, held_out, likely, release, slices, tables_written, written
from .kneser_ney import CHAR, Counts, Writer, code_points, context, distinct, grams, hashed, interpolated, least_count, np_context, np_suffix, suffix
from .op1_language_id import _normal

ORDER = 6
SHARED = 3
PAD = ORDER - 1
RUN = 3
SAMPLE = 20_000
FLUSH_GRAMS = 1_500_000


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of the 6-grams of the texts, whose words end in a space each; the text and the word of every gram."""
    parts = [" " * PAD + t + " " for t in texts]
    codes = code_points("".join(parts))
    size = np.array([len(p) for p in parts])
    real = np.ones(len(codes), bool)
    start = np.cumsum(size) - size
    for k in range(PAD):
        real[start + k] = False
    hi, lo = grams(codes, ORDER)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)[real]
    stop = (codes == 32)[real]
    word = np.r_[0, np.cumsum(stop)[:-1]] if len(stop) else np.empty(0, np.int64)
    real = real[PAD:]
    return hi[real], lo[real], owner, word


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])
    counts = Counts()

    def given() -> Iterator[pa.RecordBatch]:
        for part, hi, lo, n in counts.take():
            yield batch(schema, [np.full(len(n), part, np.int32), hi, lo, n])

    for rb in slices(batches):
        parts, texts = np.array(rb.column(0).to_pylist()), rb.column(1).to_pylist()
        for part in np.unique(parts).tolist():
            own = [t for t in (_normal(texts[i]) for i in np.flatnonzero(parts == part)) if t]
            for lo, hi in blocks([len(t) for t in own]):
                counts.add(part, *_grams(own[lo:hi])[:2])
                if counts.size > FLUSH_GRAMS and counts.merged() > FLUSH_GRAMS // 2:
                    yield from given()
    yield from given()


class Model:
    """Toxic against ordinary: sorted hash arrays with the counts of both classes beside them."""

    def __init__(self, tables: dict, discounts: dict, unigrams: tuple[float, float]):
        self.tables, self.discounts, self.unigrams = tables, discounts, unigrams

    def _sums(self, k: int, own: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        if k > 1:
            return self.tables[k, "context"].look(hashed(*np_context(*own)))
        return [np.full(len(own[0]), x) for x in self.unigrams]

    def shared(self, lo: np.ndarray) -> np.ndarray:
        """P of the last of three characters by the counts that both classes share."""
        unique, code = np.unique(lo, return_inverse=True)
        p = np.full(len(unique), 1 / (1 << CHAR))
        for k in range(1, SHARED + 1):
            own = np_suffix(np.zeros_like(unique), unique, k)
            (n,) = self.tables[k, "gram"].look(hashed(*own))
            p = interpolated(n, *self._sums(k, own), self.discounts[k, 0], p)
        return p[code]

    def likelihoods(self, hi: np.ndarray, lo: np.ndarray) -> list[np.ndarray]:
        """P of the last character of each gram for ordinary and for toxic texts."""
        p = [self.shared(lo)] * 2
        for k in range(SHARED + 1, ORDER + 1):
            own = np_suffix(hi, lo, k)
            n, sums = self.tables[k, "gram"].look(hashed(*own)), self._sums(k, own)
            p = [interpolated(n[y], sums[y], sums[y + 2], self.discounts[k, y], p[y]) for y in (0, 1)]
        return p

    def evidence(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """log P_toxic - log P_ordinary of the last character of each gram."""
        ordinary, toxic = (np.log(np.clip(p, 1e-9, 1)) for p in self.likelihoods(hi, lo))
        return toxic - ordinary


def learn(counts: DataFrame, most: int | None = None) -> Model:
    """A model from the table (toxic, hi, lo, n) of 6-gram counts; the whole one, unless `most` entries are asked for."""
    of = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))
    mark = tables_written()
    level = written(counts.groupBy("hi", "lo").agg(of(0).alias("n0"), of(1).alias("n1")), "grams6")
    known, discounts, unigrams = [], {}, (0.0, 0.0)
    for k in range(ORDER, 0, -1):
        cols = ["n0", "n1"] if k > SHARED else ["n0"]
        r = level.agg(*[F.count_if(F.col(c) == x).alias(f"{c}is{x}") for c in cols for x in (1, 2)], F.sum("n0").alias("n"), F.count("*").alias("kinds")).collect()[0]
        for y, c in enumerate(cols):
            one, two = r[f"{c}is1"], r[f"{c}is2"]
            discounts[k, y] = max(0.3, min(0.95, one / (one + 2 * two))) if one else 0.5
        whole = lambda df, *own: df.select(F.xxhash64("hi", "lo").alias("key"), *[F.col(c).cast("float").alias(c) for c in own])
        known.append(((k, "gram"), whole(level, *cols)))
        if k > 1:
            hi, lo = context()
            own = level.groupBy(hi.alias("hi"), lo.alias("lo")).agg(*[F.sum(c).alias(c) for c in cols], *[F.count_if(F.col(c) > 0).alias(f"f{c}") for c in cols])
            known.append(((k, "context"), written(whole(own, *cols, *[f"f{c}" for c in cols]), "contexts")))
            hi, lo = suffix(k - 1)
            lower = level.groupBy(hi.alias("hi"), lo.alias("lo"))
            # from SHARED down both classes share the counts
            kinds = [F.count_if(F.col("n0") > 0).alias("n0"), F.count_if(F.col("n1") > 0).alias("n1")] if k > SHARED + 1 else [F.count("*").alias("n0")]
            level = written(lower.agg(*kinds), "grams")
        else:
            unigrams = (float(r.n or 0), float(r.kinds))
    total = lambda df: F.col("n0") + F.col("n1") if "n1" in df.columns else F.col("n0")
    least = 1
    if most is not None:
        sizes = known[0][1].select(total(known[0][1]).alias("n"))
        for _, df in known[1:]:
            sizes = sizes.union(df.select(total(df).alias("n")))
        least = least_count(sizes, most)
    writer = Writer(counts.sparkSession)
    for which, df in known:  # one at a time, and in pieces, so that the driver holds a piece as Arrow
        writer.add(which, df.where(total(df) >= least) if least > 1 else df, *df.columns[1:])
    tables = writer.tables()
    release(counts.sparkSession, mark)
    return Model(tables, discounts, unigrams)


def features(texts: list[str | None], model: Model) -> np.ndarray:
    """For each text: mean evidence of a word, mean evidence of a word in the most toxic run, log of the words."""
    normal = [_normal(t) for t in texts]
    out = np.zeros((len(texts), 3))
    some = [i for i, t in enumerate(normal) if t]
    for start, stop in blocks([len(normal[i]) for i in some]):
        own = some[start:stop]
        hi, lo, owner, word = _grams([normal[i] for i in own])
        total = np.zeros(int(word[-1]) + 1)
        for a in range(0, len(lo), BLOCK_CHARS):
            *unique, codes = distinct(hi[a : a + BLOCK_CHARS], lo[a : a + BLOCK_CHARS])
            at = word[a : a + BLOCK_CHARS]
            total[at[0] : at[-1] + 1] += np.bincount(at - at[0], weights=model.evidence(*unique)[codes])
        first = np.flatnonzero(np.r_[True, np.diff(word) > 0])
        text = owner[first]
        n = np.bincount(text, minlength=len(own))
        mean = np.bincount(text, weights=total, minlength=len(own)) / n
        run = total.copy()
        for k in range(1, RUN):
            same = np.r_[text[k:] == text[:-k], np.zeros(min(k, len(text)), bool)]
            run += np.where(same, np.r_[total[k:], np.zeros(min(k, len(total)))], 0)
        start = np.r_[0, np.cumsum(n)[:-1]]
        out[own, 0], out[own, 1], out[own, 2] = mean, np.maximum.reduceat(run, start) / RUN, np.log1p(n)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, the intercept last, by Newton's method."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, np.ndarray] | None:
    """Models and coefficients from labels (doc_id, toxic) of the documents that are not held out."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")
    train = likely(docs.where(~held_out() & F.col("text").isNotNull()).select("doc_id", "text"), known, "doc_id").join(known.where(~held_out()), "doc_id")
    counted = train.select((2 * half + F.col("toxic")).cast("int").alias("part"), "text").mapInArrow(_count, "part int, hi bigint, lo bigint, n bigint")
    counts = written(counted.groupBy("part", "hi", "lo").agg(F.sum("n").alias("n")), "counts").withColumn("toxic", F.col("part") % 2)
    if len({r.toxic for r in counts.select("toxic").distinct().collect()}) < 2:
        return None
    # at most SAMPLE labelled rows, chosen by hash, for the curve
    order = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(1 << 30))
    pool = known.where(~held_out())
    share = min(1.0, 0.95 * SAMPLE / max(1, pool.count()))
    sample = pool.where(order < int(share * (1 << 30))).limit(SAMPLE)
    others = [spark.sparkContext.broadcast(learn(counts.where((F.col("part") < 2) != F.lit(h == 0)))) for h in (0, 1)]
    schema = pa.schema([("toxic", pa.int32()), *((c, pa.float64()) for c in "abc")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            toxic, part, texts = np.array(rb.column(0).to_pylist()), np.array(rb.column(1).to_pylist()), rb.column(2).to_pylist()
            for h in (0, 1):
                own = np.flatnonzero(part == h)
                if len(own):
                    x = features([texts[i] for i in own], others[h].value)
                    yield batch(schema, [toxic[own], *x.T])

    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("toxic", half.alias("half"), "text")
    got = picked.mapInArrow(run, "toxic int, a double, b double, c double").toPandas()
    for b in others:
        b.unpersist()
    y = got["toxic"].to_numpy(float)
    return learn(counts), logistic(got[["a", "b", "c"]].to_numpy(), y) if 0 < y.sum() < len(y) else np.array([1.0, 1.0, 0.0, 0.0])


def scored(docs: DataFrame, fitted: tuple[Model, np.ndarray] | None) -> DataFrame:
    """doc_id and score of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if fitted is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(fitted)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, w = shared.value
        for rb in slices(batches):
            x = features(rb.column(1).to_pylist(), model)
            yield batch(schema, [rb.column(0), 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -50, 50)))])

    return rows.mapInArrow(run, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
