"""Language identification with interpolated Kneser-Ney character models.

Every labelled language gets a model of order 4. Executors count 4-grams of whole texts, Spark sums
the counts and derives the continuation counts of the lower orders, and the model travels as sorted
arrays of gram hashes beside their counts. A text goes to the language whose model gives it the lowest
cross-entropy per character; a text that even the best model finds stranger than the training texts is
rejected.

Hashes have 64 bits and code points are whole, so grams do not share counts. All of them are kept, in a file that the workers of an
executor map together. Who wants a smaller model may give `most`: beyond so many entries grams and contexts seen fewer than
a least count of times (doubled until the rest fits) back off to shorter ones. Totals, continuation counts
and discounts are those of all texts in any case.

Nulls and odd input: a null or letterless text is `und` with score 0 and is rejected; rows with a null
language or null doc_id teach nothing; with nothing to learn from every text is `und`. Repeated rows
count as often as they occur and are each scored. Ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLOCK_CHARS, batch, blocks, documents, free_names, held_out, slices, written
from .kneser_ney import CHAR, PIECE, Counts, Writer, code_points, context, distinct, grams, hashed, interpolated, least_count, np_context, np_suffix, suffix

ORDER = 4
PAD = ORDER - 1
#: Entries that a counting task holds before it passes partial counts on.
FLUSH_GRAMS = 2_000_000
#: What the shortest gram backs off to: any code point alike.
UNKNOWN = 1.0 / (1 << CHAR)
_OTHER = re.compile(r"[\W\d_]+")


def _normal(text: str | None) -> str:
    """Lower case; every run of non-letters becomes one space; empty if there is no letter."""
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hi and lo of the 4-grams of the texts, each led by PAD spaces and ended by one, and each gram's text."""
    parts = [" " * PAD + t + " " for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
    starts = np.cumsum([0, *(len(p) for p in parts[:-1])])
    for k in range(PAD):
        owner[starts + k] = -1
    hi, lo = grams(code_points("".join(parts)), ORDER)
    owner = owner[PAD:]
    real = owner >= 0
    return hi[real], lo[real], owner[real]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("hi", pa.int64()), ("lo", pa.int64()), ("n", pa.int64())])
    counts = Counts()

    def given() -> Iterator[pa.RecordBatch]:
        for lang, hi, lo, n in counts.take():
            yield batch(schema, [[lang] * len(n), hi, lo, n])

    for rb in slices(batches):
        langs, texts = rb.column(0).to_pylist(), rb.column(1).to_pylist()
        by: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts):
            if own := _normal(text):
                by.setdefault(lang, []).append(own)
        for lang, own in by.items():
            for lo, hi in blocks([len(t) for t in own]):
                counts.add(lang, *_grams(own[lo:hi])[:2])
                if counts.size > FLUSH_GRAMS and counts.merged() > FLUSH_GRAMS // 2:
                    yield from given()
    yield from given()


class Model:
    """Kneser-Ney models of all languages over sorted hash arrays."""

    def __init__(self, langs: list[str], tables: dict, totals: dict, discounts: dict):
        self.langs, self.tables, self.totals, self.discounts = langs, tables, totals, discounts

    def nats(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """-log P(last character | the three before) for each distinct gram and language."""
        out = np.empty((len(lo), len(self.langs)))
        hashes = {}
        for k in range(1, ORDER + 1):
            own = np_suffix(hi, lo, k)
            hashes[k] = hashed(*own), hashed(*np_context(*own))
        for i, lang in enumerate(self.langs):
            total, kinds = self.totals[lang]
            p = np.full(len(lo), UNKNOWN)
            for k in range(1, ORDER + 1):
                (n,) = self.tables[lang, k, "gram"].look(hashes[k][0])
                all_n, follow = self.tables[lang, k, "context"].look(hashes[k][1]) if k > 1 else (np.full(len(lo), total), np.full(len(lo), kinds))
                p = interpolated(n, all_n, follow, self.discounts[lang, k], p)
            out[:, i] = -np.log(np.clip(p, 1e-12, 1.0))
        return out


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text", most: int | None = None) -> Model:
    """Models from every row of `labelled` with a language and a text; whole ones, unless `most` entries are asked for."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    level = written(rows.mapInArrow(_count, "lang string, hi bigint, lo bigint, n bigint").groupBy("lang", "hi", "lo").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(r[0] for r in level.select("lang").distinct().collect())
    parts, totals, discounts = [], {}, {}
    for k in range(ORDER, 0, -1):
        for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"), F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
            discounts[r.lang, k] = max(0.1, min(0.9, r.n1 / (r.n1 + 2 * r.n2))) if r.n1 else 0.5
            if k == 1:
                totals[r.lang] = (float(r.n), float(r.kinds))
        parts.append(level.select("lang", F.lit(2 * k).alias("table"), F.xxhash64("hi", "lo").alias("key"), "n", F.lit(0).cast("long").alias("m")))
        if k > 1:
            hi, lo = context()
            own = level.groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(F.sum("n").alias("n"), F.count("*").alias("m"))
            parts.append(own.select("lang", F.lit(2 * k + 1).alias("table"), F.xxhash64("hi", "lo").alias("key"), "n", "m"))
            hi, lo = suffix(k - 1)
            level = level.groupBy("lang", hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("n"))
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") if langs else F.lit(0)
    union = written(union.select(number.alias("lang"), "table", "key", F.col("n").cast("float").alias("n"), F.col("m").cast("float").alias("m")), "model")
    if most is not None:
        union = union.where(F.col("n") >= least_count(union, most))
    writer = Writer(labelled.sparkSession)
    got = union.toArrow() if union.count() <= PIECE else None
    for i, lang in enumerate(langs, 1):
        for k in range(1, ORDER + 1):
            for kind in ("gram", "context"):
                counts, table = "nm"[: 2 if kind == "context" else 1], 2 * k + (kind == "context")
                if got is None:
                    writer.add((lang, k, kind), union.where((F.col("lang") == i) & (F.col("table") == table)), *counts)
                else:
                    own = np.flatnonzero((got["lang"].to_numpy() == i) & (got["table"].to_numpy() == table))
                    writer.add_arrays((lang, k, kind), got["key"].to_numpy()[own], [got[c].to_numpy()[own] for c in counts])
    tables = writer.tables()
    return Model(langs, tables, totals, discounts)


def score_texts(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Nats per character for each text and language (inf without a letter), and the characters of each."""
    normal = [_normal(t) for t in texts]
    size = np.array([len(t) for t in normal], dtype=np.int64)
    total = np.zeros((len(texts), len(model.langs)))
    for lo, hi in blocks(size):
        own = [i for i in range(lo, hi) if size[i]]
        if not own:
            continue
        all_hi, all_lo, owner = _grams([normal[i] for i in own])
        for a in range(0, len(owner), BLOCK_CHARS):
            *unique, codes = distinct(all_hi[a : a + BLOCK_CHARS], all_lo[a : a + BLOCK_CHARS])
            table = model.nats(*unique)
            for j in range(len(model.langs)):
                total[own, j] += np.bincount(owner[a : a + BLOCK_CHARS], weights=table[codes, j], minlength=len(own))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(size[:, None] > 0, total / (size[:, None] + 1), np.inf), size


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with a struct `lid` beside their own columns: lang, score, nats (per character), letters.

    The struct's name is lengthened if docs has one of that name; it is always the last column.
    """
    spark = docs.sparkSession
    (name,) = free_names(docs.columns, "lid")
    at = docs.columns.index(text)
    kept = [docs.columns.index(c) for c in keep or docs.columns]
    shared = spark.sparkContext.broadcast(model)
    kinds = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("nats", pa.float64()), ("letters", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rb in slices(batches):
            texts = rb.column(at).to_pylist()
            if model.langs:
                nats, size = score_texts(texts, model)
                best = nats.argmin(axis=1)
                least = nats[np.arange(len(texts)), best]
                # the evidence of at most 50 characters: long texts would make every score 1
                with np.errstate(invalid="ignore"):
                    gap = np.where(size[:, None] > 0, (nats - least[:, None]) * np.minimum(size, 50)[:, None], 0)
                score = np.where(size > 0, 1 / np.exp(-gap).sum(axis=1), 0.0)
                lang = [model.langs[b] if n else "und" for b, n in zip(best, size)]
            else:
                lang, score, least, size = ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf), np.zeros(len(texts), np.int64)
            least = pa.array(np.where(np.isfinite(least), least, 0.0), mask=~np.isfinite(least))
            own = pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), least, pa.array(size)], fields=list(kinds))
            yield pa.RecordBatch.from_arrays([*(rb.column(i) for i in kept), own], names=[*(rb.schema.names[i] for i in kept), name])

    lid = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("nats", T.DoubleType()), T.StructField("letters", T.LongType())])
    return docs.mapInArrow(run, T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField(name, lid)]))


def strangeness(nats: Column, middle: Column, letters: Column) -> Column:
    """Nats above the language's median, less where a text is short."""
    return (nats - middle) * F.sqrt(F.least(letters, F.lit(200)) / 200.0)


def calibrated(scored: DataFrame, lid: str, known: Column, train: Column) -> DataFrame:
    """scored with a last column `<lid>_rejected`.

    The limit of a language is twice the 99.9th percentile of strangeness among its rightly recognised
    training texts, and at least half of their median cross-entropy: clean texts stay, texts of no learned language go.
    """
    right = scored.where(train & (known == F.col(f"{lid}.lang")))
    mid = right.groupBy(F.col(f"{lid}.lang").alias("l")).agg(F.percentile_approx(f"{lid}.nats", 0.5, 10000).alias("middle"))
    middles = {r.l: r.middle for r in mid.collect()}
    (name,) = free_names(scored.columns, f"{lid}_rejected")
    if not middles:
        return scored.withColumn(name, F.col(f"{lid}.lang") == "und")
    middle = F.create_map(*[F.lit(x) for kv in middles.items() for x in kv])[F.col(f"{lid}.lang")]
    odd = strangeness(F.col(f"{lid}.nats"), middle, F.col(f"{lid}.letters"))
    limits = {r.l: max(2 * r.top, middles[r.l] / 2) for r in right.groupBy(F.col(f"{lid}.lang").alias("l")).agg(F.percentile_approx(odd, 0.999, 10000).alias("top")).collect()}
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col(f"{lid}.lang")]
    return scored.withColumn(name, (F.col(f"{lid}.lang") == "und") | F.coalesce(odd > limit, F.lit(False)))


def recognised(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """docs, learned from by `lang` and then identified; the struct `lid` and `lid_rejected` come last.

    keep: the columns to return beside those two, all if None; it must have doc_id and lang.
    """
    train = ~held_out()
    model = learn(docs.where(train))
    scored = written(identify(docs, model, keep=keep), "languages")
    return calibrated(scored, scored.columns[-1], F.col("lang"), train)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns of docs."""
    found = recognised(docs)
    return found.where(~F.col(found.columns[-1])).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = recognised(documents(spark, sf_dir).select("doc_id", "lang", "text"), keep=["doc_id", "lang"])
    return found.select("doc_id", held_out().alias("held_out"), F.col("lid.lang").alias("lang_pred"), F.col("lid.score").alias("score"), F.col("lid.nats").alias("nats_per_char"), F.col("lid_rejected").alias("rejected"))
