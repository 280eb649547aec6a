"""Line dedup by pairwise alignment.

Lines are cut at sentence ends into units, so that a passage is the same units wherever it stands in a
line. Two documents overlap where they share a rare run of units: from every unit the shortest run of at
least BLOCK_WORDS words is a key, and keys that one document alone has are the common case. Each key's
first holder (smallest document) is the earlier partner of every later holder, so a run that n documents
share gives n - 1 pairs, and any stretch of BLOCK_WORDS words or more that two documents share has a key.

Each pair is aligned by patience diff over the hashes of all its units: the longest increasing subsequence
of the places of its shared runs, each of which then grows to both sides as far as units are equal. Runs
that cross the aligned ones (passages in another order, or twice in the later document) are aligned in
further passes until none is left. The aligned blocks are deleted from the later document.

Pairs travel as arrays of unit hashes. Those of one earlier document are dealt over as many salts as the
number of all pairs asks for, so an earlier document that very many others quote is no single task.

Blank lines have no part in the alignment and go with the block that they are in. A document without a
block is left as it is, byte for byte.

Nulls and odd input: null and empty texts have no lines and are kept; rows with a null doc_id are
neither searched nor changed; rows that repeat a doc_id and text are one document and are treated alike;
different texts under one doc_id are told apart and the smaller hash is the earlier. An empty table
gives an empty result. A document that is deleted wholly keeps its row with an empty text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, slices, written

BLOCK_WORDS = 30
#: Pairs that one salt of an earlier document should hold at most, if pairs were spread evenly.
PAIRS_A_SALT = 1 << 16
LEAST_SALTS = 64
#: Texts whose units are held at once.
TEXTS = 500
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def units(text: str) -> list[str]:
    """The sentences of a text, line by line, none of them blank."""
    for mark in ".!?;":
        text = text.replace(mark + " ", mark + "\n").replace(mark + "\t", mark + "\n")
    if not text.isascii():
        for mark in "。！？":
            text = text.replace(mark, mark + "\n")
    return [x for x in map(str.strip, text.split("\n")) if x]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(known)
    return known[:n]


def runs(h: np.ndarray, words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First unit, unit after the last and key of the shortest run of BLOCK_WORDS words from every unit.

    h and words are the units' hashes and words, ends where documents end among them; a run stays in its document.
    """
    before = np.r_[0, np.cumsum(words)]
    stop = np.searchsorted(before, before[:-1] + BLOCK_WORDS)
    start = np.flatnonzero(stop <= np.repeat(ends, np.diff(ends, prepend=0)))
    stop = stop[start]
    total = np.r_[np.uint64(0), np.cumsum(h * powers(_INVERSE, len(h)))]
    return start, stop, (total[stop] - total[start]) * powers(_BASE, len(h))[start]


UNITS = "doc_id long, h long, hashes array<long>, words array<int>, keys array<long>"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(values))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for some in slices(batches, TEXTS):
        own = [units(t) for t in some.column(2).to_pylist()]
        flat = [u for o in own for u in o]
        h = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
        words = np.fromiter((len(u.split()) for u in flat), np.int32, len(flat))
        ends = np.cumsum([len(o) for o in own])
        start, _, key = runs(h, words, ends)
        per = np.searchsorted(start, ends)
        columns = [some.column(0), some.column(1), _lists(h.view(np.int64), ends), _lists(words, ends), _lists(key.view(np.int64), per)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "hashes", "words", "keys"])


def increasing(places: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops, piles, back = [], [], [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tops, x)
        back[i] = piles[k - 1] if k else -1
        tops[k : k + 1], piles[k : k + 1] = [x], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _alike(a: np.ndarray, b: np.ndarray) -> int:
    """How many units are equal from the start on."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


class Earlier:
    """The earlier document of pairs: its unit hashes and the places of its runs."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray):
        self.hashes = hashes
        self.places: dict[int, list[int]] = defaultdict(list)
        start, _, key = runs(hashes.view(np.uint64), words, np.array([len(hashes)]))
        for i, k in zip(start.tolist(), key.tolist()):
            self.places[k].append(i)

    def blocks(self, own: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
        """Aligned blocks (first unit, last unit + 1) of a later document with these units."""
        start, stop, key = runs(own.view(np.uint64), words, np.array([len(own)]))
        seen: Counter[int] = Counter()
        left = []
        for i, j, k in zip(start.tolist(), stop.tolist(), key.tolist()):
            places = self.places.get(k)
            if places:
                # the k-th occurrence goes with the k-th, those beyond the last with the last
                p = places[min(seen[k], len(places) - 1)]
                seen[k] += 1
                if np.array_equal(own[i:j], self.hashes[p : p + j - i]):
                    left.append((i, j, p))
        out: list[tuple[int, int]] = []
        while left:
            found: list[tuple[int, int]] = []
            for n in increasing([p for _, _, p in left]):
                i, j, p = left[n]
                if found and j <= found[-1][1]:
                    continue
                first = i - _alike(own[:i][::-1], self.hashes[:p][::-1])
                found.append((first, j + _alike(own[j:], self.hashes[p + j - i :])))
            out += found
            left = [x for x in left if not any(a <= x[0] and x[1] <= b for a, b in found)]
        return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of every pair; the rows (other_id, other_h, salt, later, doc_id, h, hashes, words) of an earlier document begin with itself."""
    earlier, at = None, None
    for rb in batches:
        other, other_h, later, doc, h = (rb.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
        hashes, words = rb.column(6), rb.column(7)
        ends_h, ends_w = hashes.offsets.to_numpy(), words.offsets.to_numpy()
        hashes, words = hashes.values.to_numpy(), words.values.to_numpy()
        out = []
        for i in range(rb.num_rows):
            own, size = hashes[ends_h[i] : ends_h[i + 1]], words[ends_w[i] : ends_w[i + 1]]
            if not later[i]:
                earlier, at = Earlier(own, size), (other[i], other_h[i])
            elif at == (other[i], other_h[i]):
                out += [(doc[i], h[i], a, b) for a, b in earlier.blocks(own, size)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "h", "first", "last"])


def overlaps(docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """(doc_id, h, spans): the units to delete from every document that has some; h is its text's hash."""
    rows = docs.select(doc_id.cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).where("doc_id is not null and text is not null")
    table = written(rows.mapInArrow(_units, UNITS), "units")
    keys = table.select("doc_id", "h", F.explode("keys").alias("key"))
    first = keys.groupBy("key").agg(F.min(F.struct("doc_id", "h")).alias("at"), F.count("*").alias("n")).where("n > 1")
    # a table of its own, so that both sides of the join are shuffled for it and Spark can split a hot key
    first = written(first.select("key", F.col("at.doc_id").alias("other_id"), F.col("at.h").alias("other_h")), "holders")
    pairs = keys.join(first, "key").where("doc_id > other_id or (doc_id = other_id and h > other_h)")
    pairs = written(pairs.select("doc_id", "h", "other_id", "other_h").distinct(), "pairs")
    salts = LEAST_SALTS + pairs.count() // PAIRS_A_SALT
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(salts)))
    parts = ["other_id", "other_h", "salt", "later", "doc_id", "h", "hashes", "words"]
    later = salted.join(table, ["doc_id", "h"]).withColumn("later", F.lit(True)).select(*parts)
    earlier = salted.select("other_id", "other_h", "salt", F.lit(False).alias("later"), F.col("other_id").alias("doc_id"), F.col("other_h").alias("h")).distinct().join(table, ["doc_id", "h"]).select(*parts)
    ordered = later.union(earlier).repartition("other_id", "other_h", "salt").sortWithinPartitions(*parts[:6])
    blocks = ordered.mapInArrow(_align, "doc_id long, h long, first int, last int")
    return blocks.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))


def cut_lines(text: str, spans: list[tuple[int, int]]) -> tuple[str, int, int]:
    """text without the units in the spans, the lines that lose some and the words deleted."""
    out, i, lines, words, inside = [], 0, 0, 0, False
    marks = set()
    for a, b in spans:
        marks.update(range(a, b))
    for raw in text.split("\n"):
        own = units(raw)
        cut = [k for k in range(len(own)) if i + k in marks]
        if own:
            inside = i + len(own) - 1 in marks
            i += len(own)
        if cut:
            lines, words = lines + 1, words + sum(len(own[k].split()) for k in cut)
            if len(cut) < len(own):
                out.append(without(raw, own, set(cut)))
        elif own or not inside:
            out.append(raw)
    return "\n".join(out), lines, words


def without(line: str, own: list[str], cut: set[int]) -> str:
    """line without the units in cut and the white space after them; the rest byte for byte."""
    out, at = [], 0
    starts = []
    for unit in own:
        starts.append(line.index(unit, at))
        at = starts[-1] + len(unit)
    out.append(line[: starts[0]])
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(line)])):
        if k not in cut:
            out.append(line[a:b])
    return "".join(out)


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A struct `row` of docs' columns with the text cut, and removed_lines and removed_words."""
    spans = overlaps(docs, F.col(doc_id), F.col(text)).withColumnsRenamed({"doc_id": "d", "h": "th"})

    @F.pandas_udf("text string, lines long, words long")
    def cut(texts: pd.Series, where: pd.Series) -> pd.DataFrame:
        got = [(None, 0, 0) if w is None else cut_lines(t, [(s["first"], s["last"]) for s in w]) for t, w in zip(texts, where)]
        return pd.DataFrame(got, columns=["text", "lines", "words"])

    own = F.col(f"row.{text}")
    rows = docs.select(F.struct("*").alias("row"))
    joined = rows.join(spans, (F.col(f"row.{doc_id}").cast("long") == F.col("d")) & (F.xxhash64(own) == F.col("th")), "left")
    # only texts that lose lines travel to Python
    done = joined.withColumn("cut", cut(F.when(F.col("spans").isNotNull(), own), "spans"))
    return done.select(F.col("row").withField(text, F.coalesce("cut.text", own)).alias("row"), F.col("cut.lines").alias("removed_lines"), F.col("cut.words").alias("removed_words"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with the cut texts, and n_chars set anew where there is such a column."""
    row = F.col("row")
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("removed_words") > 0, F.length("row.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType))
    return dedup(docs).select(row.alias("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("row.doc_id", "row.text", "removed_lines", "removed_words")
