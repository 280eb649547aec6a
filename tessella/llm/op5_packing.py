"""Best-fit packing by a configuration linear program.

Documents become pieces of at most CAPACITY tokens. The histogram of piece lengths, at most CAPACITY
rows whatever the input, goes to the driver. There the configuration program (how often to use which
multiset of lengths) is solved by multiplicative weights: lengths whose demand is little covered weigh
more. A round deals the lengths at random into parts of about PART, a bounded-knapsack dynamic program
finds each part's configuration of greatest weight, and a configuration that fills a sequence is used as
often, in whole sequences, as the demand left allows. Rounds go on until TOLERANCE of the tokens is left,
or until rounds find next to nothing that fills a sequence. What is left is packed best-fit decreasing,
length by length over groups of equal bins.

Pieces then take their places on Spark: the places of a length are numbered, and a piece's number among
those of its length comes from counts in 1024 hash buckets, so that no window holds a whole length.

Nulls and odd input: a null text is an empty one, of the end id alone; null doc_ids are packed like
others; repeated rows are packed once for each row; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, documents, slices, written
from .tokens import END_ID, default_path, encoder

CAPACITY = 4096
BUCKETS = 1024
PART = 32
RATE = 0.2
TOLERANCE = 0.01
#: So many rounds in a row that deal under 1/2000 of the tokens end the program.
IDLE = 3
#: A group of equal sequences: ((length, how many of it) from the longest on), how many such sequences.
Group = tuple[tuple[tuple[int, int], ...], int]


def best_configuration(lengths: list[int], weight: list[float], most: list[int], capacity: int = CAPACITY) -> Counter:
    """The multiset of lengths of greatest total weight that fits, each used `most` times at most: bounded knapsack."""
    items = []
    for i, n in enumerate(most):
        k = 1
        while n > 0:
            items.append((i, min(k, n)))
            n, k = n - k, 2 * k
    best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for j, (i, k) in enumerate(items):
        x = lengths[i] * k
        if x <= capacity:
            value = best[: capacity + 1 - x] + weight[i] * k
            np.greater(value, best[x:], out=took[j, x:])
            best[x:] = np.maximum(best[x:], value)
    out, c = Counter(), capacity
    for j in range(len(items) - 1, -1, -1):
        if took[j, c]:
            i, k = items[j]
            out[lengths[i]] += k
            c -= lengths[i] * k
    return out


def configuration_program(demand: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[Counter, int]], dict[int, int]]:
    """Whole uses of configurations, and the demand that they leave: TOLERANCE of the tokens, or what fills no sequence."""
    rng = np.random.default_rng(len(demand))
    left = {x: n for x, n in demand.items() if n}
    total = rest = sum(x * n for x, n in left.items())
    uses: Counter[tuple] = Counter()
    idle = 0
    while rest > TOLERANCE * total and idle < IDLE:
        before = rest
        lengths = np.array(sorted(left))
        parts = max(1, len(lengths) // PART)
        dealt = rng.permutation(len(lengths)) % parts
        for p in range(parts):
            own = lengths[dealt == p].tolist()
            weight = [x * float(np.exp(RATE * left[x] / demand[x])) for x in own]
            chosen = best_configuration(own, weight, [min(left[x], capacity // x) for x in own], capacity)
            filled = sum(x * k for x, k in chosen.items())
            if filled < capacity - capacity // 512:
                continue
            n = min(left[x] // k for x, k in chosen.items())
            uses[tuple(sorted(chosen.items(), reverse=True))] += n
            rest -= n * filled
            for x, k in chosen.items():
                left[x] -= n * k
                if not left[x]:
                    del left[x]
        idle = idle + 1 if before - rest < total / 2000 else 0
    return [(Counter(dict(c)), n) for c, n in uses.items()], left


def best_fit(demand: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Best-fit decreasing over the histogram; equal bins are one group, so the cost doesn't follow the counts."""
    rooms: list[int] = []
    groups: dict[int, list[list]] = defaultdict(list)  # room -> [configuration, how many]

    def put(room: int, config: tuple, n: int) -> None:
        if room not in groups or not groups[room]:
            insort(rooms, room)
        groups[room].append([config, n])

    for x in sorted(demand, reverse=True):
        left = demand[x]
        while left:
            i = bisect_left(rooms, x)
            if i == len(rooms):
                each = capacity // x
                if left >= each:
                    put(capacity - each * x, ((x, each),), left // each)
                if left % each:
                    put(capacity - left % each * x, ((x, left % each),), 1)
                break
            room = rooms[i]
            config, n = groups[room].pop()
            if not groups[room]:
                rooms.pop(i)
            each = min(room // x, left)
            used = min(n, left // each)
            if used < n:
                put(room, config, n - used)
            put(room - each * x, (*config, (x, each)), used)
            left -= used * each
    return [(c, n) for some in groups.values() for c, n in some if n]


def pack_histogram(demand: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """Groups of sequences that hold the demand exactly: the configuration program's, or those of best fit alone where they are fewer.

    Where most lengths occur once the program has nothing to repeat, and what it leaves is harder to pack than the whole.
    """
    out: list[Group] = []
    rest = {x: n for x, n in demand.items() if n and x < capacity}
    if demand.get(capacity):
        out.append((((capacity, 1),), demand[capacity]))
    if not rest:
        return out
    chosen, left = configuration_program(rest, capacity)
    program = [(tuple(sorted(c.items(), reverse=True)), n) for c, n in chosen] + best_fit(left, capacity)
    return out + min(program, best_fit(rest, capacity), key=lambda groups: sum(n for _, n in groups))


def places(groups: list[Group]) -> dict[str, np.ndarray]:
    """One row for each group and length, sorted by length and the number of its first place."""
    rows, numbered, base = [], Counter(), 0
    for config, n in groups:
        offset = 0
        for x, k in config:
            rows.append((x, numbered[x], k, base, offset))
            numbered[x] += n * k
            offset += x * k
        base += n
    got = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "each", "base", "offset"), got.T))


def pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; with_ids adds `ids`.

    ids are little-endian unsigned integers of 16 bits, of 32 if the tokenizer has ids above 65,535.
    """
    kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(kinds + ([("ids", pa.binary())] if with_ids else []))
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        kind = "<u2" if len(encode.ends) <= 1 << 16 else "<u4"
        for rb in slices(batches):
            names = rb.column(0).to_pylist()
            for lo, part in encode.chunks(rb.column(1)):
                rows = []
                for d, b in zip(names[lo : lo + len(part)], part):
                    b += end
                    for k, at in enumerate(range(0, len(b), 4 * CAPACITY)):
                        own = b[at : at + 4 * CAPACITY]
                        rows.append((d, k, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(kind).tobytes()] if with_ids else [])))
                yield batch(schema, list(zip(*rows)))

    sql = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, sql)


def pack(cut: DataFrame) -> DataFrame:
    """The pieces with sequence_id and offset; cut is read more than once and should be a written table."""
    spark = cut.sparkSession
    demand = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast(places(pack_histogram(demand)))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    counts = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    upto = W.partitionBy("length").orderBy("bucket")
    before = counts.select("length", "bucket", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    own = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = keyed.withColumn("own", F.row_number().over(own)).join(before, ["length", "bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        t = shared.value
        # places are sorted by (length, first): the group of a piece is the last that doesn't start after it
        key = t["length"] * (1 << 48) + t["first"]
        at = np.searchsorted(key, length.to_numpy() * (1 << 48) + number.to_numpy(), "right") - 1
        inside = number.to_numpy() - t["first"][at]
        return pd.DataFrame({"sequence_id": t["base"][at] + inside // t["each"][at], "offset": t["offset"][at] + inside % t["each"][at] * length.to_numpy()})

    done = numbered.withColumn("at", placed("length", F.col("before") + F.col("own") - 1))
    return done.select(*cut.columns, "at.sequence_id", "at.offset")


def packed(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of docs with its place; with_ids adds the token ids, ready to be laid out: see pieces()."""
    return pack(written(pieces(docs, path or default_path(), with_ids=with_ids), "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))
