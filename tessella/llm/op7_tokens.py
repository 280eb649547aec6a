"""Token ids in Re-Pair compressed shards.

Texts are dealt by doc_id ranges and sorted, so shards hold documents in ascending order. Each shard is
one binary image, made by Re-Pair: in every round pairs of symbols that are more frequent than the pairs
they overlap with become rules and are replaced from left to right, until no pair occurs PAYS times; a
rule costs about as much as two symbols and a length, so it pays from there on. No rule spans two
documents. The image has the ids in use, the rules, the expansion length of every rule and where each
document's symbols start, so one document or one position can be decoded alone. Images are written as
rows of a Parquet table by Spark's own committer: that works on every store Spark writes to, and a lost
task leaves no half file.

Image, all little-endian: b"RPR2"; u32 ids in use, rules, symbols, documents; u8 bits of a symbol, of a
length; u32[ids in use] ids; then packed to these bits, each part filled up to a byte: [rules, 2] pairs,
[rules] expansion lengths, [symbols]; u32[documents + 1] symbol starts; i64[documents] doc_ids;
u8[documents] null flags of the ids. Symbols below the number of ids in use stand for these ids.

Nulls and odd input: null and empty texts are the end id alone; a null doc_id sorts first and is given
back as null; rows of one doc_id come in the order of their texts' hashes, repeated rows one after the
other; an empty table gives no shard.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, documents, shared_dir
from .tokens import END_ID, default_path, encoder

MAGIC = b"RPR2"
SHARD_TOKENS = 1 << 19
PAYS = 4
#: Slots of the table in which a round counts pairs.
BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(pair: np.ndarray, seed: int) -> np.ndarray:
    return ((pair * (_MIX + np.uint64(2 * seed))) >> np.uint64(64 - BITS)).astype(np.int64)


def _chosen(seq: np.ndarray, free: np.ndarray, seed: int) -> np.ndarray:
    """Places whose pair occurs PAYS times and is nowhere less frequent than the pairs it overlaps with.

    Pairs are counted by hash; of those in one slot only the last counts in this round, by all in the slot.
    """
    pair = (seq[:-1] << np.uint64(32)) | seq[1:]
    slot = _slots(pair, seed)
    holder = np.empty(1 << BITS, np.uint64)
    holder[slot] = pair
    slot[~free | (holder[slot] != pair)] = 1 << BITS
    n = np.bincount(slot, minlength=(1 << BITS) + 1).astype(np.int32)
    n[n < PAYS] = 0
    n[-1] = 0
    score = n[slot]
    edge = np.r_[0, score, 0]
    hit = np.flatnonzero((score > 0) & (score >= edge[:-2]) & (score >= edge[2:]))
    if not len(hit):
        return hit
    # of overlapping places every second one of a run, from its left end
    start = np.r_[True, np.diff(hit) > 1]
    place = np.arange(len(hit))
    hit = hit[(place - np.maximum.accumulate(np.where(start, place, 0))) % 2 == 0]
    return hit[np.bincount(slot[hit], minlength=1 << BITS)[slot[hit]] >= PAYS]


def _last(seq: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Places of all pairs that occur PAYS times, counted exactly, the more frequent pairs first where they overlap."""
    pair = (seq[:-1] << np.uint64(32)) | seq[1:]
    slot = _slots(pair, 0)
    ordered = np.sort(pair[(np.bincount(slot, minlength=1 << BITS) >= PAYS)[slot]])  # no other pair can be common
    # a pair that occurs PAYS times equals the one PAYS - 1 places on
    common = ordered[: 1 - PAYS][ordered[: 1 - PAYS] == ordered[PAYS - 1 :]]
    common = common[np.r_[True, common[1:] != common[:-1]]] if len(common) else common
    marked = np.zeros(1 << BITS, bool)
    marked[_slots(common, 0)] = True
    at = np.flatnonzero(marked[slot] & free)
    pair = pair[at]
    order = np.argsort(pair, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0, True])
    n = np.diff(cuts)
    often = np.flatnonzero(n >= PAYS)
    taken: set[int] = set()
    out: list[int] = []
    for k in often[np.argsort(-n[often], kind="stable")].tolist():
        own: list[int] = []
        for i in at[order[cuts[k] : cuts[k + 1]]].tolist():
            if i not in taken and i + 1 not in taken and (not own or own[-1] + 1 < i):
                own.append(i)
        if len(own) >= PAYS:
            taken.update(own, (i + 1 for i in own))
            out += own
    return np.array(sorted(out), np.int64)


def compress(ids: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, rules (pairs of symbols), the expansion length of every rule, and the ids in use, for uint32 ids."""
    if int(ids.max(initial=0)) < 1 << 24:  # a look into a table in place of a sort
        there = np.bincount(ids, minlength=1) > 0
        used = np.flatnonzero(there)
        seq = (np.cumsum(there) - 1).astype(np.uint64)[ids]
    else:
        used, seq = np.unique(ids, return_inverse=True)
        seq = seq.astype(np.uint64)
    base = len(used)
    rules: list[np.ndarray] = []
    width = np.ones(base, np.int64)
    closes = used == end_id  # symbols whose last id ends a document: nothing may follow them in a pair
    seed, exact = 0, False
    while len(seq) > 1:
        free = ~closes[seq[:-1].astype(np.int64)]
        hit = _last(seq, free) if exact else _chosen(seq, free, seed)
        seed += 1
        if len(hit) < 4000 and not exact:
            exact = True  # few are left: without clashes of hashes
            continue
        if not len(hit):
            break
        pair = (seq[hit] << np.uint64(32)) | seq[hit + 1]
        new, symbol = np.unique(pair, return_inverse=True)
        rules.append(np.stack([new >> np.uint64(32), new & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64))
        seq[hit] = (symbol + len(width)).astype(np.uint64)
        width = np.r_[width, width[rules[-1]].sum(axis=1)]
        closes = np.r_[closes, closes[rules[-1][:, 1]]]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
    pairs = np.concatenate(rules) if rules else np.empty((0, 2), np.int64)
    return seq.astype(np.int64), pairs, width[base:], used.astype("<u4")


def packed_bits(values: np.ndarray, bits: int) -> bytes:
    """Values below 2**bits, the lowest bit first."""
    out = np.empty((len(values), bits), np.uint8)
    for k in range(bits):
        out[:, k] = (values >> k) & 1
    return np.packbits(out.ravel(), bitorder="little").tobytes()


def unpacked_bits(raw: bytes, at: int, n: int, bits: int) -> tuple[np.ndarray, int]:
    """n values from the place `at` on, and the place after them."""
    size = -(-n * bits // 8)
    own = np.r_[np.frombuffer(raw, np.uint8, size, at), np.zeros(8, np.uint8)]
    first = np.arange(n) * bits
    byte, shift = first >> 3, first & 7
    out = np.zeros(n, np.int64)
    for k in range((bits + 14) // 8):
        out |= own[byte + k].astype(np.int64) << (8 * k)
    return (out >> shift) & ((1 << bits) - 1), at + size


def image(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None]) -> bytes:
    """A shard of documents with these ids in turn; every document ends with the end id."""
    seq, pairs, size, used = compress(ids)
    width = np.r_[np.ones(len(used), np.int64), size]
    starts = np.searchsorted(np.r_[0, np.cumsum(width[seq])], np.r_[0, np.cumsum(lengths)])
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], "u1")
    bits, long = int(len(width)).bit_length(), int(size.max(initial=1)).bit_length()
    head = struct.pack("<4s4I2B", MAGIC, len(used), len(pairs), len(seq), len(doc_ids), bits, long)
    return b"".join([head, used.tobytes(), packed_bits(pairs.ravel(), bits), packed_bits(size, long), packed_bits(seq, bits), starts.astype("<u4").tobytes(), known.tobytes(), null.tobytes()])


class Shard:
    """Reads an image; documents and positions are decoded on demand."""

    def __init__(self, raw: bytes):
        magic, self.base, rules, symbols, docs, bits, long = struct.unpack_from("<4s4I2B", raw)
        if magic != MAGIC:
            raise ValueError("not a shard image")
        self.used = np.frombuffer(raw, "<u4", self.base, 22)
        pairs, at = unpacked_bits(raw, 22 + 4 * self.base, 2 * rules, bits)
        self.pairs = pairs.reshape(-1, 2)
        self.size, at = unpacked_bits(raw, at, rules, long)
        self.seq, at = unpacked_bits(raw, at, symbols, bits)
        self.starts = np.frombuffer(raw, "<u4", docs + 1, at)
        ids = np.frombuffer(raw, "<i8", docs, at + 4 * (docs + 1))
        null = np.frombuffer(raw, "u1", docs, at + 4 * (docs + 1) + 8 * docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(ids, null)]

    def _spelled(self, seq: np.ndarray) -> np.ndarray:
        """The ids of symbols: every pass puts the two symbols of a rule in its place."""
        rule = seq >= self.base
        while rule.any():
            width = 1 + rule
            at = np.cumsum(width) - width
            out = np.repeat(seq, width)
            pair = self.pairs[seq[rule] - self.base]
            out[at[rule]], out[at[rule] + 1] = pair[:, 0], pair[:, 1]
            seq = out
            rule = seq >= self.base
        return self.used[seq] if len(seq) else np.empty(0, "<u4")

    def all_documents(self) -> list[np.ndarray]:
        """The ids of every document; each symbol is spelled once."""
        width = np.r_[np.ones(self.base, np.int64), self.size]
        spelled = self._spelled(np.arange(len(width)))
        first = np.cumsum(width) - width
        n = width[self.seq]
        end = np.cumsum(n)
        ids = spelled[np.repeat(first[self.seq] - end + n, n) + np.arange(int(end[-1]) if len(end) else 0)]
        return np.split(ids, np.r_[0, end][self.starts][1:-1])

    def document(self, i: int) -> np.ndarray:
        return self._spelled(self.seq[self.starts[i] : self.starts[i + 1]])

    def token(self, i: int, position: int) -> int:
        """One id of a document, found by expansion lengths without decoding what is before it."""
        seq = self.seq[self.starts[i] : self.starts[i + 1]].astype(np.int64)
        width = np.ones(len(seq), np.int64)
        rule = seq >= self.base
        width[rule] = self.size[seq[rule] - self.base]
        ends = np.cumsum(width)
        k = int(np.searchsorted(ends, position, "right"))
        symbol, position = int(seq[k]), position - int(ends[k] - width[k])
        while symbol >= self.base:
            a, b = self.pairs[symbol - self.base].tolist()
            left = int(self.size[a - self.base]) if a >= self.base else 1
            symbol, position = (a, position) if position < left else (b, position - left)
        return int(self.used[symbol])


SHARDS = "part int, shard int, before long, n_tokens long, image binary"


def shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shard images of docs in ascending doc_id order; `before` counts the ids of a part's earlier shards."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("image", pa.binary())])
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard, before = encoder(path), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def full() -> pa.RecordBatch:
            nonlocal shard, before, held, size
            ids = np.frombuffer(b"".join(b for _, b in held), "<u4")
            out = batch(schema, [[part], [shard], [before], [len(ids)], [image(ids, np.array([len(b) // 4 for _, b in held]), [d for d, _ in held])]])
            shard, before, held, size = shard + 1, before + len(ids), [], 0
            return out

        for rb in batches:
            names = rb.column(0).to_pylist()
            for lo, own in encode.chunks(rb.column(1)):
                for d, b in zip(names[lo : lo + len(own)], own):
                    held.append((d, b + end))
                    size += len(b) // 4 + 1
                    if size >= SHARD_TOKENS:
                        yield full()
        if held:
            yield full()

    # with the hash, rows of one id (or without one) are dealt over parts too
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    order = [F.asc_nulls_first("doc_id"), F.asc("h")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(run, SHARDS)


def write_tokens(docs: DataFrame, folder: str, path: str) -> None:
    shards(docs, path).write.option("compression", "zstd").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document in the shards: doc_id, start, n_tokens, ids_crc32.

    The driver holds one number for each part, of which there are as many as tasks wrote.
    """
    table = spark.read.schema(SHARDS).parquet(folder)
    sizes = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    offsets, total = {}, 0
    for part, n in sizes:
        offsets[part], total = total, total + n
    shared = spark.sparkContext.broadcast(offsets)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = shared.value
        for rb in batches:
            for part, before, raw in zip(*(rb.column(i).to_pylist() for i in range(3))):
                s = Shard(raw)
                own = s.all_documents()
                n = np.array([len(x) for x in own], np.int64)
                start = offsets[part] + before + np.cumsum(n) - n
                yield batch(schema, [s.doc_ids, start, n, [zlib.crc32(x.tobytes()) for x in own]])

    return table.select("part", "before", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    folder = f"{shared_dir(spark)}/tokens/{uuid.uuid4().hex}"
    write_tokens(documents(spark, sf_dir), folder, default_path())
    return read_tokens(spark, folder)
