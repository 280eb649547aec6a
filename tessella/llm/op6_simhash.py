"""SimHash near-duplicates by BK-tree search in shards.

Fingerprints that differ in at most RADIUS bits agree wholly on some of the blocks that the 64 bits are
cut into: of `RADIUS + c` blocks on at least c. Every choice of c blocks is a table, and the distinct
fingerprints with the same values there form a shard. c grows with the number of fingerprints, so that
a shard stays small: it is a function of the count, and the links found are all links whatever c is.
Every shard gets a BK-tree (children keyed by integer Hamming distance to the parent, only edges within
the radius followed). A fingerprint leaves the tree when it is found, so a shard of n near copies gives
about n - 1 links and not all pairs. Links join into components by alternating large-star and small-star
rounds on Spark.

Shards of at most HOT fingerprints travel by shuffle. A larger one is cut into pieces of about PIECE, each
with its tree: trees of WAVE fingerprints in all are broadcast at a time, and all fingerprints of later
pieces of the same shards are sent through them on all executors. Broadcasting the trees of all shards
would pass every fingerprint through the driver, whose memory has no part in this otherwise.

Nulls and odd input: a null or empty text has no words and fingerprint zero, linked like any other. A
null doc_id is a document whose id sorts last and is returned null; a component of only null ids has a
null component_id. Repeated rows share fingerprint and component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import stars as components
from .common import batch, documents, free_names, slices, written

RADIUS = 4
SHINGLE = 4
SEED = 42
#: A larger shard is cut into pieces of about PIECE; WAVE fingerprints (8 MB, as trees 32 MB) are broadcast at once.
HOT = 1 << 18
PIECE = 1 << 16
WAVE = 1 << 20
#: A task searches shards of this many fingerprints together, or one larger shard.
TOGETHER = 1 << 16
#: Trees are asked by so many values at once, and a shard begins at so many places at once.
ASKED = 1024
SEEDS = 256
#: Shards should hold about this many fingerprints on average.
SHARD_SIZE = 512


def fingerprint(text: bytes | None) -> int:
    """The contract's SimHash of a text in UTF-8."""
    words = text.lower().split() if text else []  # bytes.lower() is A-Z alone, bytes.split() ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, np.int64)
    a, b = start[:n].tolist(), end[SHINGLE - 1 :].tolist()
    for lo in range(0, n, 1 << 16):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)])], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


class Forest:
    """The BK-trees of many shards in flat arrays.

    Nodes are numbered level by level: node s is the root of shard s, and the others follow in the order
    of `code`, their parent's number times 65 plus their distance to it, so a node's children within a
    range of distances are neighbours.
    """

    def __init__(self, values: np.ndarray, shard: np.ndarray):
        """Distinct uint64 values in each shard; shards are numbered from 0 without gaps."""
        group, member = shard.astype(np.int64), np.arange(len(values))
        made, nodes, codes = 0, [], []
        while len(member):
            order = np.argsort(group, kind="stable")
            group, member = group[order], member[order]
            first = np.r_[True, group[1:] != group[:-1]]
            nodes.append(member[first])
            codes.append(group[first])
            parent = made + np.cumsum(first)[~first] - 1
            made += len(nodes[-1])
            group_head = member[first][np.cumsum(first)[~first] - 1]
            member = member[~first]
            group = parent * 65 + np.bitwise_count(values[member] ^ values[group_head])
        self.member = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
        self.roots = len(nodes[0]) if nodes else 0
        self.code = np.concatenate(codes[1:]) if len(codes) > 1 else np.empty(0, np.int64)
        self.value, self.shard = values[self.member], shard[self.member]

    def ask(self, values: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(place among the values asked, node) of all nodes within the radius in the value's shard."""
        who, node = np.arange(len(values)), shard.astype(np.int64)
        asked, found = [who[:0]], [node[:0]]
        while len(who):
            d = np.bitwise_count(self.value[node] ^ values[who]).astype(np.int64)
            hit = d <= radius
            asked.append(who[hit])
            found.append(node[hit])
            lo = np.searchsorted(self.code, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.code, node * 65 + np.minimum(d + radius, 64), "right") - lo
            end = np.cumsum(n)
            who = np.repeat(who, n)
            node = self.roots + np.repeat(lo - end + n, n) + np.arange(len(who))
        return np.concatenate(asked), np.concatenate(found)


def _united(home: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """home after the homes a and b are one, pair by pair."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while x in root:
            x = root[x]
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    table = np.arange(len(home))
    for x in root:
        table[x] = find(x)
    return table[home]


def shard_links(values: np.ndarray, shard: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Pairs of places (a, b) that join all values which links join within a shard: hardly more than a spanning forest.

    Every shard is walked from its first value; what is found has that value's home. An asked value sees
    the values that are not asked yet and have another home. A shard ends when all that is left has one
    home, and where fewer values wait than are found but not asked, those are asked instead.
    """
    forest = Forest(values, shard)
    n, shards = len(values), forest.roots
    unasked, waiting, home = np.ones(n, bool), np.ones(n, bool), np.arange(n)
    width = np.ones(shards, np.int64)
    by_shard = np.argsort(forest.shard, kind="stable")
    out = [np.empty((0, 2), np.int64)]
    while True:
        left = by_shard[unasked[by_shard]]
        own, waits = forest.shard[left], waiting[left]
        waiters = np.bincount(own[waits], minlength=shards)
        queued = np.bincount(own[~waits], minlength=shards)
        low, high = np.full(shards, n), np.full(shards, -1)
        np.minimum.at(low, own, home[left])
        np.maximum.at(high, own, home[left])
        open_ = low < high
        seeding = (waiters > 0) & ((queued == 0) | (waiters <= queued))
        rank = np.cumsum(waits) - 1
        first = np.full(shards, len(left) + 1)
        np.minimum.at(first, own[waits], rank[waits])
        ask = left[open_[own] & np.where(seeding[own], waits & (rank - first[own] < width[own]), ~waits)]
        if not len(ask):
            return np.concatenate(out)
        seeds = forest.shard[ask[waiting[ask]]]
        width[seeds] = np.minimum(2 * width[seeds], SEEDS)
        for lo in range(0, len(ask), ASKED):
            some = ask[lo : lo + ASKED]
            a, b = forest.ask(forest.value[some], forest.shard[some], radius)
            a = some[a]
            seen = unasked[b] & (home[a] != home[b])
            a, b = a[seen], b[seen]
            # one link is enough between two homes, and between a home and a waiting value, which is its own home
            _, once = np.unique(home[a] * n + home[b], return_index=True)
            a, b = a[once], b[once]
            out.append(np.stack([forest.member[a], forest.member[b]], axis=1))
            width[forest.shard[a]] = 1
            waiting[b] = waiting[some] = unasked[some] = False
            home = _united(home, home[a], home[b])


def block_choices(n: int, radius: int = RADIUS, shard: int = SHARD_SIZE) -> list[int]:
    """Bit masks of the tables for n fingerprints: all choices of c of radius + c blocks, c as n asks."""
    for c in range(1, 5):
        cuts = [round(64 * i / (radius + c)) for i in range(radius + c + 1)]
        if c == 4 or n / 2 ** (64 * c / (radius + c)) <= shard:
            break
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(masks, c)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links_in_shards(radius: int):
    """A function for mapInArrow on (fp, t, key, piece), sorted by the last three: the links of every shard or piece."""

    def found(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values = np.concatenate([v for v, _ in parts])
        shard = np.concatenate([s for _, s in parts])
        at = shard_links(values.view(np.uint64), np.unique(shard, return_inverse=True)[1], radius)
        if len(at):
            yield batch(LINKS, [values[at[:, 0]], values[at[:, 1]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, number, last = [], 0, 0, None
        for rb in batches:
            if not rb.num_rows:
                continue
            fp, *where = (rb.column(i).to_numpy().astype(np.int64) for i in range(4))
            where = np.stack(where, axis=1)
            new = np.r_[last is None or bool((where[0] != last).any()), (where[1:] != where[:-1]).any(axis=1)]
            shard = number + np.cumsum(new)
            number, last = int(shard[-1]), where[-1]
            cuts = np.flatnonzero(new)
            lo = 0
            for cut in [*cuts.tolist(), rb.num_rows]:
                # a shard begins: what is held is whole
                if size + cut - lo > TOGETHER and cut < rb.num_rows:
                    parts.append((fp[lo:cut], shard[lo:cut]))
                    yield from found(parts)
                    parts, size, lo = [], 0, cut
            parts.append((fp[lo:], shard[lo:]))
            size += rb.num_rows - lo
        if size:
            yield from found(parts)

    return run


def _links_between_pieces(pieces: DataFrame, radius: int, wave: int) -> list[DataFrame]:
    """Links between pieces (fp, t, key, piece) of the same shard: trees of `wave` fingerprints or one piece are broadcast at a time."""
    spark = pieces.sparkSession
    sizes = sorted((r.t, r.key, r.piece, r.n) for r in pieces.groupBy("t", "key", "piece").agg(F.count("*").alias("n")).collect())
    waves: list[list[tuple]] = []
    held = wave
    for *where, n in sizes:
        if held + n > wave:
            waves.append([])
            held = 0
        waves[-1].append(tuple(where))
        held += n
    out = []
    for own in waves:
        some = spark.createDataFrame(own, "t int, key long, piece int")
        got = pieces.join(F.broadcast(some), ["t", "key", "piece"]).select("fp", "t", "key", "piece").toArrow()
        values, *where = (got[c].to_numpy().astype(np.int64) for c in ("fp", "t", "key", "piece"))
        which = {w: k for k, w in enumerate(own)}
        shard = np.array([which[w] for w in zip(*(c.tolist() for c in where))], np.int64)
        if not len(values):
            continue
        forest = Forest(values.view(np.uint64), shard)
        label = np.arange(len(values))
        at = shard_links(values.view(np.uint64), shard, radius)
        label = _united(label, at[:, 0], at[:, 1])[forest.member]
        shared = spark.sparkContext.broadcast((forest, label, own))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            forest, label, own = shared.value
            for rb in batches:
                fp, t, key, piece = (rb.column(i).to_numpy().astype(np.int64) for i in range(4))
                for k, (t0, key0, piece0) in enumerate(own):
                    later = fp[(t == t0) & (key == key0) & (piece > piece0)]
                    for lo in range(0, len(later), ASKED):
                        part = later[lo : lo + ASKED]
                        a, b = forest.ask(part.view(np.uint64), np.full(len(part), k), radius)
                        # one link is enough between a fingerprint and those of a piece that are linked already
                        _, once = np.unique(a * len(label) + label[b], return_index=True)
                        yield batch(LINKS, [part[a[once]], forest.value[b[once]].view(np.int64)])

        asked = pieces.join(F.broadcast(some.select("t", "key").distinct()), ["t", "key"]).select("fp", "t", "key", "piece")
        out.append(written(asked.mapInArrow(run, "a long, b long"), "piece-links"))
        shared.unpersist()
    return out


def links(prints: DataFrame, radius: int = RADIUS, hot: int = HOT, piece: int = PIECE, wave: int = WAVE) -> DataFrame:
    """Links (a, b) between the distinct values of the bigint column `fp` that connect all that are within the radius."""
    n = prints.count()
    masks = [_signed(m) for m in block_choices(n, radius)]
    keyed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    # at most len(masks) * n / hot of them
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).collect() if n > hot else []
    others = []
    if large:
        cuts = F.broadcast(prints.sparkSession.createDataFrame([(r.t, r.key, -(-r.n // piece)) for r in large], "t int, key long, cuts long"))
        pieces = written(keyed.join(cuts, ["t", "key"]).select("fp", "t", "key", F.pmod(F.xxhash64("fp"), "cuts").cast("int").alias("piece")), "pieces")
        others = _links_between_pieces(pieces, radius, wave)
        keyed = keyed.join(cuts, ["t", "key"], "left_anti").select("fp", "t", "key", F.lit(0).alias("piece")).union(pieces)
    else:
        keyed = keyed.withColumn("piece", F.lit(0))
    where = ["t", "key", "piece"]
    found = keyed.repartition(*where).sortWithinPartitions(*where, "fp").mapInArrow(_links_in_shards(radius), "a long, b long")
    for other in others:
        found = found.union(other)
    return found.distinct()


def fingerprints(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns in keep and a last column, the bigint fingerprint `fp` (its name lengthened where taken)."""
    (name,) = free_names(keep, "fp")
    rows = docs.select(F.col(text).cast("binary").alias(free_names(keep, "utf8")[0]), *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in slices(batches):
            fp = np.fromiter((fingerprint(t) for t in rb.column(0).to_pylist()), np.uint64, rb.num_rows)
            yield pa.RecordBatch.from_arrays([*rb.columns[1:], pa.array(fp.view(np.int64))], names=[*rb.schema.names[1:], name])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[1:], T.StructField(name, T.LongType())]))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """doc_id, fp (bigint) and component_id of every document."""
    prints = written(fingerprints(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"]), "prints")
    return prints.join(classes(prints, radius), "fp").select("doc_id", "fp", "component_id")


def classes(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of the table prints (doc_id, fp)."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = components(links(distinct.select("fp"), radius))
    labelled = distinct.join(found.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return written(labelled.join(roots, "root").select("fp", "root", "component_id"), "classes")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id, a null id last.

    Of rows with that doc_id in the component the first in (fingerprint, text hash) order stays, once.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text")
    prints = written(fingerprints(rows, "text", ["doc_id", "digest"]), "prints")
    # components go by root: a component_id is shared by all of only null ids, and by texts under one id
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "digest")
    best = prints.join(classes(prints), "fp").groupBy("root").agg(F.min(order).alias("best")).select("best.doc_id", "best.digest")
    # nearly all documents match, so texts move once, by id and text
    (digest, rank) = free_names(docs.columns, "digest", "rank")
    named = docs.withColumn(digest, F.xxhash64("text"))
    kept = named.join(best, named["doc_id"].eqNullSafe(best["doc_id"]) & (named[digest] == best["digest"]), "left_semi")
    return kept.withColumn(rank, F.row_number().over(W.partitionBy("doc_id", digest).orderBy("text"))).where(F.col(rank) == 1).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
