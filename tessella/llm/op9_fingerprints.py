"""MinHash fingerprints.

A text is a set of shingles of SHINGLE words, hashed to 64 bits; PERMUTATIONS universal hash functions
h -> (a h + b) mod 2**64 >> 48 permute the set, and the least value of each makes the signature. The share
of equal values estimates the Jaccard likeness of two texts.

A document's edited text needs the beginning of the next document. Where ids are unique and the next row of
a task has the next integer id, both are at hand; all other documents, and all rows that begin such a
stretch, are put in order by shuffle. Tables that are stored in order so move hardly any text.

classes() cuts signatures into BANDS bands and joins documents on a band's value in Spark. The members of a
band's group meet its first REPRESENTATIVES; of pairs whose signatures are alike at all (NEAR) the Jaccard likeness of
shingles is verified, and links make components. A group that is one component, as copies are, or all of whose members
have met, is done. The others are dealt over blocks of BLOCK members, two of which meet in a tile that one task holds:
there all pairs between components are compared and verified, and as many links are kept as join them. Nodes are distinct shingle sets, so exact copies cost nothing. A pair at likeness 0.8 shares a band with a
chance of 0.9977 and estimates below NEAR with one of 0.01. The tests measure what is missed.

Nulls and odd input: a null text is an empty one; a text of fewer words than a shingle has one shingle
of all its words; without words the signature is all ones, and like itself. Rows with a null doc_id
come first; a class of only null ids has a null class_id. Of rows with one doc_id the next document is the
next row in the order of the texts' hashes. An empty table gives an empty result, and a single document is
its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import stars

from .common import batch, documents, likely, slices, written

SHINGLE = 5
PERMUTATIONS = 128
BANDS = 20
#: Values of the signature in a band; 8 of the 128 are in none.
ROWS = 6
LIKENESS = 0.8
#: Representatives that a group's members meet first; least likeness of signatures of a pair that is verified.
REPRESENTATIVES = 2
NEAR = 0.72
SEED = 9
#: Members of a block, and bytes of their shingles, in groups that are not one component.
BLOCK = 1024
BLOCK_BYTES = 16 << 20
#: Members of a band that one task numbers, and the most bands that are dealt over several.
HOT = 4096
MOST_HOT = 100_000
#: Rows that a part of the doc_id order holds, and the most parts there are.
PART_ROWS = 4000
MAX_PARTS = 20_000
CACHE_WORDS = 150_000
_random = np.random.default_rng(SEED)
_A = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _random.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_WEIGHTS = _random.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Word -> 64-bit hash; emptied when full, as hashes can be made again."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return h


_words = _Words()


def shingles(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a text."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _WEIGHTS[i]
    out ^= out >> np.uint64(29)
    return np.unique(out * np.uint64(0xBF58476D1CE4E5B9))


def signature(hashes: np.ndarray) -> np.ndarray:
    out = np.full(PERMUTATIONS, 0xFFFF, np.uint16)
    for lo in range(0, len(hashes), 512):
        some = hashes[lo : lo + 512]
        got = (_A[:, None] * some[None, :] + _B[:, None]).min(axis=1) >> np.uint64(48)
        np.minimum(out, got.astype(np.uint16), out=out)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last floor(n/4) code points replaced by the first as many of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _digest(doc: tuple, following: tuple) -> tuple:
    """The row of a document (doc_id, text, shingles, signature), which the following one's text ends."""
    doc_id, text, hashes, sig = doc
    new = edited(text, following[1]).encode()
    other = signature(shingles(new.decode()))
    node = xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)
    return doc_id, len(text), hashlib.sha256(new).digest(), sig.astype(">u2").tobytes(), other.astype(">u2").tobytes(), likeness(sig, other), likeness(sig, following[3]), node


DIGEST = "doc_id long, n_chars long, edited binary, sig binary, edited_sig binary, near_edited double, near_next double, node long"
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.binary()) for c in ("edited", "sig", "edited_sig")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("node", pa.int64())])
LOOSE = ", text string, open boolean"
_LOOSE = _DIGEST.append(pa.field("text", pa.string())).append(pa.field("open", pa.bool_()))


def _seen(doc_id: int | None, text: str) -> tuple:
    hashes = shingles(text)
    return doc_id, text, hashes, signature(hashes)


def _in_place(unique: bool):
    """A function for mapInArrow on (doc_id, text): digests of documents whose next one follows them, and the loose
    rows: open ones, whose next is elsewhere, and others that may be the next of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        before, led = None, False  # led: the row before has given its text to the one before it

        def loose(doc: tuple, is_open: bool) -> tuple:
            return (doc[0], *[None] * 7, doc[1], is_open)

        for rb in slices(batches):
            for doc_id, text in zip(*(c.to_pylist() for c in rb.columns)):
                now = _seen(doc_id, text) if unique else (doc_id, text)
                follows = unique and before is not None and doc_id is not None and before[0] is not None and doc_id == before[0] + 1
                if follows:
                    rows.append((*_digest(before, now), None, None))
                if before is not None and (not follows or not led):
                    rows.append(loose(before, not follows))
                before, led = now, follows
                if len(rows) >= 512:
                    yield batch(_LOOSE, list(zip(*rows)))
                    rows = []
        if before is not None:
            rows.append(loose(before, True))
        if rows:
            yield batch(_LOOSE, list(zip(*rows)))

    return run


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows (part, tail, doc_id, h, text, open) in parts of consecutive doc_ids, from rows (doc_id, text, open).

    Parts of null ids come first and are ranges of the text's hash h. A part begins with the key of a row, so its last row is followed by the first of the
    next part: that one is given to both, as a tail in the earlier. The driver holds one id or hash for each part.
    """
    known = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("null")).collect()[0]
    parts = max(1, min(MAX_PARTS, known.n // PART_ROWS))
    starts = rows.where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10 * MAX_PARTS)).collect()[0][0] if parts > 1 else []
    begins = np.array(sorted({int(s) for s in starts or []} | ({known.least} if known.least is not None else set())), np.int64)
    ranges = max(1, min(MAX_PARTS, known.null // PART_ROWS))
    hashed = rows.where("doc_id is null").select(F.xxhash64("text").alias("h"))
    least = hashed.groupBy(F.floor((F.col("h") / 2.0**64 + 0.5) * ranges).alias("k")).agg(F.min("h").alias("h")).collect() if known.null else []
    nulls = np.array(sorted(r.h for r in least), np.int64)
    last = max(0, len(nulls) + len(begins) - 1)

    @F.pandas_udf("array<struct<part:int,tail:boolean>>")
    def placed(doc_id: pd.Series, h: pd.Series) -> pd.Series:
        null = doc_id.isna().to_numpy()
        key = np.where(null, h.to_numpy(np.int64), doc_id.fillna(0).astype("int64").to_numpy())
        part, first = np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        for own, firsts, before in ((null, nulls, 0), (~null, begins, len(nulls))):
            at = np.searchsorted(firsts, key[own], "right") - 1
            part[own], first[own] = before + at, firsts[at] == key[own] if len(firsts) else False
        # the first document of all follows the last
        return pd.Series([[(p, False), (p - 1 if p else last, True)] if f else [(p, False)] for p, f in zip(part.tolist(), first.tolist())])

    placing = rows.select("doc_id", F.xxhash64("text").alias("h"), "text", "open", F.explode(placed("doc_id", F.xxhash64("text"))).alias("at")).select("at.part", "at.tail", "doc_id", "h", "text", "open")
    return placing.repartition("part").sortWithinPartitions("part", "tail", F.asc_nulls_first("doc_id"), "h", "text")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    before, tailed = None, None  # before: the row whose next is still to come
    for rb in slices(batches):
        for part, tail, doc_id, _, text, is_open in zip(*(c.to_pylist() for c in rb.columns)):
            if tail and part == tailed:
                continue  # of repeated rows that begin the next part the first comes next
            now = (*_seen(doc_id, text), is_open)
            if before is not None and before[4]:
                rows.append(_digest(before[:4], now))
            before, tailed = (None, part) if tail else (now, tailed)
            if len(rows) >= 512:
                yield batch(_DIGEST, list(zip(*rows)))
                rows = []
    if rows:
        yield batch(_DIGEST, list(zip(*rows)))


def digests(docs: DataFrame) -> DataFrame:
    """DIGEST of every document: its own and its edited text's, which ends as the next document begins."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id").where("doc_id is not null").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("k")).collect()[0]
    found = written(rows.mapInArrow(_in_place(ids.n == ids.k), DIGEST + LOOSE), "in-place")
    names = [f.name for f in _DIGEST]
    rest = written(_ordered(found.where("open is not null").select("doc_id", "text", "open")).mapInArrow(_in_order, DIGEST), "in-order")
    return found.where("open is null").select(*names).union(rest)


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's columns and class_id, the smallest doc_id that verified links join a document to."""
    found = digests(docs)
    joined = written(classes(docs, found.select("doc_id", "node", "sig")), "classes")
    text = lambda c: F.lower(F.hex(c))
    out = ["doc_id", "n_chars", text("edited").alias("edited_sha256"), text("sig").alias("fingerprint"), text("edited_sig").alias("edited_fingerprint"), "near_edited", "near_next"]
    return with_class(found, joined).select(*out, "class_id")


def with_class(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """rows (doc_id, node, ...) with class_id; of joined (node, class_id) the nodes that several rows or links have. Other rows are their own class and stay where they are."""
    maybe = likely(rows, joined, "node", mark="_maybe")
    shared = maybe.where("_maybe").join(joined.withColumn("_known", F.lit(True)), "node", "left")
    shared = shared.withColumn("class_id", F.when(F.col("_known"), F.col("class_id")).otherwise(F.col("doc_id")))
    return shared.drop("_known").unionByName(maybe.where("not _maybe").withColumn("class_id", F.col("doc_id"))).drop("_maybe")


def near_duplicates(docs: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(doc_id, class_id) of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("node", pa.int64()), ("sig", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in slices(batches):
            sets = [shingles(t) for t in rb.column(1).to_pylist()]
            node = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
            yield batch(schema, [rb.column(0), node, [signature(s).astype(">u2").tobytes() for s in sets]])

    signed = written(rows.mapInArrow(sign, "doc_id long, node long, sig binary"), "signatures")
    return with_class(signed, written(classes(docs, signed, least), "classes")).select("doc_id", "class_id")


def classes(docs: DataFrame, signed: DataFrame, least: float = LIKENESS) -> DataFrame:
    """(node, class_id) of the shingle sets that several rows of signed (doc_id, node, sig) have or that links join."""
    nodes = written(signed.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    bands = [F.xxhash64(F.lit(i), F.substring("sig", 1 + 2 * ROWS * i, 2 * ROWS)) for i in range(BANDS)]
    banded = signed.select("node", "sig", F.posexplode(F.array(*bands)).alias("i", "band")).drop("i")
    groups = written(banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a != b").select("band"), "groups")
    left = written(likely(banded, groups, "band").join(groups, "band").groupBy("band", "node").agg(F.first("sig").alias("sig")), "banded")

    @F.pandas_udf("double")
    def estimate(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), ">u2").reshape(-1, PERMUTATIONS) for s in (a, b))
        return pd.Series((x == y).mean(axis=1))

    left = written(numbered(left).select("band", "node", "sig", "k"), "members")
    if left.isEmpty():
        return nodes.where("n > 1").select("node", F.col("least").alias("class_id"))
    # a group of copies is one component after this
    some = left.where(F.col("k") <= REPRESENTATIVES).select("band", F.col("node").alias("other"), F.col("sig").alias("theirs"), F.col("k").alias("at"))
    met = left.join(some, "band").where("k > at").withColumn("e", estimate("sig", "theirs")).where(F.col("e") >= NEAR)
    pairs = written(met.select("node", "other").distinct(), "pairs")
    edges = written(verified(docs, pairs, nodes, least).where("alike").select(F.col("node").alias("a"), F.col("other").alias("b")), "links")
    roots = stars(edges)
    now = left.join(roots.withColumnRenamed("v", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_ = now.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where((F.col("r0") != F.col("r1")) & (F.col("n") > REPRESENTATIVES + 1)).select("band")
    left = written(now.join(open_, "band").select("band", "node", "sig", "root"), "members")
    if not left.isEmpty():
        edges = edges.union(written(linked(left.join(sets_of(docs, left.select("node").distinct(), nodes), "node"), least), "links"))
        roots = stars(edges)
    named = roots.union(roots.select("root", "root").distinct()).toDF("node", "root")  # stars() leaves the roots themselves out
    labelled = nodes.join(named, "node", "left").where("root is not null or n > 1").withColumn("root", F.coalesce("root", "node"))
    return labelled.join(labelled.groupBy("root").agg(F.min("least").alias("class_id")), "root").select("node", "class_id")


def numbered(members: DataFrame, hot: int = HOT) -> DataFrame:
    """members (band, node, ...) with k, a number from 1 that is unique in its band.

    A band of over `hot` members, or of over one in MOST_HOT of all there are, is dealt over salts that are numbered apart and take turns. There are at most
    MOST_HOT such bands, whose numbers of salts are broadcast (16 bytes each).
    """
    size = max(hot, members.count() // MOST_HOT)
    large = members.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > size).select("band", F.expr(f"n div {size} + 1").alias("_salts"))
    dealt = members.join(F.broadcast(large), "band", "left").withColumn("_salts", F.coalesce("_salts", F.lit(1).cast("long")))
    dealt = dealt.withColumn("_salt", F.pmod(F.xxhash64("node"), F.col("_salts")))
    place = F.row_number().over(W.partitionBy("band", "_salt").orderBy("node"))
    return dealt.withColumn("k", (place - 1) * F.col("_salts") + F.col("_salt") + 1).drop("_salts", "_salt")


def tiles(members: DataFrame, most: int = BLOCK, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """members (band, node, root, sig, shingles) with band, i, j of the tiles that they are in, and `block`, their own.

    A band's group is dealt over blocks of about `most` members and `most_bytes` of shingles, or one in MOST_HOT of all; every two blocks meet in a tile, and the
    only block of a small group in itself. The numbers of blocks of larger groups are broadcast (16 bytes each).
    """
    size = F.octet_length("shingles")
    known = members.agg(F.count("*").alias("n"), F.sum(size).alias("bytes")).collect()[0]
    most, most_bytes = max(most, known.n // MOST_HOT), max(most_bytes, (known.bytes or 0) // MOST_HOT)
    large = members.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / most, F.sum(size) / most_bytes)).alias("blocks")).where("blocks > 1")
    dealt = members.join(F.broadcast(large), "band", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    met = dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks"))).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return met.select("band", F.least("block", "_with").alias("i"), F.greatest("block", "_with").alias("j"), "block", "node", "root", "sig", "shingles")


def tile_links(root: np.ndarray, block: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links (places) of a tile's members that join the components `root` as all its pairs would; of two blocks only pairs across.

    All pairs that are not joined yet and whose signatures are alike (NEAR) are verified, the likest ones first.
    """
    root = np.unique(root, return_inverse=True)[1]
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(ids, np.cumsum([len(s) for s in sets])[:-1])
    mark = np.zeros(len(ids) + 1, bool)
    across = bool((block != block[0]).any())
    out: list[tuple[int, int]] = []
    for a in range(len(root) - 1):
        rest = root[a + 1 :] != root[a]
        if across:
            rest &= block[a + 1 :] != block[a]
        others = a + 1 + np.flatnonzero(rest)
        for lo in range(0, len(others), 1024):
            some = others[lo : lo + 1024]
            e = (sig[some] == sig[a]).mean(axis=1)
            some, e = some[e >= NEAR], e[e >= NEAR]
            mark[sets[a]] = True
            for b in some[np.argsort(-e, kind="stable")].tolist():
                if root[a] == root[b]:
                    continue
                both = int(np.count_nonzero(mark[sets[b]]))
                if both >= least * (len(sets[a]) + len(sets[b]) - both):
                    out.append((a, b))
                    root[root == root[b]] = root[a]
            mark[sets[a]] = False
    return out


def linked(members: DataFrame, least: float, most: int = BLOCK) -> DataFrame:
    """Links (a, b) between members (band, node, root, sig, shingles) of a band whose Jaccard likeness is at least `least`: as many as join all that are alike.

    A task holds one tile of two blocks. Rows shuffled grow with a group's size by its number of blocks, comparisons with its square.
    """
    at = tiles(members, most)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for rb in slices(batches) for r in zip(*(c.to_pylist() for c in rb.columns)))
        for _, own in groupby(rows, key=lambda r: r[:3]):
            block, node, root, sig, sets = zip(*(r[3:] for r in own))
            found = tile_links(np.array(root), np.array(block), np.frombuffer(b"".join(sig), ">u2").reshape(-1, PERMUTATIONS), [np.frombuffer(s, np.uint32) for s in sets], least)
            if found:
                yield batch(schema, [[node[a] for a, _ in found], [node[b] for _, b in found]])

    return at.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(run, "a long, b long").distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted (node): texts are read again, and those of these nodes (and few others) become sets, as sorted 32-bit hashes."""
    wanted = written(wanted.join(nodes, "node").select("node", F.col("least").alias("doc_id")), "wanted")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # sets that only rows without an id have are looked for among all of these
    some = likely(rows, wanted, "doc_id").union(rows.where("doc_id is null"))
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])  # of the hashes 32 bits are enough to tell them apart in a pair

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in slices(batches):
            own = [shingles(t) for t in rb.column(0).to_pylist()]
            yield batch(schema, [[xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in own], [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in own]])

    known = some.select("text").mapInArrow(sets, "node long, shingles binary").join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    return written(known, "sets")


def verified(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """pairs (node, other) with `alike`: whether the Jaccard likeness of their shingle sets is at least `least`; each pair fetches both."""
    known = sets_of(docs, pairs.select("node").union(pairs.select("other")).distinct(), nodes)
    both = pairs.join(known, "node").join(known.select(F.col("node").alias("other"), F.col("shingles").alias("theirs")), "other")

    @F.pandas_udf("boolean")
    def alike(own: pd.Series, theirs: pd.Series) -> pd.Series:
        def near(a: bytes, b: bytes) -> bool:
            a, b = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
            both = len(np.intersect1d(a, b, assume_unique=True))
            return both >= least * (len(a) + len(b) - both)

        return pd.Series([near(a, b) for a, b in zip(own, theirs)], dtype=bool)

    return both.select("node", "other", alike("shingles", "theirs").alias("alike"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
