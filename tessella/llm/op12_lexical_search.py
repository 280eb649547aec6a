"""Ranked lexical search: the best documents for each query text, by presence masks.

Queries are answered in blocks: a block holds at most TERMS distinct terms, so what is broadcast has a
fixed bound, and each block is one run over all documents. Of a document only the terms of the block are
kept: their numbers and occurrences, and how many terms it has in all. Statistics come from that table.

Then documents are scored in pieces of some thousand. A piece has a bitmap for every term, of the documents
that hold it. For a query the bitmaps of its terms, turned over, are its documents' presence masks; documents
are grouped by mask. A mask has a greatest score: for each of its terms, what the piece's most occurrences
of it give in the shortest document of the mask. Masks are evaluated in descending order of it, a document's exact
score from its own occurrences, until no mask that is left can reach the k-th score found; a mask that
can just reach it is evaluated, as ties go to the smaller doc_id. A piece's k best documents of each query are exact, and
so are the k best of all pieces.

Memory: a piece's bitmaps take at most BITMAP bytes while they are built. Spark ranks the pieces' rows with a limit for each
task before the shuffle.

Nulls and odd input: a null text has no terms, in queries too; queries of one item_id are one query with the
terms of all its texts (a null item_id is one item); a document without doc_id is ranked behind all of its
score; repeated rows are ranked each; a query or a document without terms gives no row; an empty table on
either side gives an empty result. Products beyond 64 bits raise an error: 50 * terms of a document * documents must stay below 2**63.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batch, documents, slices, written

#: Distinct terms of a block of queries, bytes of a piece's bitmaps before packing, documents of a piece.
TERMS, BITMAP, PIECE = 1 << 14, 1 << 26, 1 << 13
#: Documents that are scored at once, at least.
CHUNK = 256
#: Bytes to bytes: A-Z become a-z, and ASCII that is no letter or digit a blank; bytes of other characters stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))

_tokens = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tf", pa.list_(pa.int64()))])
_scored = pa.schema([("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all other characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(TABLE).split()


def blocks_of(items: DataFrame, item_id: str, text: str, most: int = TERMS) -> Iterator[tuple[list, list[list[int]], dict[bytes, int]]]:
    """(item ids, numbers of each item's terms, number of each term) of blocks with at most `most` distinct terms, or one item."""
    rows = items.groupBy(F.col(item_id).alias("item_id")).agg(F.concat_ws(" ", F.collect_list(text)).alias("text")).orderBy("item_id")
    ids, own, known = [], [], {}
    for r in rows.toLocalIterator():
        words = sorted(set(terms(r.text.encode())))
        if not words:
            continue
        if ids and len(known) + sum(w not in known for w in words) > most:
            yield ids, own, known
            ids, own, known = [], [], {}
        ids.append(r.item_id)
        own.append([known.setdefault(w, len(known)) for w in words])
    if ids:
        yield ids, own, known


def tokenised(docs: DataFrame, known: dict[bytes, int], doc_id: str, text: str) -> DataFrame:
    """doc_id, n, terms, tf of documents that have a term at all; terms and tf only of those in `known`."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for rb in slices(batches):
            ids, n, found, tf = [], [], [], []
            for i, t in zip(rb.column(0), rb.column(1)):
                words = terms(t.as_py() or b"")
                if words:
                    own = Counter(filter(lambda x: x is not None, map(numbers.get, words)))
                    ids.append(i.as_py())
                    n.append(len(words))
                    found.append(list(own.keys()))
                    tf.append(list(own.values()))
            yield batch(_tokens, [ids, n, found, tf])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


class Piece:
    """Documents with bitmaps of their terms."""

    def __init__(self, m: np.ndarray, doc_id: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, size: int):
        self.m, self.doc_id, self.size = m, doc_id, size
        present = np.zeros((size, -(-len(m) // 8) * 8), bool)
        present[term, doc] = True
        self.bits = np.packbits(present, axis=1)
        order = np.argsort(doc.astype(np.int64) * size + term)
        self.key, self.tf = (doc.astype(np.int64) * size + term)[order], tf[order]
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, term, tf)

    def masks(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(documents, group of each, matched terms of each group) for a query's terms: documents of one mask are one group."""
        columns = np.packbits(np.unpackbits(self.bits[own], axis=1), axis=0)  # a byte of the mask for eight terms
        group = np.zeros(columns.shape[1], np.int64)
        for byte in columns:
            group = np.unique(group * 256 + byte, return_inverse=True)[1]
        docs = np.flatnonzero(columns.any(axis=0))
        first, group = np.unique(group[docs], return_index=True, return_inverse=True)[1:]
        matched = np.unpackbits(columns[:, docs[first]], axis=0)[: len(own)].T.astype(bool)
        return docs, group, matched

    def scores(self, docs: np.ndarray, own: np.ndarray, weight: np.ndarray) -> np.ndarray:
        key = docs[:, None].astype(np.int64) * self.size + own[None, :]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        tf = np.where(self.key[at] == key, self.tf[at], 0)
        return (weight * saturated(tf, self.m[docs][:, None])).sum(axis=1)

    def best(self, own: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, documents scored): at least the piece's k best for one query, ties at the k-th place included."""
        docs, group, matched = self.masks(own)
        if not len(docs):
            return docs, np.zeros(0, np.int64), 0
        shortest = np.full(len(matched), np.iinfo(np.int64).max)
        np.minimum.at(shortest, group, self.m[docs])
        bound = (matched * weight * saturated(self.most[own], shortest[:, None])).sum(axis=1)
        by_bound = np.argsort(-bound, kind="stable")
        place = np.empty(len(bound), np.int64)
        place[by_bound] = np.arange(len(bound))
        docs = docs[np.argsort(place[group], kind="stable")]
        ends = np.cumsum(np.bincount(group, minlength=len(bound))[by_bound])
        found, scores, done, kth = [], [], 0, 0
        while done < len(docs):
            nearest = int(np.searchsorted(ends, done, side="right"))
            if kth and bound[by_bound[nearest]] < kth:
                break
            upto = int(ends[np.searchsorted(ends, min(done + CHUNK, len(docs)))])  # whole masks
            some = docs[done:upto]
            found.append(some)
            scores.append(self.scores(some, own, weight))
            done = upto
            if done >= k:
                kth = int(np.partition(np.concatenate(scores), -k)[-k])
        found, scores = np.concatenate(found), np.concatenate(scores)
        fine = scores >= max(kth, 1)
        return found[fine], scores[fine], done


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Rises with tf and falls with m, 0 for tf = 0."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _ranked(postings: DataFrame, own: list[list[int]], weight: np.ndarray, k: int) -> DataFrame:
    """item (its place in the block), doc_id, score of every piece's k best."""
    size = len(weight)
    shared = postings.sparkSession.sparkContext.broadcast(([np.array(x, np.int64) for x in own], weight))
    piece = max(64, min(PIECE, BITMAP // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value
        nothing = np.iinfo(np.int64).max
        for rb in slices(batches, piece):
            if not rb.num_rows:
                continue
            lists, tf = rb.column("terms"), rb.column("tf")
            doc = np.repeat(np.arange(rb.num_rows), np.diff(lists.offsets.to_numpy()))
            values = Piece(rb.column("m").to_numpy(), rb.column("doc_id").fill_null(nothing).to_numpy(), doc, lists.flatten().to_numpy(), tf.flatten().to_numpy(), size)
            out = []
            for i, x in enumerate(items):
                docs, scores, _ = values.best(x, w[x], k)
                order = np.lexsort((values.doc_id[docs], -scores))[:k]
                out.append((np.full(len(order), i), values.doc_id[docs[order]], scores[order]))
            item, ids, scores = (np.concatenate(c) for c in zip(*out))
            yield batch(_scored, [item.astype(np.int32), pa.array(ids, mask=ids == nothing), scores])

    return postings.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most: int = TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the k documents with the greatest score above 0 for every item."""
    spark, kind, out = docs.sparkSession, items.schema[item_id].dataType.simpleString(), None
    for ids, own, known in blocks_of(items, item_id, item_text, most):
        rows = written(tokenised(docs, known, doc_id, text), "terms")
        n, length = rows.agg(F.count("*"), F.sum("n")).first()
        df = np.zeros(len(known), np.int64)
        for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():
            df[r.term] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        postings = rows.where(F.size("terms") > 0).select("doc_id", F.expr(f"50 + (50L * n * {n}L) div {length or 1}L").alias("m"), "terms", "tf")
        order = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = _ranked(postings, own, weight, k).withColumn("rank", order).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
        best = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = best if out is None else out.unionByName(best)
    return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long") if out is None else out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents where text is not null),
q as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
s as (select count(*)::bigint as nn, sum(len(t))::bigint as ll from d where len(t) > 0),
f as (select row, doc_id, n, term, count(*)::bigint as tf from (select row_number() over () as row, doc_id, len(t)::bigint as n, unnest(t) as term from d) group by all),
w as (select term, floor(1000 * ln((2 * any_value(nn) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, s group by term),
p as (select item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * nn) // ll))))::bigint as score
  from q join f using (term) join w using (term), s group by all),
r as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from p where score > 0)
select item_id, rank::integer as rank, doc_id, score from r where rank <= 50
"""
