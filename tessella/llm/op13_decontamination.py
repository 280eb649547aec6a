"""Benchmark decontamination: passages of benchmark items inside documents, by a prefix-filtered set join.

An item is cut into windows of 10 consecutive words (a shorter item is one window), a window into shingles
of five. A window stands in a document where a stretch of the document as long as the window holds its
shingles, each at its place. Only DataFrame functions are used.

1. Documents are cut into shingles in one run and those of any item are kept, with the words around them: a stretch that holds every
   window that the shingle may be part of. What is kept grows with what documents and items share; no text is shuffled.
2. Counting what was kept gives the order of rarity over all documents. A window with too many shingles that occur nowhere can't occur.
3. Of a window with s shingles of which c must be found, the s - c + 1 rarest are its prefix: every
   occurrence has one of them at least. With exact containment c is s and the prefix is the rarest shingle alone.
4. What was kept meets the prefixes only. A prefix shingle at place o of its window and at word p of a document says where the
   window would begin: p - o. It must not begin before the document or end behind it (positional and length bounds).
5. The window is compared with the item-sized stretch there, word by word, so a hash tells nothing wrong.

What is broadcast are hashes of shingles and the windows of a block: at most BLOCK shingles with their windows, or 8 * BLOCK hashes, at a
time. More are taken block by block, each a run over all documents. What is shuffled are counts and occurrences found.
Occurrences of a document are merged by their borders, so a passage that is repeated in a document is hit once a word.

Nulls and odd input: null texts have no words; rows alike in doc_id and text are judged once and returned
each; an item without words has no window; items of one item_id are one item; an item_id of null is written as the empty string. Texts are told apart
by a hash of 64 bits within one doc_id. An empty table of documents gives an empty result, one of items gives no hits.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, written

#: Words of a window and of a shingle.
WINDOW, SHINGLE = 10, 5
#: Prefix shingles of a block, of some hundred bytes each with their windows.
BLOCK = 1 << 16
# Java tests the characters of a class that are listed one by one by a single look into a table, and ranges one after the other
_ASCII = [chr(c) for c in range(128)]
GAPS = "[" + "".join(f"\\x{ord(c):02X}" for c in _ASCII if not c.isalnum()) + "]+"
WORDS = "[" + "".join(c for c in _ASCII if c.isalnum()) + r"\x{80}-\x{10FFFF}]+"


def words_of(text: Column) -> Column:
    # lower() is far quicker, and the same where all characters are ASCII
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    # cutting at gaps makes no match object for every word; a text that begins or ends with a gap has an empty string there
    return F.array_remove(F.split(low, GAPS), "")


def count_of_words(text: Column) -> Column:
    """As many as words_of() has: A-Z are parts of words before they are lower-cased."""
    return F.regexp_count(text, F.lit(WORDS))


def shingle_at(words: Column, pos: Column, k: int) -> Column:
    """The hash of the k words from a place (from 0) on, in order."""
    return F.xxhash64(*[F.get(words, pos + j) for j in range(k)])


def windows(items: DataFrame, item_id: str, text: str, window: int, shingle: int) -> DataFrame:
    """item, words, k (words of a shingle) of every distinct window of an item."""
    named = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words_of(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - (window - 1), F.lit(1))))
    cut = named.select("item", "w", starts.alias("s")).select("item", F.slice("w", F.col("s"), F.lit(window)).alias("words")).distinct()
    return cut.withColumn("k", F.least(F.size("words"), F.lit(shingle)))


def _cut(docs: DataFrame, k: int) -> DataFrame:
    """docs with `pos` and `h` of every shingle of k words of `words`; rows, not arrays, so that the hash is compiled code."""
    each = docs.select("*", F.posexplode("words").alias("pos", "w")).drop("w").where(F.col("pos") + k <= F.size("words"))
    return each.withColumn("h", shingle_at(F.col("words"), F.col("pos"), k))


def _parts(rows: DataFrame, key: str, most: int) -> list[DataFrame]:
    """rows in parts that hold at most about `most` values of `key`."""
    parts = -(-rows.select(key).distinct().count() // most)
    return [rows.where(F.pmod(F.xxhash64(key, F.lit(1)), F.lit(parts)) == p) for p in range(parts)] if parts > 1 else [rows]


def occurrences(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, shingle: int, least: float, block: int) -> DataFrame:
    """doc_id, digest, start, length, item: where a window of an item stands in a document, counted in words from 0."""
    found = written(windows(items, item_id, item_text, window, shingle), "windows")
    sizes = sorted(r.k for r in found.select("k").distinct().collect())  # at most `shingle` of them
    read = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"), words_of(F.col(text)).alias("words"))
    out = None
    for k in sizes:
        own = found.where(F.col("k") == k)
        asked = _cut(own, k).select("h").distinct()
        first = F.greatest(F.col("pos") - (window - k), F.lit(0))
        around = F.slice("words", first + 1, F.col("pos") + window - first)
        parts = [_cut(read, k).join(F.broadcast(p), "h").select("doc_id", "digest", "pos", "h", F.size("words").alias("n"), first.alias("first"), around.alias("around")) for p in _parts(asked, "h", 8 * block)]
        kept = written(functools.reduce(DataFrame.unionByName, parts), "kept")
        counts = kept.groupBy("h").count()
        numbered = _cut(own, k).select("item", "words", (F.size("words") - (k - 1)).alias("s"), F.col("pos").alias("o"), "h")
        need = F.ceil(F.col("s") * least - 1e-9)
        rare = F.row_number().over(W.partitionBy("item", "words").orderBy("count", "h", "o"))
        ranked = numbered.join(counts, "h", "left").fillna(0, ["count"]).withColumns({"need": need, "rank": rare})
        # a shingle that occurs nowhere ranks first and leads nowhere
        prefix = written(ranked.where("rank <= s - need + 1 and count > 0").select("h", "o", "item", "words", "s", "need"), "prefixes")
        for part in _parts(prefix, "h", block):
            met = kept.join(F.broadcast(part.withColumnRenamed("words", "own")), "h").withColumn("start", F.col("pos") - F.col("o"))
            met = met.where((F.col("start") >= 0) & (F.col("start") + F.size("own") <= F.col("n")))
            stretch = met.withColumn("there", F.slice("around", F.col("start") - F.col("first") + 1, F.size("own")))
            if least >= 1:
                holds = F.col("there") == F.col("own")
            else:
                alike = lambda i: (F.slice("there", i, k) == F.slice("own", i, k)).cast("int")  # noqa: B023, E731
                holds = F.aggregate(F.sequence(F.lit(1), F.col("s")), F.lit(0), lambda a, i: a + alike(i)) >= F.col("need")
            hits = stretch.where(holds).select("doc_id", "digest", "start", F.size("own").alias("length"), "item")
            out = hits if out is None else out.unionByName(hits)
    if out is None:
        return read.select("doc_id", "digest", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("item")).where("false")
    return written(out.distinct(), "occurrences")


def scan(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE, least: float = 1.0, block: int = BLOCK,
) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids of the items with a window in it) of every document.

    `least` is the share of a window's shingles that a stretch of a document must hold; 1 is the whole window.
    """
    c = F.col
    key = ["doc_id", "digest"]
    found = occurrences(docs, items, doc_id, text, item_id, item_text, window, shingle, least, block)
    spans = found.groupBy(*key, "start").agg(F.max(c("start") + c("length")).alias("end"))
    before = F.max("end").over(W.partitionBy(*key).orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    hit = spans.withColumn("new", F.greatest(c("end") - F.greatest(c("start"), F.coalesce(before, F.lit(0))), F.lit(0))).groupBy(*key).agg(F.sum("new").alias("n_hit"))
    named = found.select(*key, "item").distinct().groupBy(*key).agg(F.sort_array(F.collect_list("item")).alias("items"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["digest"] == b["digest"])
    judged = hit.join(named, same(hit, named)).select(hit["doc_id"], hit["digest"], "n_hit", "items")
    # only documents with a hit have a row here, one for all rows alike
    counted = docs.select(c(doc_id).alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("digest"), F.coalesce(count_of_words(F.col(text)), F.lit(0)).cast("long").alias("n_words"))
    return counted.join(judged, same(counted, judged), "left").select(counted["doc_id"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options: object) -> DataFrame:
    """The documents without any window of an item, with all their columns; rows are told apart by doc_id and text."""
    found = occurrences(docs, items, options.get("doc_id", "doc_id"), text, options.get("item_id", "item_id"), options.get("item_text", "text"), options.get("window", WINDOW), options.get("shingle", SHINGLE), options.get("least", 1.0), options.get("block", BLOCK))
    bad = found.select(F.col("doc_id").alias("_bad"), F.col("digest").alias("_digest")).distinct()
    return docs.join(bad, docs[options.get("doc_id", "doc_id")].eqNullSafe(bad["_bad"]) & (F.xxhash64(docs[text]) == bad["_digest"]) & docs[text].isNotNull(), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
with d as (select row_number() over () as row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
c as (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0),
v as (select distinct item, array_to_string(w[s:s + 9], ' ') as t, least(len(w), 10) as k from c),
k as (select distinct k from v),
p as (select row, w, k, unnest(range(1, len(w) - k + 2)) as s from d, k where len(w) >= k),
o as (select row, s, p.k, item from (select row, s, k, array_to_string(w[s:s + k - 1], ' ') as t from p) p join v on v.t = p.t and v.k = p.k),
h as (select row, count(distinct x)::bigint as n_hit from (select row, unnest(range(s, s + k)) as x from o) group by row),
i as (select row, count(*)::bigint as n_items, string_agg(item, ',' order by item) as ids from (select distinct row, item from o) group by row)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join h using (row) left join i using (row)
"""
