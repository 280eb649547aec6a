"""Filter interaction audit: what every order of a set of filters removes, keeps and loses.

A document is the set of filters that it fails, so documents are counted by (part, failed set): at most
2**n rows a part, whatever the table's size. The states of a run are the subsets of filters applied so far;
an edge leads from a state to that state with one more filter, and removes the documents that fail this
filter and none of the state. Forward-backward path counting over this lattice gives the orders that reach
a state and those that leave it; their product over an edge is the number of orders that take it. It weighs
the edge's removals for the Shapley value, and the steps of each single order are read from the same edges.

Shuffles: one of (text digest, doc_id) for the duplicates, one of doc_id for the labels, each with rows of
under 100 bytes; the text is read once and never shuffled. Digests are pre-aggregated, so a text that a third
of all rows has is one row of the smaller side, and its rows are the splittable side of that join. Rows
without doc_id are dealt by their digest.

Nulls and odd input: a null text is empty; a null part is the empty string; a row without doc_id is no
earlier copy of any other and no later one, and has no label; repeated rows count each and are no copies of
one another, as their doc_id is the same; of repeated labels the greatest counts; an empty table gives an
empty result. Columns beside those named are not read.
"""

from __future__ import annotations

import string
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

#: The words of the contract.
SPACE = r"[\x20\x09-\x0D]+"
#: Filters that an audit of all orders takes at most: 8 have 40,320 orders.
MOST_FILTERS = 8


def lattice(n: int) -> dict[tuple[int, int], int]:
    """Orders of n filters that take each edge (state, filter), by counting paths forwards and backwards."""
    states = sorted(range(1 << n), key=int.bit_count)
    reach, leave = {0: 1}, {(1 << n) - 1: 1}
    for s in states:
        for f in range(n):
            if not s >> f & 1:
                reach[s | 1 << f] = reach.get(s | 1 << f, 0) + reach[s]
    for s in reversed(states):
        for f in range(n):
            if s >> f & 1:
                leave[s ^ 1 << f] = leave.get(s ^ 1 << f, 0) + leave[s]
    return {(s, f): reach[s] * leave[s | 1 << f] for s in states for f in range(n) if not s >> f & 1}


def duplicate_of_smaller(rows: DataFrame, doc_id: str, digest: str, name: str) -> DataFrame:
    """rows with `name`: whether a smaller doc_id has the same digest, anywhere in the table."""
    first = rows.groupBy(F.col(digest).alias("_digest")).agg(F.min(doc_id).alias("_first"))
    return rows.join(first, rows[digest] == first["_digest"], "left").withColumn(name, F.coalesce(F.col(doc_id) > F.col("_first"), F.lit(False))).drop("_digest", "_first")


def failures(docs: DataFrame, filters: dict[str, Column | None], part: str, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """part, failed (bit k: fails the k-th filter), good, toxic of every row. A filter of None is `copy of a smaller doc_id's text`.

    The filters are conditions over the columns of docs and `_text`, the text or the empty string, and `_words`.
    """
    words = F.array_remove(F.split("_text", SPACE), "")
    read = docs.withColumn("_text", F.coalesce(F.col(text), F.lit(""))).withColumn("_words", words)
    bits = [F.coalesce(c, F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(filters.values()) if c is not None]
    rows = read.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2("_text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("failed"))
    for k in (k for k, c in enumerate(filters.values()) if c is None):
        rows = duplicate_of_smaller(rows, "id", "digest", "copy")
        rows = rows.withColumn("failed", F.col("failed") + F.col("copy").cast("int") * (1 << k)).drop("copy")
    # rows without an id match no label; dealt by their digest they don't meet in one task
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    known = known.withColumn("salt", F.lit(0).cast("long"))
    rows = rows.withColumn("salt", F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(0))
    found = rows.join(known, ["id", "salt"], "left")
    return found.select("part", "failed", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def edges(failed: DataFrame, n: int) -> DataFrame:
    """part, state, filter and the counts of every edge of the lattice, zeros included, with the orders that take it."""
    spark = failed.sparkSession
    counts = failed.groupBy("part", "failed").agg(F.count("*").alias("docs"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    rows = []
    for (state, f), orders in lattice(n).items():
        for failed_set in range(1 << n):
            own, before = failed_set >> f & 1, failed_set & state
            rows.append((state, f, orders, failed_set, not own and not before, bool(own and not before), bool(own and before), failed_set == 1 << f))
    roles = spark.createDataFrame(rows, "state int, filter int, orders long, failed int, kept boolean, removed boolean, redundant boolean, only boolean")
    # a fixed table of n * 4**n rows over two: 2,560 for five filters
    met = counts.join(F.broadcast(roles), "failed")
    total = lambda role, n="docs": F.sum(F.when(F.col(role), F.col(n)).otherwise(0))
    return met.groupBy("part", "state", "filter", "orders").agg(
        total("kept").alias("kept"), total("removed").alias("removed"), total("redundant").alias("redundant"), total("only").alias("unique_fails"),
        total("removed", "good").alias("good_lost"), total("removed", "toxic").alias("toxic_lost"),
    )


def shapley(taken: DataFrame) -> DataFrame:
    """part, filter, shapley: what the filter removes, summed over all orders."""
    return taken.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))


def audit(docs: DataFrame, filters: dict[str, Column | None], part: str, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each part, order of the filters (their names in a row) and step, with the counts and the filter's Shapley sum."""
    n, names = len(filters), list(filters)
    if not 1 <= n <= MOST_FILTERS:
        raise ValueError(f"an audit of all orders takes 1 to {MOST_FILTERS} filters")
    spark = docs.sparkSession
    taken = edges(failures(docs, filters, part, labels, doc_id, text), n)
    worth = shapley(taken)
    steps = []
    for order in permutations(range(n)):
        state = 0
        for k, f in enumerate(order):
            steps.append(("".join(names[x] for x in order), k + 1, state, f))
            state |= 1 << f
    orders = spark.createDataFrame(steps, "filter_order string, step int, state int, filter int")
    return taken.join(F.broadcast(orders), ["state", "filter"]).join(worth, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def contract_filters() -> dict[str, Column | None]:
    text, words = F.col("_text"), F.size("_words")
    upper = F.length(text) - F.length(F.translate(text, string.ascii_uppercase, ""))
    return {
        "A": words < 100,
        "B": 100 * F.size(F.array_distinct("_words")) < 80 * words,
        "C": 100 * upper > 10 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
        "E": None,
    }


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir), contract_filters(), "lang", spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLE = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as least from t),
l as (select doc_id, max(quality = 1) as good, max(toxic = 1) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, {
    'A': len(words) < 100, 'B': 100 * len(list_distinct(words)) < 80 * len(words),
    'C': 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(w.doc_id > least, false)} as fails
  from w left join l on l.doc_id = w.doc_id
),
x(c) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (
  select a.c || b.c || c.c || d.c || e.c as filter_order from x a, x b, x c, x d, x e
  where length(replace(replace(replace(replace(replace(filter_order, 'A', ''), 'B', ''), 'C', ''), 'D', ''), 'E', '')) = 0
    and a.c <> b.c and a.c not in (c.c, d.c, e.c) and b.c not in (c.c, d.c, e.c) and c.c not in (d.c, e.c) and d.c <> e.c
),
s as (select filter_order, unnest(range(1, 6)) as step from o),
m as (
  select part, good, toxic, fails.A as a, fails.B as b, fails.C as c, fails.D as d, fails.E as e, count(*) as n from f group by all
),
p as (
  select part, filter_order, step, filter_order[step] as own, n, good, toxic, {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} as fails from m cross join s
),
g as (
  select *, case own when 'A' then fails.A when 'B' then fails.B when 'C' then fails.C when 'D' then fails.D else fails.E end as here,
    (contains(filter_order[1:step - 1], 'A') and fails.A) or (contains(filter_order[1:step - 1], 'B') and fails.B) or (contains(filter_order[1:step - 1], 'C') and fails.C)
      or (contains(filter_order[1:step - 1], 'D') and fails.D) or (contains(filter_order[1:step - 1], 'E') and fails.E) as before,
    fails.A::int + fails.B::int + fails.C::int + fails.D::int + fails.E::int as failing
  from p
),
r as (
  select part, filter_order, step, own,
    sum(case when not here and not before then n else 0 end)::bigint as kept, sum(case when here and not before then n else 0 end)::bigint as removed,
    sum(case when here and before then n else 0 end)::bigint as redundant, sum(case when here and failing = 1 then n else 0 end)::bigint as unique_fails,
    sum(case when here and not before and good then n else 0 end)::bigint as good_lost, sum(case when here and not before and toxic then n else 0 end)::bigint as toxic_lost
  from g group by all
)
select part, filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley from r
"""
