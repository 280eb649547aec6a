"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that a document belongs to). Each
pattern offers its words once at no cost, a second time at cost 1 and a third time at cost 2, so that
repetition is convex; the flow routes these words to the quotas of the sources at least cost. What
flows out of a pattern is then taken from its documents: every document as often as the flow goes
wholly round, and once more those that come first in a seeded order, until the rest is used up.

The seeded order is by a hash of the whole row and then by a number that every row gets as it is written,
so rows alike in all columns are taken one by one. It is cut digit by digit: a histogram of 4096 digits for
each pattern finds the one with the cut, and its own next digits are counted until no more than CELL rows
are left to be put in order. No task and no window ever holds the documents of a large source. Up to CLOSING
documents more, each the largest that fits in, then close the gap that whole documents leave.

The driver holds a row for each pattern and source. More than `MAX_PATTERNS` patterns are refused.

Nulls and odd input: a null text has 0 words; a null source is a source of its own, sorted last; a
document of 0 words is taken 0 words. An empty table gives an empty result. Repeated rows are separate
documents, of which some may be taken more often than others.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, documents, free_names, written

MAX_REPEATS = 3
MAX_PATTERNS = 100_000
#: Rows of a pattern that one window may put in order.
CELL = 50_000
#: Documents that close a gap one after the other, at most.
CLOSING = 6
SEED = 20
#: Bits of the order that are told apart at once, and of the hash and of the row number that follow each other in it.
DIGIT, LONG = 12, 63


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3)) -> dict[str | None, float]:
    """The words each source should give: by weight, at most MAX_REPEATS times its size, the excess shared again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = float(sum(sizes.values())), {}, list(names)
    while free:
        left = total - sum(out.values())
        per = left / sum(weight[s] for s in free)
        full = [s for s in free if per * weight[s] > MAX_REPEATS * sizes[s]]
        if not full:
            return out | {s: per * weight[s] for s in free}
        out |= {s: float(MAX_REPEATS * sizes[s]) for s in full}
        free = [s for s in free if s not in out]
    return out


def route(patterns: dict[tuple, int], quotas: dict[str | None, int]) -> dict[tuple[tuple, str | None], int]:
    """Least-cost words from each pattern to each of its sources: successive shortest augmenting paths.

    Costs depend on the pattern alone (0, 1, 2 for its first, second and third round), so offering one
    round after another and augmenting along unweighted paths keeps every intermediate flow optimal.
    """
    flow: dict[tuple, dict] = {p: defaultdict(int) for p in patterns}
    into: dict[str | None, set] = defaultdict(set)
    need = dict(quotas)
    dead: set = set()  # what no source with an open quota can be reached from, now or later
    for _ in range(MAX_REPEATS):
        for p, left in sorted(patterns.items(), key=lambda x: [(s is None, s or "") for s in x[0]]):
            while left > 0 and ("p", p) not in dead:
                # breadth first from p: pattern -> source -> any pattern that now feeds it -> ...
                came, queue, end = {}, deque([("p", p)]), None
                seen = {("p", p)}
                while queue and end is None:
                    kind, x = queue.popleft()
                    nexts = [("s", s) for s in x] if kind == "p" else [("p", q) for q in into[x] if flow[q][x] > 0]
                    for y in nexts:
                        if y in seen or y in dead:
                            continue
                        seen.add(y)
                        came[y] = (kind, x)
                        if y[0] == "s" and need.get(y[1], 0) > 0:
                            end = y
                            break
                        queue.append(y)
                if end is None:
                    dead |= seen
                    break
                path, y = [end], end
                while y != ("p", p):
                    y = came[y]
                    path.append(y)
                path.reverse()
                amount = min([left, need[end[1]], *(flow[q[1]][s[1]] for s, q in zip(path[1::2], path[2::2]))])
                for q, s in zip(path[::2], path[1::2]):
                    flow[q[1]][s[1]] += amount
                    into[s[1]].add(q[1])
                for s, q in zip(path[1::2], path[2::2]):
                    flow[q[1]][s[1]] -= amount
                need[end[1]] -= amount
                left -= amount
    return {(p, s): n for p, to in flow.items() for s, n in to.items() if n}


def mix(docs: DataFrame, members: Column | None = None, size: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), seed: int = SEED, keep: list[str] | None = None, cell: int = CELL) -> DataFrame:
    """docs (or its columns in keep) with a last column, a struct `mix`: size, source_size, target, copies.

    members: an array of the sources that a document belongs to; by default its one `source`.
    source_size and target are sums over the sources that the document belongs to.
    """
    spark = docs.sparkSession
    members = F.array(F.col("source")) if members is None else F.array_sort(F.array_distinct(members))
    size = words(F.col("text")) if size is None else size
    (name,) = free_names(docs.columns, "mix")
    positive = lambda x: F.shiftrightunsigned(x, 64 - LONG)
    key, number = positive(F.xxhash64(F.lit(seed), *docs.columns)), positive(F.xxhash64(F.lit(seed), F.monotonically_increasing_id()))
    slim = docs.select(F.struct(*(keep or docs.columns)).alias("row"), members.alias("members"), size.alias("size"), key.alias("h"), number.alias("u"))
    slim = written(slim, "sized")  # from here on a row keeps its number
    got = slim.groupBy("members").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(got) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    patterns = {tuple(r.members): r.n for r in got}
    sizes: dict[str | None, int] = defaultdict(int)
    for p, n in patterns.items():
        for s in p:
            sizes[s] += n
    share = targets(sizes, weights) if sum(sizes.values()) else dict.fromkeys(sizes, 0.0)
    out: dict[tuple, int] = defaultdict(int)
    for (p, _), n in route(patterns, {s: round(t) for s, t in share.items()}).items():
        out[p] += n
    plan = {}
    for p, n in patterns.items():
        rounds, rest = divmod(out[p], n) if n else (0, 0)
        plan[p] = dict.fromkeys(PLAN) | {"rounds": rounds, "rest": rest, "source_size": sum(sizes[s] for s in p), "target": float(sum(share[s] for s in p)), "before": 0, "h_bits": 0, "h_is": 0, "u_bits": 0, "u_is": 0, "gap": 0, "extra": []}

    inside = (F.col("h").bitwiseAND(F.col("h_bits")) == F.col("h_is")) & (F.col("u").bitwiseAND(F.col("u_bits")) == F.col("u_is"))
    sized = slim.where("size > 0").select("members", "size", "h", "u")
    for column, low in [(c, low) for c in "hu" for low in range(LONG - DIGIT, -DIGIT, -DIGIT)]:
        low = max(low, 0)
        digit = F.shiftright(column, low).bitwiseAND(F.lit((1 << DIGIT) - 1))
        upto = W.partitionBy("members").orderBy("digit")
        counts = _planned(sized, plan).where(inside & (F.col("rest") > 0)).groupBy("members", "before", "rest", digit.alias("digit")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
        counts = counts.withColumn("start", F.col("before") + F.sum("n").over(upto) - F.col("n"))
        most = 0
        for r in counts.where("start < rest and start + n >= rest").collect():
            x = plan[tuple(r.members)]
            x[f"{column}_bits"] |= ((1 << DIGIT) - 1) << low
            x[f"{column}_is"] = x[f"{column}_is"] & ~(((1 << DIGIT) - 1) << low) | (r.digit << low)
            x["before"] = r.start
            most = max(most, r.rows)
        if most <= cell:
            break
    # in the rest: whole documents in order while they fit
    upto = W.partitionBy("members").orderBy("h", "u").rowsBetween(W.unboundedPreceding, 0)
    fits = _planned(sized, plan).where(inside & (F.col("rest") > 0)).withColumn("upto", F.col("before") + F.sum("size").over(upto)).where("upto <= rest")
    fits = {tuple(r.members): r.last for r in fits.groupBy("members").agg(F.max(F.struct("upto", "h", "u")).alias("last")).collect()}
    for p, x in plan.items():
        last = fits.get(p)
        x["gap"] = x["rest"] - (last.upto if last else x["before"])
        if last:
            x |= {"last_h": last.h, "last_u": last.u}
    part_h, part_u = F.col("h").bitwiseAND(F.col("h_bits")), F.col("u").bitwiseAND(F.col("u_bits"))
    up_to_last = (F.col("h") < F.col("last_h")) | ((F.col("h") == F.col("last_h")) & (F.col("u") <= F.col("last_u")))
    before = (part_h < F.col("h_is")) | ((part_h == F.col("h_is")) & ((part_u < F.col("u_is")) | ((part_u == F.col("u_is")) & up_to_last)))
    first = F.coalesce(before, F.lit(False))
    extra = F.exists("extra", lambda e: (e.h == F.col("h")) & (e.u == F.col("u")))
    # the gap is closed by the largest documents that fit in, one at a time; most gaps are gone after two
    for _ in range(CLOSING):
        close = _planned(sized, plan).where(~first & ~extra).where("size <= gap")
        got = close.groupBy("members").agg(F.max(F.struct("size", "h", "u")).alias("best")).collect()
        for r in got:
            x = plan[tuple(r.members)]
            x |= {"extra": [*x["extra"], (r.best.h, r.best.u)], "gap": x["gap"] - r.best["size"]}
        if not any(x["gap"] for x in plan.values()) or not got:
            break
    copies = F.col("rounds") + (first | extra).cast("long")
    copies = F.when(F.col("size") == 0, 0).otherwise(F.least(copies, F.lit(MAX_REPEATS))).cast("long")
    mixed = _planned(slim, plan).withColumn("mixed", F.struct("size", "source_size", "target", copies.alias("copies")))
    return mixed.select("row.*", F.col("mixed").alias(name))


#: What the driver knows of a pattern: whole rounds, words beyond them, sums over its sources, the words before the
#: cell with the cut, the cell's bits and their values, the last row that fits, what is missing, and the rows that close the gap.
PLAN = ["rounds", "rest", "source_size", "target", "before", "h_bits", "h_is", "u_bits", "u_is", "last_h", "last_u", "gap", "extra"]


def _planned(rows: DataFrame, plan: dict[tuple, dict]) -> DataFrame:
    """rows joined to the plan of their pattern; at most MAX_PATTERNS rows are broadcast."""
    kinds = "members array<string>, " + ", ".join(f"{c} { {'target': 'double', 'extra': 'array<struct<h:long,u:long>>'}.get(c, 'long') }" for c in PLAN)
    pattern = F.to_json(F.struct("members"), {"ignoreNullFields": "false"})
    side = rows.sparkSession.createDataFrame([(list(p), *(x[c] for c in PLAN)) for p, x in plan.items()], kinds)
    return rows.withColumn("pattern", pattern).join(F.broadcast(side.withColumn("pattern", pattern).drop("members")), "pattern").drop("pattern")


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    found = mix(docs)
    name = found.columns[-1]
    (copy,) = free_names(found.columns, "copy")
    some = found.where(F.col(f"{name}.copies") > 0)
    return some.withColumn(copy, F.explode(F.array_repeat(F.lit(True), F.col(f"{name}.copies").cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(documents(spark, sf_dir).select("doc_id", "text", "source"), keep=["doc_id"])
    return found.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))
