"""Event logs: collapse, merge, attempts, lifecycles and rates, by windows over a log's own key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def collapse(events: DataFrame, log: list[str], order: list[str], state: str) -> DataFrame:
    """The events whose state differs from that of the event before in the same log."""
    w = W.partitionBy(*log).orderBy(*order)
    marked = events.withColumns({"_b": F.lag(state).over(w), "_n": F.row_number().over(w)})
    return marked.where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(state))).drop("_b", "_n")


def merge(logs: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """The union of the logs: equal rows are one, other rows under the same id get #2, #3, ... in their order."""
    all_rows = logs[0]
    for other in logs[1:]:
        all_rows = all_rows.unionByName(other)
    number = F.row_number().over(W.partitionBy(key).orderBy(*order))
    name = F.col(key).cast("string")
    return all_rows.distinct().withColumn("_n", number).withColumn("merged_id", F.when(F.col("_n") == 1, name).otherwise(F.concat(name, F.lit("#"), F.col("_n")))).drop("_n")


def last_attempt(events: DataFrame, log: list[str], order: list[str], terminal: Column) -> DataFrame:
    """The events of each log's last attempt; an attempt ends with a terminal event, which belongs to it."""
    before = W.partitionBy(*log).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    attempt = F.coalesce(F.sum(terminal.cast("long")).over(before), F.lit(0))
    numbered = events.withColumn("attempt", attempt)
    return numbered.withColumn("_last", F.max("attempt").over(W.partitionBy(*log))).where("attempt = _last").drop("_last")


def lifecycle(events: DataFrame, log: list[str], ts: str, state: str, *ties: str) -> DataFrame:
    """First and last state of each log by (ts, ties), the time between in seconds (pauses included) and its events."""
    order = F.struct(ts, *ties)
    return events.groupBy(*log).agg(
        F.min_by(state, order).alias("first_state"), F.max_by(state, order).alias("last_state"),
        ((F.max(F.unix_micros(ts)) - F.min(F.unix_micros(ts))) / 1e6).alias("seconds"), F.count("*").alias("events"),
    )


def rates(events: DataFrame, log: list[str], ts: str, value: str, seconds: int = 600, least: int = 3, span: float = 5.0) -> DataFrame:
    """Progress a second over the last `seconds`; null with fewer than `least` samples or less than `span` seconds."""
    w = W.partitionBy(*log).orderBy(F.unix_micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    t = (F.max(F.unix_micros(ts)).over(w) - F.min(F.unix_micros(ts)).over(w)) / 1e6
    gained = F.last(value).over(w) - F.first(value).over(w)
    n = F.count("*").over(w)
    return events.withColumn("samples", n).withColumn("rate", F.when((n >= least) & (t >= span), gained / t))


def thinned(events: DataFrame, log: list[str], ts: str, gap: float = 2.0) -> DataFrame:
    """Events that are at least `gap` seconds after the last one kept in their log.

    What is kept depends on what was kept before, so a log is folded in order: an aggregate over its sorted
    times, which keeps one number for each event of one log.
    """
    us = int(gap * 1e6)
    times = events.groupBy(*log).agg(F.array_sort(F.collect_set(F.unix_micros(ts))).alias("_t"))
    start = F.array().cast("array<bigint>")
    keep = F.aggregate("_t", start, lambda kept, t: F.when((F.size(kept) == 0) | (t - F.element_at(kept, -1) >= us), F.concat(kept, F.array(t))).otherwise(kept))
    kept = times.select(*log, F.explode(keep).alias("_t"))
    return events.withColumn("_t", F.unix_micros(ts)).join(kept, [*log, "_t"], "left_semi").drop("_t")


def remaining(events: DataFrame, log: list[str], ts: str, progress: str, seconds: int = 600, least: int = 3, span: float = 5.0) -> DataFrame:
    """events with `eta`: whole seconds to go at the rate of the samples of the last `seconds`; null if there are too few or none is gained."""
    rated = rates(events, log, ts, progress, seconds, least, span)
    return rated.withColumn("eta", F.when(F.col("rate") > 0, F.ceil((1 - F.col(progress)) / F.col("rate"))))


def last_use(uses: DataFrame, endpoint: str, order: str) -> DataFrame:
    """Each use with `release`: whether it is the last of its endpoint."""
    return uses.withColumn("release", F.col(order) == F.max(order).over(W.partitionBy(endpoint)))
