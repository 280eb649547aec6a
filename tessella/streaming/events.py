"""Structured Streaming over the event log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def source(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """The log as a stream: new files of that name in the folder; ts as a UTC timestamp."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def distinct_events(stream: DataFrame, key: str = "event_id", delay: str = "31 days") -> DataFrame:
    """One event of each id. The log admits late events, so the watermark is as long as a log lives."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, width: str = "1 hour", delay: str = "31 days", slide: str | None = None) -> DataFrame:
    """Events and their values in tumbling or sliding windows, by type; state older than the delay is given up."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def admitted(stream: DataFrame, folder: str) -> DataFrame:
    """All events of a stream, however late: appended as they come, and read as one table in the order (ts, event_id) of each user.

    The log never refuses a late event, so no watermark applies and no state is held; order is made on reading.
    """
    stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{folder}/log").start().awaitTermination()
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/log").withColumn("place", place)


def job_states(stream: DataFrame) -> DataFrame:
    """user_id, events, errors, last_type: counters for each user; the latest event by (ts, event_id) sets the type.

    The state is four numbers and a word a user and is kept for good, as a user may always come back.
    """
    kinds = "user_id long, events long, errors long, last_type string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        events, errors, last, at, number = state.get if state.exists else (0, 0, None, -1, -1)
        for f in frames:
            events, errors = events + len(f), errors + int((f["event_type"] == "error").sum())
            top = f.sort_values(["at", "event_id"]).iloc[-1]
            if (top["at"], top["event_id"]) > (at, number):
                at, number, last = int(top["at"]), int(top["event_id"]), top["event_type"]
        state.update((events, errors, last, at, number))
        yield pd.DataFrame({"user_id": [key[0]], "events": [events], "errors": [errors], "last_type": [last]})

    rows = stream.select("user_id", "event_id", "event_type", F.unix_micros("ts").alias("at"))
    return rows.groupBy("user_id").applyInPandasWithState(step, kinds, "events long, errors long, last_type string, at long, number long", "update", GroupStateTimeout.NoTimeout)


# The states that a job may go to from each state; None is a job that is not known yet.
TRANSITIONS = {
    None: {"queued"}, "queued": {"running", "pausing", "cancelled", "failed"}, "running": {"pausing", "completed", "failed"}, "pausing": {"paused", "cancelled", "failed"},
    "paused": {"running", "cancelled", "failed"}, "completed": set(), "failed": set(), "cancelled": set(),
}


def drained(stream: DataFrame, folder: str, mode: str, once: bool = False) -> DataFrame:
    """All that is available now, run to its end into a Parquet table; with `complete` the last batch is the table.

    `once` takes it as one batch: state with a time to live keeps a stream running that waits for its end.

    A batch that is run again after a failure replaces itself; a folder belongs to one checkpoint.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{'all' if mode == 'complete' else number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(**{"once" if once else "availableNow": True})
    writer.foreachBatch(put).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/out/*")
