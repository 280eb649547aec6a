"""Jobs with keyed state that goes by itself: a state machine whose finished jobs leave, and a buffer of what was last heard."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import TRANSITIONS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Minutes that a finished job is remembered, so that requests that come after its end are refused, and that samples are kept.
REMEMBERED = KEPT = 10
#: Samples that one value of the state holds.
HEARD = 8192
ENDS = {s for s, after in TRANSITIONS.items() if not after}


class Machine(StatefulProcessor):
    """An open job's state is kept until it ends; an ended one's for some minutes by its time to live."""

    def __init__(self, minutes: float):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "state string")
        self.done = handle.getValueState("done", "state string", int(self.minutes * 60_000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        now = self.open.get()[0] if self.open.exists() else self.done.get()[0] if self.done.exists() else None
        was, batch = now, pd.concat(list(rows)).sort_values(["at", "event_id"])  # what one batch has of one job
        states, legal = [], []
        for wanted in batch["wanted"].tolist():
            legal.append(wanted in TRANSITIONS[now])
            now = wanted if legal[-1] else now
            states.append(now)
        if now != was:
            if now in ENDS:
                self.open.clear()
                self.done.update((now,))
            else:
                self.open.update((now,))
        yield pd.DataFrame({"job": key[0], "event_id": batch["event_id"], "wanted": batch["wanted"], "state": states, "legal": legal})

    def close(self) -> None:
        pass


def machine(stream: DataFrame, minutes: float = REMEMBERED) -> DataFrame:
    """job, event_id, wanted, state, legal of every request (job, event_id, at, wanted), in the order (at, event_id) of a batch.

    State: one row for each open job, and for some minutes one for each that has ended. A request
    for a job that ended longer ago is one for a job that is not known.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy("job").transformWithStateInPandas(Machine(minutes), "job long, event_id long, wanted string, state string, legal boolean", "append", "processingTime")


class Buffer(StatefulProcessor):
    """The samples of the last minutes. What was heard at once is kept as arrays of at most HEARD samples with one time to live, as each access to the state is a call out of the worker."""

    def __init__(self, minutes: float):
        self.minutes = minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.samples = handle.getMapState("samples", "heard long", "at array<bigint>, done array<double>", int(self.minutes * 60_000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: object) -> Iterator[pd.DataFrame]:
        new = pd.concat([frame.groupby("at")["done"].max() for frame in rows])
        new = new.groupby(level=0).max()
        held, last = [new], -1
        for (number,), (at, done) in self.samples.iterator():
            last = max(last, number)
            held.append(pd.Series(list(done), index=list(at), dtype=float))
        for k, lo in enumerate(range(0, len(new), HEARD)):
            part = new.iloc[lo : lo + HEARD]
            self.samples.updateValue((last + 1 + k,), ([int(t) for t in part.index], [float(v) for v in part]))
        kept = pd.concat(held).groupby(level=0).max()
        (first, a), (last, b) = ((kept.index[i], kept.iloc[i]) for i in (0, -1))
        yield pd.DataFrame({"job": [key[0]], "samples": [len(kept)], "rate": [(b - a) / (last - first) * 1e6 if last > first else None]})

    def close(self) -> None:
        pass


def rates(stream: DataFrame, minutes: float = KEPT) -> DataFrame:
    """job, samples, rate (a second) after every batch, over the samples (job, at in microseconds, done) heard in the last minutes.

    A sample is its instant's greatest `done`; samples leave the state by themselves.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return stream.groupBy("job").transformWithStateInPandas(Buffer(minutes), "job long, samples long, rate double", "update", "processingTime")


def state_rows(spark: object, checkpoint: str, variable: str) -> DataFrame:
    """What a stopped query holds in one state variable: key and value."""
    return spark.read.format("statestore").option("stateVarName", variable).load(checkpoint).select(F.col("key"), F.col("value"))
