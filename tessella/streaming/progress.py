"""Counts by stage beside a result: observed while the rows pass, not counted again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

PREFIX = "stage-"


def stage(df: DataFrame, name: str, **more: F.Column) -> DataFrame:
    """df, which reports its number of rows (and other aggregates) under a stage's name whenever it is run."""
    return df.observe(PREFIX + name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in more.items()])


class Progress(StreamingQueryListener):
    """Writes the stages' counts of every batch as a small JSON file; a batch that is run again replaces its own."""

    def __init__(self, spark: SparkSession, folder: str, query: str):
        super().__init__()
        self.spark, self.folder, self.query = spark, folder, query

    def onQueryStarted(self, event: object) -> None:
        pass

    def onQueryProgress(self, event: object) -> None:
        p = event.progress
        if p.name != self.query:
            return
        lines = [json.dumps({"batch": p.batchId, "stage": k.removeprefix(PREFIX), **v.asDict()}) for k, v in p.observedMetrics.items() if k.startswith(PREFIX)]
        if lines:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch-{p.batchId}.json")
            stream = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
            stream.write(bytearray("\n".join(lines).encode()))
            stream.close()

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: object) -> None:
        pass


def run(stream: DataFrame, folder: str, query: str) -> tuple[DataFrame, DataFrame]:
    """(result, counts): a stream run to the end of what is there; counts are (batch, stage, rows) as reported on the way."""
    spark = stream.sparkSession
    listener = Progress(spark, f"{folder}/progress", query)
    spark.streams.addListener(listener)
    try:
        writer = stream.writeStream.queryName(query).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
        writer.format("parquet").option("path", f"{folder}/result").start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    counts = spark.read.schema("batch long, stage string, rows long").json(f"{folder}/progress")
    return spark.read.schema(stream.schema).parquet(f"{folder}/result"), counts


def written_with_counts(df: DataFrame, path: str, stages: dict[str, Observation]) -> DataFrame:
    """Writes a batch result and gives (stage, rows) of the observations in its plan."""
    df.write.parquet(path)
    return df.sparkSession.createDataFrame([(k, o.get["rows"]) for k, o in stages.items()], "stage string, rows long")
