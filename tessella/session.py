"""Session and table loading."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(name: str = "tessella", **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC, ANSI) and adaptive execution."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; timestamps without zone become UTC timestamps, once."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset a local master gets a temporary folder; on a cluster no folder of one machine would do.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


#: Folders of tables written in this process and not released yet.
_written: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, so that loops keep their plans short and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by their keys in as many parts as shuffles have, for work that costs far more than the rows' bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def dealt_by_size(rows: DataFrame, *keys: str, most: int = 1 << 17) -> DataFrame:
    """dealt() in more parts where there are many rows, so that what one task sorts stays about `most` rows (or those of one key)."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // most))
    return rows.repartition(parts, *keys)


def in_batches(rows: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType, most: int = 1 << 15) -> DataFrame:
    """What `run` makes of whole groups (keys), many at a time: frames of about `most` rows, sorted by the keys, with each row's group in `_group` (from 0).

    For groups that are bounded and so small that a call for each would cost more than its work. A group is held in one task.
    """

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            if sum(map(len, held)) >= most:
                # the last group may go on in the next frame
                whole = numbered(held)
                last = int(whole["_group"].searchsorted(whole["_group"].iloc[-1])) if len(whole) else 0
                held = [whole.iloc[last:].drop(columns="_group")]
                if last:
                    yield run(whole.iloc[:last].reset_index(drop=True))
        if held and sum(map(len, held)):
            yield run(numbered(held))

    def numbered(frames: list[pd.DataFrame]) -> pd.DataFrame:
        whole = pd.concat(frames, ignore_index=True)
        new = np.zeros(len(whole), bool)
        for k in keys:
            before = whole[k].shift()
            new |= ((whole[k] != before) & ~(whole[k].isna() & before.isna())).to_numpy(bool)
        new[:1] = False
        return whole.assign(_group=np.cumsum(new))

    return dealt(rows, *keys).sortWithinPartitions(*keys).mapInPandas(each, schema)


def by_size(rows: DataFrame, keys: list[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups (keys) of at most `most` rows, rows of larger ones or None); rows with a null key are in neither.

    The keys of larger groups are broadcast: one in `most` rows at most.
    """
    known = rows.where(functools.reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    large = written(known.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select(*keys), "large-groups")
    if large.isEmpty():
        return known, None
    return known.join(F.broadcast(large), keys, "left_anti"), known.join(F.broadcast(large), keys, "left_semi")


def named(*values: str) -> Column:
    """Numbers as one text, to deal rows by: doubles as keys are normalized in joins and groups, for which rows already dealt by them are sent again."""
    return F.concat_ws(" ", *[F.col(v).cast("string") for v in values])


#: So many rows that are alike make one row of a join: all that one row makes is held until it is passed on.
PIECE = 16


def pieces(rows: DataFrame, keys: list[str], value: str, most: int = PIECE) -> DataFrame:
    """keys and `values`: arrays of structs of at most `most` values. Rows that are dealt by the keys stay where they are; a key's rows are put in order in one task."""
    numbered = rows.select(*keys, value, F.expr(f"(row_number() over (partition by {', '.join(keys)} order by {value}) - 1) div {most}").alias("_piece"))
    return numbered.groupBy(*keys, "_piece").agg(F.collect_list(F.struct(value)).alias("values")).drop("_piece")


def once(rows: DataFrame, kept: list[str], *named: Column) -> DataFrame:
    """The columns `kept` and the named ones, whose values are computed once a row: filters on them that follow don't repeat what they are made of."""
    return rows.select(*kept, F.inline(F.array(F.struct(*named))))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def dropped(df: DataFrame) -> None:
    """Deletes the table of one written() that nothing reads any more."""
    files = df.inputFiles()
    for path in [p for p in _written if any(p.rsplit("/", 1)[1] in f for f in files)]:
        drop_folder(df.sparkSession, path)
        _written.remove(path)


def tables_written() -> int:
    """How many tables release() would keep if it kept all there are."""
    return len(_written)


def release(spark: SparkSession, kept: int = 0) -> None:
    """Deletes the tables of written() but the first `kept`; no DataFrame that reads them may be used again."""
    while len(_written) > kept:
        drop_folder(spark, _written.pop())
