"""Streams in many batches: state by key, and a restart from the checkpoint in mid-stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lanternfish.plans.staging import fresh_path

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_files(table: DataFrame, order: str, files: int) -> str:
    """A folder of so many files that hold ranges of ``order``."""
    folder = fresh_path(table.sparkSession, "arrivals")
    table.repartitionByRange(files, order).write.option("maxRecordsPerFile", 0).parquet(folder)
    return folder


def by_file(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """A stream over the folder that takes ``files`` files a batch."""
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(folder)


class Stopped(Exception):
    """Raised in place of a batch to stop a stream where it stands."""


def drained_again(frame: DataFrame, name: str, mode: str = "append", stop_after: int | None = None) -> DataFrame:
    """What the sink holds (with ``batch``) after the stream has read all there is, batch by batch.

    With ``stop_after`` the stream breaks off when it is to write the batch after so many, as a lost driver would, and is started
    again from its checkpoint: batches that were written stay, the broken one is read again.
    """
    spark = frame.sparkSession
    out, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)  # state by key wants it; set for these queries only

    def start(most: int | None) -> None:
        def write(batch: DataFrame, number: int) -> None:
            if most is not None and number >= most:
                raise Stopped
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = frame.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(write).trigger(availableNow=True).start()
        query.awaitTermination()

    try:
        if stop_after is not None:
            try:
                start(stop_after)
            except Exception as error:
                if Stopped.__name__ not in str(error):
                    raise
        start(None)
    finally:
        spark.conf.set(PROVIDER, before)
    return spark.read.schema(frame.schema.add("batch", "long")).option("basePath", out).parquet(out)


_STATE = StructType([StructField("n", LongType()), StructField("total", DoubleType()), StructField("latest", LongType())])


class _Totals(StatefulProcessor):
    """Of each key the number of rows, the sum of values and the latest time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("totals", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, total, latest = self.known.get() if self.known.exists() else (0, 0.0, None)
        for batch in rows:
            n, total = n + len(batch), total + float(batch["value"].sum())
            high = int(batch["micros"].max())
            latest = high if latest is None else max(latest, high)
        self.known.update((n, total, latest))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total], "latest": [latest]})

    def close(self) -> None:
        pass


def user_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total, latest): what is known of each user after every batch that has rows of theirs."""
    rows = events.select("user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Totals(), outputStructType="user_id long, n long, total double, latest long", outputMode="Update", timeMode="None")
