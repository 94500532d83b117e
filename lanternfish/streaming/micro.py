"""Polling loops as Structured Streaming: everything that is there now, then stop; state in checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lanternfish.plans.staging import fresh_path


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A file stream over one table; its schema is read from the table.

    All files that are there form one batch: their order says nothing of their times, so with a batch a file the watermark
    of the first would drop rows of the next as late.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    reader = spark.readStream.schema(schema)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", name).parquet(folder)


def _is_folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def drain(frame: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run the stream over what is there, writing each micro-batch under its number; gives what the sink holds.

    A batch that is delivered again overwrites its own folder, so the sink is idempotent.
    """
    spark = frame.sparkSession
    out = fresh_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = frame.writeStream.outputMode(mode).option("checkpointLocation", fresh_path(spark, f"{name}-state")).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema.add("batch", "long")).option("basePath", out).parquet(out)


def as_uri(path: str) -> str:
    """A path with its scheme; one without is local."""
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def daily_counts(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts for each day and type; a day is final when the watermark has passed it."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def first_deliveries(events: DataFrame, key: str = "event_id", late: str = "2 days") -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
