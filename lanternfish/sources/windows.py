"""Windowed sources: planning of time windows, bisection of full pages, and a Python data source over a paged search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def day_tiles(since: Column, until: Column, days: int = 1, newest_first: bool = True) -> Column:
    """Array of (start, stop) windows of ``days`` days that cover [since, until), clipped at the far end."""
    n = F.ceil(F.datediff(until, since) / days).cast("int")
    steps = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    if newest_first:
        return F.transform(steps, lambda i: F.struct(F.greatest(since, F.date_sub(until, (i + 1) * days)).alias("start"), F.date_sub(until, i * days).alias("stop")))
    return F.transform(steps, lambda i: F.struct(F.date_add(since, i * days).alias("start"), F.least(until, F.date_add(since, (i + 1) * days)).alias("stop")))


def bisect(count: Callable[[datetime, datetime], int], start: datetime, stop: datetime, cap: int, least: timedelta) -> Iterator[tuple[datetime, datetime, int]]:
    """Windows whose number of hits fits a page: fuller ones are halved until they are shorter than ``least``."""
    todo = [(start, stop)]
    while todo:
        a, b = todo.pop()
        n = count(a, b)
        if n > cap and b - a > least:
            middle = a + (b - a) / 2
            todo += [(a, middle), (middle, b)]
        else:
            yield a, b, n


@dataclass
class Window(InputPartition):
    start: str
    stop: str

    def __init__(self, start: str, stop: str):
        super().__init__((start, stop))
        self.start, self.stop = start, stop


class WindowedSearch(DataSource):
    """A source with one partition for each pending day, read by ``search`` (start, stop) -> rows.

    Options: since, until (dates), skip (comma-separated days of the ledger).  Subclasses give the search and the schema.
    """

    @classmethod
    def name(cls) -> str:
        return "windowed_search"

    def schema(self) -> str:
        return "day string, place int"

    def search(self, start: str, stop: str) -> Iterator[tuple]:
        raise NotImplementedError

    def reader(self, schema) -> DataSourceReader:
        return _WindowReader(self)


class _WindowReader(DataSourceReader):
    def __init__(self, source: WindowedSearch):
        self.source = source

    def partitions(self) -> list[InputPartition]:
        first, last = date.fromisoformat(self.source.options["since"]), date.fromisoformat(self.source.options["until"])
        done = set(filter(None, self.source.options.get("skip", "").split(",")))
        days = [first + timedelta(d) for d in range((last - first).days)]
        return [Window(str(d), str(d + timedelta(1))) for d in reversed(days) if str(d) not in done]

    def read(self, partition: Window) -> Iterator[tuple]:
        yield from self.source.search(partition.start, partition.stop)


def event_windows(events: DataFrame, cap: int, least_seconds: int, time: str = "ts") -> DataFrame:
    """(start, stop, n): the whole time range of a table halved until every window has at most ``cap`` rows or is no longer
    than ``least_seconds``.

    Halving gives a binary tree of windows.  Rows are counted in its smallest cells, counts are added up level by level (one
    aggregation over at most ``depth`` times the cells), and a window stands where its parent is split and it is not:
    all of it equi-joins on (level, cell).  No time is null in a window; an empty table has none.
    """
    seconds = events.select(F.unix_timestamp(F.col(time).cast("timestamp")).alias("t")).where("t IS NOT NULL")
    low, high = seconds.agg(F.min("t"), F.max("t") + 1).first()
    if low is None:
        return events.sparkSession.createDataFrame([], "start long, stop long, n long")
    depth = 0
    while least_seconds << depth < high - low:
        depth += 1
    span = high - low
    edge = lambda level, cell: F.lit(low) + F.expr(f"{span} * {cell} div shiftleft(1L, {level})")
    # the cell whose half-open range holds t: its lower edge is rounded down
    cells = seconds.groupBy(F.expr(f"((t - {low} + 1) * shiftleft(1L, {depth}) - 1) div {span}").alias("cell")).agg(F.count("*").alias("n"))
    counts = cells.select("n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda up: F.call_function("shiftright", F.col("cell"), up))).alias("up", "cell"))
    counts = counts.groupBy((F.lit(depth) - F.col("up")).alias("level"), "cell").agg(F.sum("n").alias("n"))
    split = counts.where((F.col("n") > cap) & (F.col("level") < depth)).select("level", "cell")
    halves = split.select((F.col("level") + 1).alias("level"), F.explode(F.array(F.col("cell") * 2, F.col("cell") * 2 + 1)).alias("cell"))
    root = events.sparkSession.createDataFrame([(0, 0)], "level int, cell long")
    windows = root.union(halves).join(split, ["level", "cell"], "left_anti").join(counts, ["level", "cell"], "left")
    return windows.select(edge("level", "cell").alias("start"), edge("level", "(cell + 1)").alias("stop"), F.coalesce("n", F.lit(0)).alias("n"))


def register(spark: SparkSession, source: type[WindowedSearch]) -> None:
    spark.dataSource.register(source)
