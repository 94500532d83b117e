"""Table functions: Python over the ordered rows of a partition, callable from SQL."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf


class _Runs:
    """Of rows (author, day) in order of day: each run of days that follow one another, repeats bridged."""

    def __init__(self):
        self.author = self.first = self.last = None
        self.days = 0

    def eval(self, row: Row) -> Iterator[tuple]:
        day: date = row["day"]
        if self.days and (day - self.last).days <= 1:
            self.days += day != self.last
        else:
            yield from self.terminate()
            self.first, self.days = day, 1
        self.author, self.last = row["author"], day

    def terminate(self) -> Iterator[tuple]:
        if self.days:
            yield self.author, self.first, self.last, self.days


def register(spark: SparkSession) -> None:
    """Makes ``day_runs(TABLE(t) PARTITION BY author ORDER BY day)`` known to SQL; it holds one run at a time."""
    spark.udtf.register("day_runs", udtf(_Runs, returnType="author string, first date, last date, days int"))
