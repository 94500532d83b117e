"""Feeds that are paged by cursors, as Python data sources: for tables, with filters pushed to the pages, and for streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.types import StructType

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass
class Shelf(InputPartition):
    """One row group of one file, or all of them for one actor."""

    actor: int | None
    groups: list[tuple[str, int]]

    def __init__(self, actor: int | None, groups: list[tuple[str, int]]):
        super().__init__((actor, groups))
        self.actor, self.groups = actor, groups


class ParquetFeed(DataSource):
    """The rows of a Parquet table as an author feed would give them: page by page, each page naming the next one's cursor.

    Options: path, actor (name of a column of whole numbers), since (of a column that orders rows, a time for instance), page (rows of a page, 1,000 unless set).  A filter on actors makes one
    partition for each of them; without one a partition is a row group.  A lower bound of ``since`` is taken into the pages:
    row groups that end before it are not read.  Spark reads it as a table only where filters are pushed to Python sources
    (``pushing``).  The path must be one that pyarrow's file systems open.
    """

    @classmethod
    def name(cls) -> str:
        return "parquet_feed"

    def _where(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.options["path"]) if "://" in self.options["path"] or self.options["path"].startswith("file:") else (fs.LocalFileSystem(), self.options["path"])

    def files(self) -> list[str]:
        system, path = self._where()
        info = system.get_file_info(path)
        if info.type == fs.FileType.File:
            return [path]
        found = system.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".parquet"))

    def open(self, file: str) -> pq.ParquetFile:
        return pq.ParquetFile(self._where()[0].open_input_file(file))

    def groups(self) -> list[tuple[str, int]]:
        """All row groups, in order of file: one small pair each, read from the files' footers."""
        return [(f, g) for f in self.files() for g in range(self.open(f).num_row_groups)]

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(self.open(self.files()[0]).schema_arrow)

    def page(self, shelf: Shelf, cursor: tuple[int, int] | None, since, columns: list[str]) -> tuple[pa.RecordBatch | None, tuple[int, int] | None]:
        """The page at a cursor (row group, row), and the next cursor; no cursor is the first page, and none comes after the last."""
        k, row = cursor or (0, 0)
        if k >= len(shelf.groups):
            return None, None
        file, group = shelf.groups[k]
        held = self.open(file)
        at = held.schema_arrow.names.index(self.options["since"])
        stats = held.metadata.row_group(group).column(at).statistics
        if since is not None and stats is not None and stats.has_min_max and _before(stats.max, since):
            return None, (k + 1, 0)
        table = held.read_row_group(group, columns=columns)
        keep = pc.greater_equal(table[self.options["since"]], pa.scalar(since, table.schema.field(self.options["since"]).type)) if since is not None else None
        if shelf.actor is not None:
            own = pc.equal(table[self.options["actor"]], shelf.actor)
            keep = own if keep is None else pc.and_kleene(keep, own)
        rows = table if keep is None else table.filter(keep)
        size = int(self.options.get("page", 1000))
        after = (k, row + size) if row + size < rows.num_rows else (k + 1, 0)
        batches = rows.slice(row, size).combine_chunks().to_batches()
        return (batches[0] if batches else None), after

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FeedReader(self, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _FeedStream(self, schema)


def _before(a, b) -> bool:
    """Whether a is less than b; times with and without a zone are not compared."""
    try:
        return a < b
    except TypeError:
        return False


def _pages(source: ParquetFeed, shelf: Shelf, since, columns: list[str]) -> Iterator[pa.RecordBatch]:
    cursor = (0, 0)
    while cursor is not None:
        batch, cursor = source.page(shelf, cursor, since, columns)
        if batch is not None:
            yield batch.select(columns)


class _FeedReader(DataSourceReader):
    def __init__(self, source: ParquetFeed, schema: StructType):
        self.source, self.columns, self.actors, self.since = source, schema.names, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and lists of actors, and lower bounds of the time; the others are left to Spark."""
        actor, since = (self.source.options[c] for c in ("actor", "since"))
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == (actor,) and self.actors is None:
                self.actors = sorted({f.value} if isinstance(f, EqualTo) else set(f.value))
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == (since,) and self.since is None:
                self.since = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        groups = self.source.groups()
        return [Shelf(None, [g]) for g in groups] if self.actors is None else [Shelf(a, groups) for a in self.actors]

    def read(self, partition: Shelf) -> Iterator[pa.RecordBatch]:
        yield from _pages(self.source, partition, self.since, self.columns)


class _FeedStream(DataSourceStreamReader):
    """Offsets are numbers of row groups that have been there."""

    def __init__(self, source: ParquetFeed, schema: StructType):
        self.source, self.columns = source, schema.names

    def initialOffset(self) -> dict:
        return {"groups": 0}

    def latestOffset(self) -> dict:
        return {"groups": len(self.source.groups())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Shelf(None, [g]) for g in self.source.groups()[start["groups"] : end["groups"]]]

    def read(self, partition: Shelf) -> Iterator[pa.RecordBatch]:
        yield from _pages(self.source, partition, None, self.columns)


@contextmanager
def pushing(spark: SparkSession) -> Iterator[None]:
    """Filters reach Python sources while plans are made inside; the session's own setting comes back."""
    before = spark.conf.get(PUSHDOWN)
    spark.conf.set(PUSHDOWN, "true")
    try:
        yield
    finally:
        spark.conf.set(PUSHDOWN, before)
