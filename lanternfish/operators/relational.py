"""Catalogue operators: idempotent writes, first-wins dedupe, pending work, ranked and faceted views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of every key in the given order; the order must name a tie-break."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``target`` with the rows of ``batch`` whose key it does not hold, the first of each; replaying a batch adds nothing."""
    fresh = dedupe_first(batch, keys, order).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``target`` with rows replaced by the last of ``batch`` with the same key, and new keys added."""
    w = Window.partitionBy(*keys).orderBy(*order)
    last = batch.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")
    return target.join(last.select(*keys), list(keys), "left_anti").unionByName(last.select(*target.columns))


def update_by_key(target: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New non-null values where a change has the key (at most one a key), old ones elsewhere."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return target.join(new, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns])


def fill_missing(target: DataFrame, found: DataFrame, key: str, columns: Sequence[str], done: str) -> DataFrame:
    """Old values stay, nulls are filled from ``found``; ``done`` marks rows that it has."""
    new = found.select(key, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__seen"))
    cols = [F.coalesce(c, f"__{c}").alias(c) if c in columns else F.col(c) for c in target.columns if c != done]
    return target.join(new, key, "left").select(*cols, (F.coalesce(F.col(done), F.lit(False)) | F.coalesce("__seen", F.lit(False))).alias(done))


def pending(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` whose key the ledger does not hold."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def priority_queue(items: DataFrame, key: str, urgent: Column, latest: str) -> DataFrame:
    """(key, priority, latest): one row a key, urgent ones first, then the latest."""
    return items.groupBy(key).agg(F.max(F.when(urgent, 1).otherwise(0)).alias("priority"), F.max(latest).alias("latest")).orderBy(F.desc("priority"), F.desc("latest"), key)


def union_distinct_ordered(parts: Sequence[DataFrame], column: str) -> DataFrame:
    """(column, place): distinct values in order of their first appearance over the parts; each part is ordered by ``place``."""
    out = None
    for k, p in enumerate(parts):
        rows = p.select(column, F.struct(F.lit(k).alias("part"), F.col("place").cast("long").alias("place")).alias("at"))
        out = rows if out is None else out.unionByName(rows)
    return out.groupBy(column).agg(F.min("at").alias("at")).select(column, F.col("at.part").alias("part"), F.col("at.place").alias("place"))


def top_distinct(df: DataFrame, key: str, order: Sequence[Column], k: int) -> DataFrame:
    """The ``k`` first rows in the given order with distinct keys."""
    return dedupe_first(df, [key], order).orderBy(*order).limit(k)


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = 120) -> DataFrame:
    """Page ``number`` (from 0) of the ordered rows."""
    return df.orderBy(*order).offset(number * size).limit(size)


def facets(df: DataFrame, year: str | None = None, labels: Sequence | None = None, needle: str | None = None, date: str = "date", label: str = "label", text: str = "text") -> DataFrame:
    """Rows of a year, with one of the labels, whose text holds the needle, whatever its case; None asks for nothing."""
    if year:
        df = df.where(F.col(date).startswith(year))
    if labels:
        df = df.where(F.col(label).isin(list(labels)))
    if needle:
        df = df.where(F.contains(F.lower(text), F.lit(needle.lower())))
    return df


def fold(df: DataFrame, family: str, order: Sequence[Column]) -> DataFrame:
    """One row for each family, the first in the current order."""
    return dedupe_first(df, [family], order)


def siblings(df: DataFrame, family: str, key: str, order: Sequence[Column], k: int = 12) -> DataFrame:
    """(key, sibling, place): for every row the first ``k`` of its family; families are cut to ``k`` before they are joined, and
    one that holds many rows is dealt over several tasks.  Rows without a family have no siblings."""
    w = Window.partitionBy(family).orderBy(*order)
    first = df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).groupBy(family).agg(
        F.collect_list(F.struct(F.col(key).alias("sibling"), "place")).alias("__first"))  # ``k`` at most
    return hot_join(df.select(family, key), first, family).select(key, F.explode("__first").alias("s")).select(key, "s.*")


def snowball(items: DataFrame, author: str, handle: Column, invalid: str) -> DataFrame:
    """(author): distinct authors of kept rows and handles in their links, without the invalid one."""
    return items.select(F.explode(F.array(F.col(author), handle)).alias("author")).where((F.col("author") != "") & (F.col("author") != invalid)).distinct()


def longest_runs(df: DataFrame, keys: Sequence[str], position: str, gap: int = 1) -> DataFrame:
    """(keys, longest): length of the longest run of positions, bridging gaps of up to ``gap`` steps."""
    w = Window.partitionBy(*keys).orderBy(position)
    rows = df.select(*keys, position).distinct().withColumn("__new", F.when(F.col(position) - F.lag(position).over(w) <= gap, 0).otherwise(1))
    rows = rows.withColumn("__run", F.sum("__new").over(w))
    runs = rows.groupBy(*keys, "__run").agg((F.max(position) - F.min(position) + 1).alias("span"))
    return runs.groupBy(*keys).agg(F.max("span").alias("longest"))


HOT_ROWS = 50_000


def hot_join(left: DataFrame, right: DataFrame, key: str, hot_rows: int | None = None) -> DataFrame:
    """Left join of many rows with the one row of their ``key``, where a few keys may hold most rows.

    A key with more rows than a shuffle partition's share (and than ``hot_rows``, ``HOT_ROWS`` if none are named) is dealt over several partitions, and its
    row on the right is repeated for each.  There are no more such keys than partitions, so their table is broadcast.  Rows
    with a null key stay without a match.
    """
    share = max(hot_rows or HOT_ROWS, left.count() // int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salts = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > share).select(
        F.col(key).alias("__hot"), F.ceil(F.col("count") / share).cast("int").alias("__salts"))
    hot = F.broadcast(salts)
    dealt = left.join(hot, left[key] == hot["__hot"], "left").withColumn("__salt", F.floor(F.rand(7) * F.coalesce("__salts", F.lit(1))).cast("int")).drop("__hot", "__salts")
    spread = right.join(hot, right[key] == hot["__hot"], "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__hot", "__salts")
    return dealt.join(spread, [key, "__salt"], "left").drop("__salt")
