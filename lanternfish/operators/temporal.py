"""Joins and windows by time: the last row before each, overlapping intervals, sessions between gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lanternfish.plans.staging import parts_for, stage

PART_ROWS = 1 << 20


def asof_join(left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str, tie: str, out: str = "found") -> DataFrame:
    """``left`` with ``out``: the row of ``right`` (a struct) of the same ``by`` with the latest time that is not after the left row's,
    ties to the largest ``tie``; null where there is none, or where key or time is null.

    Both sides stand in one order of time, cut into ranges, so a key with most of the rows is cut too.  In each range the last
    right row is carried forward; what earlier ranges hold reaches a range through one row a key and range, and only of keys
    that reach over several, three a range at most.
    """
    spark = left.sparkSession
    one = left.select(F.col(by).alias("__by"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.struct(*left.columns).alias("__l"))
    two = right.where(F.col(by).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(by).alias("__by"), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.struct(*right.columns).alias("__r"))
    rows = stage(one.unionByName(two, allowMissingColumns=True), "asof-rows")
    order = ["__t", "__side", "__tie"]
    placed = stage(rows.repartitionByRange(parts_for(spark, rows.count(), PART_ROWS), "__by", *order).withColumn("__part", F.spark_partition_id()), "asof-placed")
    w = Window.partitionBy("__part", "__by").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = placed.withColumn("__here", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    ends = placed.where("__by IS NOT NULL").groupBy("__part", "__by").agg(F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct("__t", "__tie"))).alias("__end"))
    wide = ends.groupBy("__by").agg(F.count("*").alias("n")).where("n > 1").select("__by")
    earlier = Window.partitionBy("__by").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(wide, "__by").select("__part", "__by", F.last("__end", ignorenulls=True).over(earlier).alias("__before"))
    found = here.join(F.broadcast(carried), ["__part", "__by"], "left")
    known = F.when(F.col("__t").isNotNull(), F.coalesce("__here", "__before"))
    return found.select("__l.*", known.alias(out))


def _cells(start: Column, stop: Column, levels: int) -> Column:
    """The largest aligned cells (level, cell) of a binary tree of time that together are the half-open interval, two a level at most."""
    def at(k: Column) -> Column:
        low = F.call_function("shiftright", start + F.call_function("shiftleft", F.lit(1).cast("long"), k) - 1, k)
        high = F.call_function("shiftright", stop, k)
        cell = lambda c: F.struct(k.alias("level"), c.alias("cell"))
        inside = low < high
        return F.array(F.when(inside & (low.bitwiseAND(F.lit(1)) == 1), cell(low)), F.when(inside & (high.bitwiseAND(F.lit(1)) == 1), cell(high - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at)), lambda c: c.isNotNull())


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: str, levels: int) -> DataFrame:
    """(point, interval) of the points (by, point, t) that lie in half-open intervals (by, interval, start, stop) of whole numbers.

    An interval is a few cells of a binary tree, and a point lies in one cell of each level, so the pairs are an equi-join
    that gives each once; a key with many rows is spread over its cells.
    """
    p = points.select(by, "point", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.call_function("shiftright", F.col("t"), k))).alias("level", "cell"))
    i = intervals.select(by, "interval", F.explode(_cells(F.col("start"), F.col("stop"), levels)).alias("c")).select(by, "interval", "c.*")
    return p.join(i, [by, "level", "cell"]).select("point", "interval")


def overlapping(left: DataFrame, right: DataFrame, by: str, key: str, start: str, stop: str) -> DataFrame:
    """(left_key, right_key) of all pairs of one ``by`` whose half-open intervals of whole numbers overlap.

    Of two that overlap one begins in the other.  Empty intervals and rows with a null overlap nothing.
    """
    tidy = lambda df: df.select(by, F.col(key).alias("key"), F.col(start).cast("long").alias("start"), F.col(stop).cast("long").alias("stop")).where(F.col("start") < F.col("stop"))
    a, b = tidy(left), tidy(right)
    longest = a.union(b).agg(F.max(F.col("stop") - F.col("start"))).first()[0] or 1
    levels = int(longest).bit_length()
    points = lambda df: df.select(by, F.col("key").alias("point"), F.col("start").alias("t"))
    ranges = lambda df, later: df.select(by, F.col("key").alias("interval"), (F.col("start") + later).alias("start"), "stop")
    in_left = points_in_intervals(points(b), ranges(a, 0), by, levels).select(F.col("interval").alias("left_key"), F.col("point").alias("right_key"))
    in_right = points_in_intervals(points(a), ranges(b, 1), by, levels).select(F.col("point").alias("left_key"), F.col("interval").alias("right_key"))
    return in_left.union(in_right)


def sessions(events: DataFrame, by: str, time: str, gap: str) -> DataFrame:
    """(by, start, stop, n): runs of rows of one ``by`` without a pause longer than ``gap``; ``stop`` is the last time plus the gap.

    For tables and for streams, where a session is final when the watermark has passed its stop.  Rows of a key are merged
    in the tasks before they are shuffled only where the session sets ``spark.sql.sessionWindow.merge.sessions.in.local.partition``.
    """
    return events.groupBy(by, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
