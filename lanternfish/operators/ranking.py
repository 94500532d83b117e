"""Running sums in a global order without one task seeing all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from lanternfish.plans.staging import discard, parts_for, stage

PART_ROWS, SMALL_ROWS = 4 << 20, 1 << 18


def running_sum(df: DataFrame, order: str, weight: str, out: str, by: Sequence[str] = (), small_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with ``out``: sum of ``weight`` over rows up to and with this one in ``order``, within each ``by`` group.

    (by, order) must be distinct.  Rows are range-partitioned and each partition sums its own, so large groups are split
    too.  Only groups that reach over several partitions need what the earlier ones hold: two a partition at most.  Up to
    ``small_rows`` rows in all are summed by one window.
    """
    spark = df.sparkSession
    rows = stage(df, "running-values")  # so that neither the count nor the sampling of ranges computes them twice
    size = rows.count()
    if size <= small_rows:
        return rows.withColumn(out, F.sum(weight).over(Window.partitionBy(*by).orderBy(order)).cast("double"))
    parts = parts_for(spark, size, PART_ROWS)
    placed = stage(rows.repartitionByRange(parts, *by, order).withColumn("__part", F.spark_partition_id()), "running-sum")
    discard(rows)
    summed = placed.withColumn("__run", F.sum(weight).over(Window.partitionBy("__part", *by).orderBy(order)).cast("double"))
    if not by:
        totals = sorted((r["__part"], r["t"]) for r in placed.groupBy("__part").agg(F.sum(weight).alias("t")).collect())  # one row a partition
        offsets = spark.createDataFrame([(part, float(sum(t for _, t in totals[:k]))) for k, (part, _) in enumerate(totals)], "__part int, __base double")
        return summed.join(F.broadcast(offsets), "__part").withColumn(out, F.col("__run") + F.col("__base")).drop("__part", "__run", "__base")
    totals = placed.groupBy("__part", *by).agg(F.sum(weight).cast("double").alias("__t"))
    wide = totals.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    key = F.struct(*by)  # so that null groups meet too
    offsets = totals.join(wide.select(key.alias("__key")), key.eqNullSafe(F.col("__key"))).select(F.col("__part").alias("__p"), "__key", F.coalesce(F.sum("__t").over(earlier), F.lit(0.0)).alias("__base"))
    same = (F.col("__part") == F.col("__p")) & key.eqNullSafe(F.col("__key"))
    return summed.join(F.broadcast(offsets), same, "left").withColumn(out, F.col("__run") + F.coalesce("__base", F.lit(0.0))).drop("__part", "__run", "__p", "__key", "__base")
