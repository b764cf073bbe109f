"""Ranks and running sums over a whole table, by ranges instead of one sorted task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wartalens.session import stage


def running_sum(table: DataFrame, order: list[Column], weight: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over all rows before a row in ``order``, a total order of the rows.

    Rows go to as many ranges as there are shuffle partitions and are written with their range number;
    sums run within a range, and a range starts at the sum of the totals before it. One task sees the
    totals, one row per range, never the rows. A weight of 1 gives row numbers from 0.
    """
    source = stage(table.withColumn("_weight", weight.cast("long")), "unranked")
    ranges = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(source.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy("_range").agg(F.sum("_weight").alias("_total")).select(
        "_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0))).join(F.broadcast(bases), "_range")
    return summed.select(*table.columns, (F.col("_base") + F.col("_inside")).alias(name))
