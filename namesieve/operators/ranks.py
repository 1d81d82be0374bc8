"""Positions and running totals over a total order, without a task that sees all rows.

Rows are range-partitioned by the order and sorted inside; the totals of the partitions, one row
each, give every partition its offset.  The result depends on the order only, not on how the rows
were partitioned before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from namesieve.session import checkpointed

PART, HERE = "_range_part", "_range_sum"


def running_total(df: DataFrame, value: Column, *order: str | Column, out: str = "total") -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and including each row.

    ``order`` has to be unique: rows equal in it may come in any order.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once, so both passes see the same partitions.
    placed = checkpointed(ranged.withColumn(PART, F.spark_partition_id()))
    totals = placed.groupBy(PART).agg(F.sum(value).alias(HERE))
    # One row for each partition.
    before = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(PART, F.coalesce(F.sum(HERE).over(before), F.lit(0)).alias(HERE))
    inside = W.partitionBy(PART).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumn(out, F.sum(value).over(inside))
    return summed.join(F.broadcast(offsets), PART).withColumn(out, F.col(out) + F.col(HERE)).drop(PART, HERE)


def dense_positions(df: DataFrame, *order: str | Column, out: str = "position") -> DataFrame:
    """Adds the position of each row in the order, from 0, without gaps."""
    counted = running_total(df, F.lit(1).cast("long"), *order, out=out)
    return counted.withColumn(out, F.col(out) - 1)
