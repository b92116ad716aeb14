"""Places in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflux.plans.cluster import durable


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with place (from 0, in the given order) and n_rows.

    Rows are range-sorted; a partition adds the number of rows before it, which takes one row for each partition. The
    sorted rows are made durable, for a second sort could cut its ranges elsewhere. Rows that are equal in the order
    have places next to one another. df is made durable as well, for the sort reads it twice: to cut ranges, and to sort.
    """
    ordered = durable(durable(df).orderBy(*order).withColumn("_part", F.spark_partition_id()))
    sizes = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n_rows", F.sum("_n").over(Window.partitionBy())).drop("_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ordered.withColumn("_i", own).join(F.broadcast(sizes), "_part").withColumn("place", F.col("_i") + F.col("_ahead")).drop("_part", "_i", "_ahead")
