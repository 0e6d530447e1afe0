"""Numbering of a whole ordered table without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from archivolt.shared import cut


def numbered(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Rows with their place (from 1) in the order.

    The table is split by ranges of the order and written to the shared
    folder, so the ranges stay the same; rows are numbered inside each, and the
    sizes of the ranges before it are added. ``order`` has to be total for the
    numbers to be the same each time.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part")) - F.col("__n")).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.withColumn(name, inside).join(before, "__part").withColumn(name, (F.col(name) + F.col("__before")).cast("bigint")).drop("__part", "__before")
