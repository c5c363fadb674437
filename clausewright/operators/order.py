"""Positions in a total order without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.session import cut


def global_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df + (position): 1, 2, ... in the order, which must be total.

    Rows are parted by ranges of the order and written; every part numbers its
    own rows after the counts of the parts before it.
    """
    parted = cut(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    counts = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__c"))  # one row per part
    before = counts.select("__part", (F.sum("__c").over(Window.orderBy("__part")) - F.col("__c")).alias("__before"))
    n = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parted.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + n).cast("long")).drop("__part", "__before")


def page_of(df: DataFrame, order: list[Column], page: int, size: int = 20, name: str = "position") -> DataFrame:
    """The rows of one page of a total order with their position; a page past the last is the last, before the first the first."""
    last = max(1, -(-df.count() // size))
    page = min(max(page, 1), last)
    top = df.orderBy(*order).limit(page * size)
    return top.withColumn(name, F.row_number().over(Window.orderBy(*order))).where(F.col(name) > (page - 1) * size)


def fixed_batches(df: DataFrame, order: list[Column], size: int) -> DataFrame:
    """df + (batch, position): batches of `size` rows in order."""
    p = global_position(df, order)
    return p.withColumn("batch", F.floor((F.col("position") - 1) / size))
