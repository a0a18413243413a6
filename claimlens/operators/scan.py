"""Running minima along an order within keys, however many rows a key has.

A window over a key puts all its rows into one task. Here rows are dealt by ranges
of (key, order), so a key with many rows has several partitions; a window runs
within each, and what the earlier partitions of the same key give is carried in.
Of a partition only the first key can begin in an earlier one, so there are fewer
carries than partitions, and they are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimlens.session import materialize


def laid_out(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows, written by ranges of key and order, with the number of their range (_range). order must leave few ties."""
    return materialize(rows.repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "ranges")


def preceding_min(laid: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds name: the least value (nulls don't count) of the rows of the same key that come before in order."""
    rows = laid.withColumn(name, value)
    before = Window.partitionBy("_range", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*key, "_range").agg(F.min(name).alias("_carry"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carries = totals.withColumn("_carry", F.min("_carry").over(earlier)).where("_carry is not null")
    out = rows.withColumn(name, F.min(name).over(before)).join(F.broadcast(carries), [*key, "_range"], "left")
    # least() passes over nulls, but can't order structs
    smaller = F.when(F.col(name).isNull() | (F.col("_carry") < F.col(name)), F.col("_carry"))
    return out.withColumn(name, F.coalesce(smaller, F.col(name))).drop("_carry").select(*laid.columns, name)
