"""Global order without a single task: range partitions, local sums, and an offset per partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrel.storage import materialise


def prefix_sums(df: DataFrame, order: str, value: str | None, name: str, before: bool = True) -> DataFrame:
    """df with the running sum of value (1 if None) in the order of a column without ties, as name.

    before: leaves out the row itself.  Partitions by range are written once;
    each then sums locally, and one offset per partition is added.
    """
    pid = F.spark_partition_id().cast("long").alias("__part")
    parted = materialise(df.repartitionByRange(order).select("*", pid), "ordered")
    amount = F.lit(1) if value is None else F.col(value)
    totals = parted.groupBy("__part").agg(F.sum(amount).cast("long").alias("__sum"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("__part", F.coalesce(F.sum("__sum").over(upto), F.lit(0)).alias("__offset"))
    local = F.sum(amount).over(Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = parted.withColumn(name, local.cast("long")).join(offsets, "__part")
    total = F.col(name) + F.col("__offset") - (amount if before else F.lit(0))
    return out.select(*df.columns, total.cast("long").alias(name))


def ordinals(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """df with each row's place from 0 on, in the order of a column without ties."""
    return prefix_sums(df, order, None, name)
