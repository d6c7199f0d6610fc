"""Running sums over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.llm import scratch


def sums_before(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: str, to: str, descending: bool = False) -> DataFrame:
    """`df` with `to`: the sum of `value` over the rows of the same group that come before a row.

    Rows come by `bucket` (ascending, or descending) and within it by `order`. A bucket is sorted in one task, the
    table of one row for each group and bucket in another; choose buckets so that both are small. `df` is read twice.
    """
    keys = [*group, bucket]
    by = F.col(bucket).desc() if descending else F.col(bucket)
    before = Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    heads = df.groupBy(*keys).agg(F.sum(value).alias("_in_bucket")).withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0))).drop("_in_bucket")
    heads = scratch.written(heads, "heads")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(heads, keys).withColumn(to, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_before")
