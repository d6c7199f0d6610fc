"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kontor.operators.state import cut


def numbered(df: DataFrame, to: str, *order: Column | str, start: int = 1) -> DataFrame:
    """`df` with `to`: start, start + 1, ... by `order`, which should leave no ties.

    Rows are dealt by ranges of the order, which a hot value of its first columns does not upset. The ranges are kept,
    so that their numbers hold; each is sorted by itself, and one row for each tells how many come before it.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return rows.join(heads, "_range").withColumn(to, (F.col("_before") + within + F.lit(start - 1)).cast("long")).drop("_range", "_before")
