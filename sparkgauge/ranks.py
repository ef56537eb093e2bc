"""Row numbers over whole tables without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import cut


def row_numbers(rows: DataFrame, order: list[str | Column], by: list[str] | None = None, name: str = "n", total: str | None = None) -> DataFrame:
    """Adds name: 0, 1, ... in `order` (of each `by`). Rows are dealt by range, numbered in their range, and moved on by the
    rows of the ranges before: one number a range (and `by`). `total` adds how many rows there are (of each `by`). `order` should be total, so that reruns agree."""
    by = by or []
    dealt = cut(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("_range", *by).agg(F.count("*").alias("_c"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_ahead"), F.sum("_c").over(Window.partitionBy(*by)).alias("_all"))
    own = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order)) - 1
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return dealt.withColumn("_own", own).join(ahead, same).select(*rows.columns, (F.col("_own") + F.col("_ahead")).cast("long").alias(name), *([F.col("_all").alias(total)] if total else []))
