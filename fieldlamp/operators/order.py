"""Places in an order that no task holds whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written


def numbered(rows: DataFrame, part: str, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place, from 1, in their part: rows are sorted by ranges, a place is that in its range plus those of the part before. Rows that tie
    are numbered in any order; a part that holds most rows is many ranges."""
    by: list[Column] = [F.col(part), *map(F.col, order), F.col("row_")]
    dealt = written(rows.withColumn("row_", F.monotonically_increasing_id()), "to-number")
    ranges = written(dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("row_").withColumn("at_", F.monotonically_increasing_id()), "ranges")
    ranges = ranges.withColumn("range_", F.shiftright("at_", 33))
    sizes = ranges.groupBy(F.col(part).alias("part_"), F.col("range_").alias("in_")).agg(F.count(F.lit(1)).alias("n_"), F.min("at_").alias("first_"))  # a row a part and range
    before = sizes.withColumn("before_", F.sum("n_").over(Window.partitionBy("part_").orderBy("in_")) - F.col("n_")).drop("n_")
    placed = ranges.join(before, F.col(part).eqNullSafe(F.col("part_")) & (F.col("range_") == F.col("in_")))
    return placed.withColumn(name, F.col("before_") + F.col("at_") - F.col("first_") + 1).drop("at_", "range_", "part_", "in_", "first_", "before_")
