"""Extremes over cells that are not stored: a zero's value is known from its row and column alone, so only the first few
zeros in the right order have to be found, never all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_missing(axis: DataFrame, held: DataFrame, keys: list[str], count: int = 1) -> DataFrame:
    """keys, position: for each row of axis(keys, n) the first `count` of the places 0 to n - 1 that are not in
    held(keys, position), fewer where fewer are missing.

    Each held place opens a gap up to the next one, and its rank among the held ones says how many were missing before it.
    So a gap knows by itself which part of it is wanted, and rows are made for that part only. Places of a key must be
    distinct; keys that axis does not have give nothing."""
    ends = axis.select(*keys, F.lit(-1).cast("bigint").alias("position"), F.col("n").cast("bigint").alias("n"))
    marks = ends.unionByName(held.select(*keys, F.col("position").cast("bigint").alias("position")), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy("position")
    start = F.col("position") + 1
    gaps = marks.select(
        *keys,
        F.first("n").over(order).alias("n"),
        start.alias("start"),
        (start - F.row_number().over(order) + 1).alias("before"),
        (F.coalesce(F.lead("position").over(order), F.first("n").over(order)) - start).alias("size"),
    )
    wanted = gaps.withColumn("size", F.least(F.col("size"), F.lit(count) - F.col("before"))).where("n IS NOT NULL AND size > 0")
    return wanted.select(*keys, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("position"))
