"""Merging weight vectors in long form (model, idx, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vectors(df: DataFrame, key: str, array: str) -> DataFrame:
    """Array vectors as rows."""
    return df.select(F.col(key).alias("model"), F.posexplode(array).alias("idx", "value"))


def ties_merge(df: DataFrame, density: float = 0.5, how: str = "mean", epsilon: float = 1.0, tie_at_border: bool = True) -> DataFrame:
    """Each model keeps its largest values by size (ties at the border stay), each place elects the sign of its sum, and the
    values of that sign are averaged, summed, or the largest of them taken; times epsilon."""
    n = F.count("*").over(W.partitionBy("model"))
    rank = F.rank() if tie_at_border else F.row_number()
    place = rank.over(W.partitionBy("model").orderBy(F.desc(F.abs("value")), *([] if tie_at_border else [F.col("idx")])))
    kept = df.withColumn("_keep", place <= F.floor(n * density)).withColumn("v", F.when(F.col("_keep"), F.col("value").cast("double")).otherwise(0.0))
    sign = kept.groupBy("idx").agg(F.signum(F.sum("v")).alias("s"))
    agree = kept.join(sign, "idx").withColumn("a", F.when((F.signum("v") == F.col("s")) & (F.col("v") != 0), F.col("v")))
    merged = {"mean": F.avg("a"), "sum": F.sum("a"), "max": F.max_by("a", F.abs("a"))}[how]
    return agree.groupBy("idx").agg((F.coalesce(merged, F.lit(0.0)) * epsilon).alias("value"))


def task_sum(df: DataFrame, scale: float) -> DataFrame:
    """X2"""
    return df.groupBy("idx").agg((F.sum(F.col("value").cast("double")) * scale).alias("value"))
