"""Running values over the rows of a key in two levels, so that a key with any share of all rows is worked on by many tasks.

Rows are dealt by range of (key, order). Each range works out its own running values; a key's ranges are summed up to one row each, and the
rows of a range take what the ranges of their key before it carry over. Only keys in more than one range carry anything: these are the first
and the last key of a range, so the carried table has at most two rows a range, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.session import materialize


@dataclass(frozen=True)
class Running:
    """An associative running value: of a row within its range, of a whole range, over the ranges before, and both together."""

    inside: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carried: Callable[[Column, WindowSpec], Column]
    both: Callable[[Column, Column], Column]


def running_sum(value: Column) -> Running:
    """The sum up to the row itself; 0 for nulls."""
    own = F.coalesce(value, F.lit(0)).cast("long")
    return Running(lambda w: F.sum(own).over(w), lambda _: F.sum(own), lambda s, w: F.sum(s).over(w), lambda carry, x: F.coalesce(carry, F.lit(0)) + x)


def running_last(value: Column) -> Running:
    """The last value that isn't null, up to the row itself."""
    return Running(
        lambda w: F.last(value, True).over(w),
        lambda order: F.max_by(value, F.when(value.isNotNull(), F.struct(order))),
        lambda s, w: F.last(s, True).over(w),
        lambda carry, x: F.coalesce(x, carry),
    )


def deal(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """df by range of (by, order) with _range, the number of its range, written to the shared folder."""
    return materialize(df.repartitionByRange(*by, order).withColumn("_range", F.spark_partition_id()), "scan-ranges")


def apply(dealt: DataFrame, by: list[str], order: str, **values: Running) -> DataFrame:
    """Columns with running values, added to rows from `deal`."""
    inner = W.partitionBy("_range", *by).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = dealt.withColumns({f"_in_{n}": v.inside(inner) for n, v in values.items()})
    sums = dealt.groupBy(*by, "_range").agg(*(v.summary(F.col(order)).alias(f"_s_{n}") for n, v in values.items()))
    key, upto = W.partitionBy(*by), W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carry = sums.withColumn("_ranges", F.count("*").over(key)).withColumns({f"_c_{n}": v.carried(F.col(f"_s_{n}"), upto) for n, v in values.items()})
    carry = carry.filter("_ranges > 1").select(F.col("_range").alias("_r"), *(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), *(f"_c_{n}" for n in values))
    same = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    joined = rows.join(F.broadcast(carry), same, "left")
    return joined.select(*dealt.columns, *(v.both(F.col(f"_c_{n}"), F.col(f"_in_{n}")).alias(n) for n, v in values.items()))


def numbered_runs(dealt: DataFrame, by: list[str], order: str, column: str, name: str = "run") -> DataFrame:
    """Runs of equal values (null is one) numbered from 1, for rows from `deal`: a range is summed up to its first and last value and its changes,
    and a range whose first value is the last one of the range before goes on with that one's run."""
    w = W.partitionBy("_range", *by).orderBy(order)
    new = F.when((F.row_number().over(w) == 1) | F.lag(column).over(w).eqNullSafe(F.col(column)), 0).otherwise(1)
    rows = dealt.withColumn("_new", new)
    ends = rows.groupBy(*by, "_range").agg(F.min_by(F.struct(column), F.struct(order)).alias("_first"), F.max_by(F.struct(column), F.struct(order)).alias("_last"), F.sum("_new").alias("_changes"))
    key = W.partitionBy(*by).orderBy("_range")
    ends = ends.withColumns({"_start": F.when(F.lag("_last").over(key).eqNullSafe(F.col("_first")), 0).otherwise(1), "_ranges": F.count("*").over(W.partitionBy(*by))})
    begins = F.sum("_start").over(key.rowsBetween(W.unboundedPreceding, W.currentRow)) + F.coalesce(F.sum("_changes").over(key.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carry = ends.withColumn("_begin", begins).filter("_ranges > 1").select(F.col("_range").alias("_r"), "_begin", *(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)))
    same = F.col("_range") == F.col("_r")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_b{i}"))
    upto = F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return rows.withColumn("_upto", upto).join(F.broadcast(carry), same, "left").select(*dealt.columns, (F.coalesce("_begin", F.lit(1)) + F.col("_upto")).cast("long").alias(name))
