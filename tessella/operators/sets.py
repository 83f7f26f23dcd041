"""Set operations and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of all, columns that one lacks left empty."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def merged_sets(df: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Each entity's sets of values, sorted."""
    return df.groupBy(by).agg(*(F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c) for c in columns))


def intersects(a: Column, b: Column) -> Column:
    """U4"""
    return F.arrays_overlap(a, b)


def strict_subset(a: Column, b: Column) -> Column:
    """U5"""
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_distinct(a)) < F.size(F.array_distinct(b)))


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """U7"""
    return df.join(gone.select(key).distinct(), key, "left_anti")


def common_keys(a: DataFrame, b: DataFrame, key: str, *same: str) -> DataFrame:
    """U8: keys of both whose other columns (such as a shape) agree too."""
    return a.select(key, *same).intersect(b.select(key, *same))


def search(df: DataFrame, query: str, fields: list[str], order: list[str], limit: int = 200) -> DataFrame:
    """Rows with the query in a field, exact ones first, then by order; case and white space don't matter."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\s+", " ")))
    wanted = " ".join(query.lower().split())
    folded = F.array(*(fold(F.col(f)) for f in fields))
    hit = df.withColumn("exact", F.array_contains(folded, wanted)).filter(F.exists(folded, lambda x: F.contains(x, F.lit(wanted))))
    return hit.orderBy(F.when(F.col("exact"), 0).otherwise(1), *order).limit(limit)


def extremes(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """T4: the k largest and the k smallest rows, each found by a top-k without a full sort."""
    big = df.orderBy(F.desc(value), tie).limit(k).withColumn("side", F.lit("largest"))
    return big.unionByName(df.orderBy(value, tie).limit(k).withColumn("side", F.lit("smallest")))
