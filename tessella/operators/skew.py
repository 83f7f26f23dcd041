"""Joins and filters that hold up where one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with more than 1 / HOT_PARTS of all rows are hot; so there are fewer of them than HOT_PARTS.
HOT_PARTS = 1000
#: Most bits of a membership filter; 64 of them are a row.
MOST_BITS = 1 << 24


def lookup_hot(left: DataFrame, right: DataFrame, on: list[str], weight: str, salt: Column, parts: int = HOT_PARTS) -> DataFrame:
    """Left outer join with right, which has each key once and in `weight` how many rows of left have it.

    Keys with more than a `parts`th of all rows are fewer than `parts`, which bounds what is broadcast. Their rows are dealt by salt in
    the join of all the other keys, where none has more than a `parts`th. Columns of right must not be in left, but for the keys."""
    values = [c for c in right.columns if c not in on]
    limit = (right.agg(F.sum(weight)).first()[0] or 0) / parts
    hot = right.filter(F.col(weight) > limit).select(*on, F.struct(*values).alias("_hot"))
    rest = right.filter(F.col(weight) <= limit).select(*on, F.struct(*values).alias("_cold"), F.lit(0).cast("long").alias("_salt"))
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_salt", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(salt), F.lit(parts)) + 1).cast("long"))
    both = dealt.join(rest, [*on, "_salt"], "left").withColumn("_row", F.coalesce("_hot", "_cold"))
    return both.select(*left.columns, *(F.col("_row")[v].alias(v) for v in values))


def bit_filter(keys: DataFrame, key: str, most_bits: int = MOST_BITS):
    """A function (DataFrame, column) that leaves out most rows whose 64-bit hash is not among keys, and none whose hash is.

    The filter is a bitmap of at most most_bits bits as rows of 64, so that what is broadcast has a fixed bound whatever the number of keys;
    with many more keys than bits it lets more rows pass, and the exact step behind it decides."""
    n = keys.count()
    bits = 64
    while bits < min(16 * n, most_bits):
        bits *= 2
    slot = lambda c: c.bitwiseAND(F.lit(bits - 1))
    words = keys.select(slot(F.col(key)).alias("_slot")).groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 AS int))")).alias("_bits"))

    def passing(df: DataFrame, column: str) -> DataFrame:
        placed = df.withColumn("_slot", slot(F.col(column))).withColumn("_word", F.shiftright("_slot", 6))
        return placed.join(F.broadcast(words), "_word").filter(F.expr("shiftrightunsigned(_bits, cast(_slot & 63 AS int)) & 1") == 1).select(*df.columns)

    return passing
