"""Exact dedup by a 128-bit content hash with bytes compared (DataFrame functions only).

Narrow rows (id, two 64-bit hashes, digest) are grouped by the hash pair with partial counts, so that a hot group is a few rows
when it is shuffled, and the id that stays is chosen there. Then the whole texts of groups of two rows or more are compared: a
bitmap of fixed size leaves texts without a partner out, and (hashes, text) is made distinct, which takes each text once a task
over the wire. A hash pair with two texts is a collision: its rows are grouped again by hashes and text. Rows find their group by
a join whose hot keys are broadcast, at most 1,000 of them.

Defined cases: a null text counts as empty, and empty texts are equal; texts are equal when identical after `normalize`, by default
A-Z lowered; a row without an id stays only if its group has none with one; of rows that repeat id and text exactly one stays; an
empty table gives an empty result; extra columns, whatever their names, are left out unless named in keep; texts of any length are
hashed and compared whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.line_dedup import lower_ascii
from tessella.operators.skew import bit_filter, lookup_hot
from tessella.session import materialize, settle, ship

_SEED = 7919


def content_hash(text: Column) -> tuple[Column, Column]:
    """Two 64-bit halves."""
    return F.xxhash64(text), F.xxhash64(F.lit(_SEED), text)


def _groups(rows: DataFrame, by: list[str], largest: bool) -> DataFrame:
    """(by, n, keep_d, keep_r) of the groups of two rows or more; fixed-width sums, which combine before the shuffle."""
    best, at = (F.max, F.max_by) if largest else (F.min, F.min_by)
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), best("d").alias("keep_d"), at("r", "d").alias("_at"), F.max("r").alias("_any"))
    return out.filter("n > 1").select(*by, "n", "keep_d", F.coalesce("_at", "_any").alias("keep_r"))


def _verdicts(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    found = lookup_hot(rows, groups, by, "n", F.col("r"))
    kept = F.col("n").isNull() | (F.col("r") == F.col("keep_r"))
    return found.select("d", "own", F.coalesce("keep_d", "d").alias("keep_d"), F.coalesce("n", F.lit(1)).cast("long").alias("n"), kept.alias("kept"), "digest")


def dedup(
    docs: DataFrame,
    doc_col: str = "doc_id",
    text_col: str = "text",
    largest: bool = False,
    normalize: Callable[[Column], Column] = lower_ascii,
    hashes: Callable[[Column], tuple[Column, Column]] = content_hash,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: doc_col, the columns of keep, keep_id (the smallest id of its group, or the largest), group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    ship(spark)
    named = docs.select(F.col(doc_col).alias("d"), F.struct(F.lit(0), *keep).alias("own"), normalize(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    texts = named.select("d", "own", "text", *(h.alias(f"h{i}") for i, h in enumerate(hashes(F.col("text")), 1)))
    by = ["h1", "h2"]

    def build() -> DataFrame:
        digest = F.sha2(F.col("text").cast("binary"), 256).alias("digest")
        rows = materialize(texts.select("d", "own", *by, digest).withColumn("r", F.monotonically_increasing_id()), "exact-rows")
        groups = materialize(_groups(rows, by, largest), "exact-groups")
        maybe = bit_filter(groups, "h1")(texts.select(*by, "text"), "h1")
        clashes = materialize(maybe.distinct().groupBy(*by).agg(F.count("*").alias("c")).filter("c > 1").select(*by), "exact-clashes")
        if clashes.isEmpty():
            return _verdicts(rows, groups, by)
        clear = rows.join(clashes, by, "left_anti")
        mixed = bit_filter(clashes, "h1")(texts, "h1").join(clashes, by, "left_semi").withColumn("r", F.monotonically_increasing_id())
        mixed = materialize(mixed.withColumn("digest", digest), "exact-mixed")
        split = materialize(_groups(mixed, [*by, "text"], largest), "exact-split")
        return _verdicts(clear, groups, by).unionByName(_verdicts(mixed, split, [*by, "text"]))

    out = settle(spark, build, "exact-dedup")
    own = [F.col("own")[k].alias(k) for k in keep]
    return out.select(F.col("d").alias(doc_col), *own, F.col("keep_d").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.col("digest").alias("text_sha256"))
