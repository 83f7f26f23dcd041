"""Sequence operators as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators import scans
from tessella.session import materialize

BEFORE = (W.unboundedPreceding, -1)


def islands(df: DataFrame, by: list[str], order: str, ends: Column) -> DataFrame:
    """Numbers the runs that a closing row ends; the row after it begins the next. A key's rows are worked on by many tasks."""
    closing = F.when(ends, 1).otherwise(0)
    marked = scans.apply(scans.deal(df.withColumn("_closing", closing), by, order), by, order, island=scans.running_sum(F.col("_closing")))
    return marked.withColumn("island", F.col("island") - F.col("_closing")).drop("_closing", "_range")


def merge_islands(df: DataFrame, by: list[str], order: str, texts: list[str], ends: Column, keep_open: bool = True) -> DataFrame:
    """Each island's texts joined by blanks in order."""
    marked = islands(df.withColumn("_ends", ends), by, order, F.col("_ends"))
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(t).alias("t")))), lambda s: s["t"]), " ").alias(t) for t in texts]
    out = marked.groupBy(*by, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length"), F.bool_or("_ends").alias("closed"), *joined)
    return out if keep_open else out.filter("closed")


def spans(df: DataFrame, by: list[str], order: str, weights: list[str], budget: float, longest: int = 5) -> DataFrame:
    """All runs of 1 to longest neighbours whose weights keep within the budget, as (by, start, length, sums)."""
    w = W.partitionBy(*by).orderBy(order)
    ahead = w.rowsBetween(0, longest - 1)
    rows = df.withColumn("_n", F.collect_list(F.struct(order, *weights)).over(ahead))
    each = rows.select(*by, F.explode(F.transform(F.sequence(F.lit(1), F.size("_n")), lambda k: F.slice("_n", 1, k))).alias("s"))
    total = lambda c: F.aggregate(F.transform("s", lambda x: x[c].cast("double")), F.lit(0.0), lambda a, x: a + x)
    out = each.select(*by, F.col("s")[0][order].alias("start"), F.element_at("s", -1)[order].alias("end"), F.size("s").alias("length"), *(total(c).alias(c) for c in weights))
    for c in weights:
        out = out.filter(F.col(c) <= budget)
    return out


def forward_fill(df: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """Blank values take the last one that is not. A key's rows are worked on by many tasks."""
    filled = scans.apply(scans.deal(df, by, order), by, order, _last=scans.running_last(F.nullif(F.col(column), F.lit(""))))
    return filled.withColumn(column, F.coalesce("_last", F.lit(""))).drop("_last", "_range")


def runs(df: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """Numbers runs of equal values; a value that comes again is a new run. A key's rows are worked on by many tasks."""
    return scans.numbered_runs(scans.deal(df, by, order), by, order, column).drop("_range")


def number_segments(df: DataFrame, by: list[str], order: str, keep: Column) -> DataFrame:
    """Kept segments numbered from 1."""
    return df.filter(keep).withColumn("segment_index", F.row_number().over(W.partitionBy(*by).orderBy(order)))


def neighbours(df: DataFrame, by: list[str], order: str, key: str) -> DataFrame:
    """W6"""
    w = W.partitionBy(*by).orderBy(order)
    return df.withColumn("previous", F.lag(key).over(w)).withColumn("next", F.lead(key).over(w))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", total: str | None = None) -> DataFrame:
    """Ranks from 1 over all rows without one task that holds them all: rows are dealt by range, ranked in each range,
    and moved by the number of rows in the ranges before, of which there are as many as partitions. total: a column with the number of rows."""
    placed = materialize(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_range").agg(F.count("*").alias("_c"))
    before = counts.select("_range", F.coalesce(F.sum("_c").over(W.orderBy("_range").rowsBetween(*BEFORE)), F.lit(0)).alias("_before"), F.sum("_c").over(W.partitionBy()).alias("_all"))
    ranked = placed.withColumn("_r", F.row_number().over(W.partitionBy("_range").orderBy(*order)))
    out = ranked.join(F.broadcast(before), "_range").withColumn(name, (F.col("_r") + F.col("_before")).cast("long"))
    return (out.withColumn(total, F.col("_all").cast("long")) if total else out).drop("_r", "_before", "_range", "_all")


def drop_top_fraction(df: DataFrame, order: list[Column], fraction: float) -> DataFrame:
    """Without the first ceil(n * fraction) rows of an order."""
    return global_rank(df, order, "_rank", "_total").filter(F.col("_rank") > F.ceil(F.col("_total") * F.lit(fraction))).drop("_rank", "_total")


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key, by a minimum that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def cap_per_source(df: DataFrame, by: str, order: str, most: int = 3, suffix: str = "--swap-") -> DataFrame:
    """The first rows of each source, numbered; ids get the number behind a suffix."""
    n = F.row_number().over(W.partitionBy(by).orderBy(order))
    return df.withColumn("n", n).filter(F.col("n") <= most).withColumn("new_id", F.concat(F.col(by).cast("string"), F.lit(suffix), F.col("n").cast("string")))


def quantile_bins(df: DataFrame, value: str, tie: str, rows_per_bin: int = 100, most: int = 5) -> DataFrame:
    """Bins of equal counts in order of (value, tie), the larger ones first; between 2 and most of them."""
    ranked = global_rank(df, [F.col(value), F.col(tie)], "_rank", "_total")
    ranked = ranked.withColumn("_q", F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.col("_total") / rows_per_bin))).cast("long"))
    ranked = ranked.withColumns({"_size": F.floor(F.col("_total") / F.col("_q")), "_more": F.col("_total") % F.col("_q")})
    at, size, more = F.col("_rank") - 1, F.col("_size"), F.col("_more")
    low, high = F.floor(at / (size + 1)) + 1, F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))) + more + 1
    return ranked.withColumn("bin", F.when(at < more * (size + 1), low).otherwise(high).cast("int")).drop("_rank", "_total", "_q", "_size", "_more")


def length_buckets(df: DataFrame, value: str, tie: str, k: int) -> DataFrame:
    """N // k rows a bucket in order of length, the remainder in the last."""
    ranked = global_rank(df, [F.col(value), F.col(tie)], "_rank", "_total")
    size = F.greatest(F.lit(1), F.floor(F.col("_total") / k))
    return ranked.withColumn("bucket", F.least(F.floor((F.col("_rank") - 1) / size), F.lit(k - 1)).cast("int")).drop("_rank", "_total")


def trim_to_budget(hints: Column, size, base: Column, limit: int) -> Column:
    """The first hints whose sizes, on top of the base, keep within the limit."""
    start = F.struct(F.array().cast("array<string>").alias("out"), base.cast("long").alias("used"), F.lit(True).alias("open"))

    def step(acc: Column, h: Column) -> Column:
        fits = acc["open"] & (acc["used"] + size(h) <= limit)
        return F.struct(F.when(fits, F.concat(acc["out"], F.array(h))).otherwise(acc["out"]).alias("out"), F.when(fits, acc["used"] + size(h)).otherwise(acc["used"]).cast("long").alias("used"), fits.alias("open"))

    return F.aggregate(hints, start, step)["out"]


def pack_lines(text: Column, limit: int = 200) -> Column:
    """Pieces between newlines and double blanks, words of each packed up to a length; a longer word stands alone."""
    pieces = F.filter(F.transform(F.split(text, r"\n|  "), lambda p: F.trim(F.regexp_replace(p, r"\s*[\t\n\x0B\f\r]\s*", " "))), lambda p: p != "")
    packed = F.lit(rf"(?s)([^ ]{{{limit + 1},}}|.{{1,{limit}}})(?: |\z)")
    return F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) <= limit, F.array(p)).otherwise(F.regexp_extract_all(p, packed, F.lit(1)))))


def splice(df: DataFrame, new: DataFrame, page: str, number: int, order: str, name: str = "n") -> DataFrame:
    """A page's rows replaced by new ones, which stand where its rows stood or before the next page; numbered anew by page and old order."""
    kept = df.filter(F.col(page) != number).withColumn("_new", F.lit(0))
    both = kept.unionByName(new.withColumn("_new", F.lit(1)).withColumn(page, F.lit(number).cast(df.schema[page].dataType)), allowMissingColumns=True)
    return global_rank(both, [F.col(page), F.col("_new"), F.col(order)], name).drop("_new")


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """N rows by the smallest hash of key and seed; the same rows however the table is partitioned."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def split(df: DataFrame, key: str, strata: list[str], share: float, seed: int = 0, least: int = 1) -> DataFrame:
    """Marks round(n * share) rows of each stratum, least at least, as held out, by order of a hash."""
    w = W.partitionBy(*strata)
    rank = F.row_number().over(w.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key))
    size = F.greatest(F.lit(least), F.floor(F.count("*").over(w) * share + 0.5))
    return df.withColumn("held_out", rank <= size)
