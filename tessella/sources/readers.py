"""Sources. All text columns, explicit schemas; _ord keeps the order of rows where it matters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.rules import PANDAS_NA
from tessella.operators.filters import require_columns


def with_order(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Contiguous row numbers from 0 for a scan of whole files: by file name, then by place in the file. Each file's rows are counted,
    and a row's number is the count of the files before plus its place; rows themselves don't move."""
    placed = df.withColumns({"_f": F.input_file_name(), "_m": F.monotonically_increasing_id()})
    files = placed.groupBy("_f").agg(F.count("*").alias("_c"), F.min("_m").alias("_least"))
    before = F.coalesce(F.sum("_c").over(W.orderBy("_f").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    starts = files.select(F.col("_f").alias("_file"), (before - F.col("_least")).alias("_shift"))
    return placed.join(starts, F.col("_f") == F.col("_file")).select(*df.columns, (F.col("_m") + F.col("_shift")).cast("long").alias(name))


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, na: str = "literal", order: bool = True) -> DataFrame:
    """RFC 4180 with line breaks in quotes, all strings; a file is read whole by one task, as only its start tells quotes from text. na='pandas' reads the usual NA spellings as null, 'literal' as they are."""
    if columns is None:
        columns = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("nullValue", "\0").option("emptyValue", "").csv(path)
    df = with_order(df) if order else df
    for c in columns:
        value = F.coalesce(F.col(c), F.lit(""))
        df = df.withColumn(c, F.when(value.isin(*PANDAS_NA), F.lit(None)).otherwise(value) if na == "pandas" else value)
    return df


def train(df: DataFrame, source: str = "transliteration", target: str = "translation") -> DataFrame:
    """S3: both sides needed, trimmed, blank ones dropped."""
    require_columns(df, source, target)
    clean = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return df.withColumns({source: clean(source), target: clean(target)}).filter((F.col(source) != "") & (F.col(target) != ""))


def test(df: DataFrame, key: str = "id", source: str = "transliteration") -> DataFrame:
    """As S3 without the filter."""
    require_columns(df, key, source)
    return df.withColumn(source, F.trim(F.coalesce(F.col(source), F.lit(""))))


def flexible(df: DataFrame, order: str = "_ord") -> DataFrame:
    """The id is oare_id, else id, else the row's number; a missing translation is blank; blank sources go."""
    require_columns(df, "transliteration")
    key = next((F.col(c) for c in ("oare_id", "id") if c in df.columns), F.col(order).cast("string"))
    target = F.trim(F.coalesce(F.col("translation"), F.lit(""))) if "translation" in df.columns else F.lit("")
    out = df.select(key.cast("string").alias("oare_id"), F.trim(F.coalesce("transliteration", F.lit(""))).alias("transliteration"), target.alias("translation"))
    return out.filter("transliteration <> ''")


def records(spark: SparkSession, path: str, schema: T.StructType | str, whole: bool | None = None) -> DataFrame:
    """.json holds a list or one object, anything else one object a line."""
    whole = path.endswith(".json") if whole is None else whole
    return spark.read.schema(schema).option("multiLine", whole).json(path)


def glosses(df: DataFrame, key: str = "oare_id", field: str = "token_glosses") -> DataFrame:
    """Each row's token glosses as rows."""
    return df.select(key, F.explode(field).alias("g")).select(key, "g.*")


def last_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of a log's rows the last of each key, by a maximum that combines before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


def pdf_words(spark: SparkSession, path: str, extract: Callable[[bytes], Iterable[tuple]]) -> DataFrame:
    """(path, page, text, x0, x1, top, bottom) of the words that `extract` finds in the bytes of each file. No PDF library comes with
    this one; with pdfplumber, extract opens the bytes and yields the page number and extract_words() of each page."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = [(name, int(page), str(text), *map(float, at)) for page, text, *at in extract(content)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 7, (pa.string(), pa.int32(), pa.string(), *[pa.float64()] * 4), strict=True)], ["path", "page", "text", "x0", "x1", "top", "bottom"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, "path string, page int, text string, x0 double, x1 double, top double, bottom double")


def words(df: DataFrame, top_min: float = 0.0, bottom_max: float = 1e9) -> DataFrame:
    """A table of words with places, those between two heights."""
    require_columns(df, "page", "text", "x0", "x1", "top", "bottom")
    return df.filter(F.col("top").between(top_min, bottom_max))


def page_images(spark: SparkSession, path: str, kind: str = "image/png") -> DataFrame:
    """Image files as data URLs; rendering needs a library that must be there already."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.concat(F.lit(f"data:{kind};base64,"), F.base64("content")).alias("url"))


def page_range(df: DataFrame, first: int | None = None, last: int | None = None, limit: int | None = None, column: str = "pdf_page", order: str = "_ord") -> DataFrame:
    """S11"""
    df = df.filter(F.col(column) >= first) if first is not None else df
    df = df.filter(F.col(column) <= last) if last is not None else df
    return df.orderBy(order).limit(limit) if limit is not None else df


def cached(df: DataFrame) -> DataFrame:
    """A lookup table kept for reuse."""
    return df.cache()


def env_file(path: str) -> dict[str, str]:
    """KEY=value lines; comments and `export` are left out, quotes around a value go."""
    out: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.strip().removeprefix("export ").strip()
        key, eq, value = line.partition("=")
        if eq and key and not line.startswith("#"):
            value = value.strip()
            out.setdefault(key.strip(), value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value)
    return out


