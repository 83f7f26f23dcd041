"""Sinks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str] | None = None, single: bool = False) -> None:
    """K1, K6: columns in a fixed order with a header, values as they are, blanks at their ends too; one file only for an export."""
    out = df.select(*(columns or df.columns))
    out = out.coalesce(1) if single else out
    out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def extended(base: DataFrame, more: DataFrame) -> DataFrame:
    """K2: rows of both; columns that one lacks are blank."""
    out = base.unionByName(more, allowMissingColumns=True)
    return out.fillna("", [c for c, t in out.dtypes if t == "string"])


def json_lines(df: DataFrame, path: str) -> None:
    """K3: one object a line; nested columns stay nested."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def json_column(*columns: str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


_POINTER = "_current"


def _paths(spark, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> str | None:
    """K4: the version of a replaced table that its pointer names; None before the first."""
    jvm, root, fs = _paths(spark, path)
    pointer = jvm.org.apache.hadoop.fs.Path(root, _POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        name = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()
    return f"{path.rstrip('/')}/{name}"


def replace_atomically(df: DataFrame, path: str, before_commit: Callable[[], None] = lambda: None) -> None:
    """K4: a table of versions. The rows go to a folder of their own, then a pointer file is renamed over the one that names the version
    before: a reader of `current` sees one version or the other as a whole, whenever the writer stops. Versions that the
    pointer has left go at the next replacement but the last, which readers may still hold."""
    spark = df.sparkSession
    jvm, root, fs = _paths(spark, path)
    make = jvm.org.apache.hadoop.fs.Path
    name = f"version-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(f"{path.rstrip('/')}/{name}")
    before_commit()
    held = current(spark, path)
    staged = make(root, f"{_POINTER}.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(name, "utf-8"))
    out.close()
    # FileContext renames onto an existing file in one step, which FileSystem's own rename does not.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(make(root, _POINTER)), options)
    keep = {name, (held or "").rpartition("/")[2]}
    for entry in fs.listStatus(root):
        own = entry.getPath().getName()
        if own.startswith("version-") and own not in keep and own < name:
            fs.delete(entry.getPath(), True)


def append(df: DataFrame, path: str) -> None:
    """K5, K7: a log that grows; read it with the last row by key."""
    df.write.mode("append").parquet(path)


def formatted(value: Column, digits: int = 3) -> Column:
    """K8: fixed decimals, blank for null."""
    return F.when(value.isNull(), "").otherwise(F.format_string(f"%.{digits}f", value.cast("double")))
