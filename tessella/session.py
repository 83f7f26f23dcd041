"""Spark session and shared-folder helpers."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def session(app: str = "tessella", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with AQE, Arrow and UTC; on a cluster the submitter's session is used as it is."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: What a Python worker gets at once, and the JVM holds for it.
ARROW_BATCH = "4m"


def ship(spark: SparkSession) -> None:
    """Python workers find this package by path, whatever folder the driver was started in, and get small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)
    env = spark.sparkContext.environment
    env["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, env.get("PYTHONPATH", "").split(os.pathsep))]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else the checkpoint folder that the caller has set.

    Where neither is set, a local session gets a folder of its own, as driver and executors are one process there;
    on a cluster that would be another disk on each machine, so it is an error."""
    context = spark.sparkContext
    conf = context.getConf().get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(f"file://{own}")
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


#: Paths that `materialize` has written within each open `settle` of this thread.
_written = threading.local()


def passing(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, deleted when the innermost open `settle` ends."""
    path = scratch(spark, name)
    if stack := getattr(_written, "stack", None):
        stack[-1].append(path)
    return path


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet into the shared folder and read it back."""
    path = passing(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Within, `materialize` writes tables that are deleted at the end."""
    _written.stack = [*getattr(_written, "stack", []), []]
    try:
        yield
    finally:
        *_written.stack, own = _written.stack
        for table in own:
            remove(spark, table)


def settle(spark: SparkSession, build: Callable[[], DataFrame], name: str) -> DataFrame:
    """The result of build, written to the shared folder; all tables that were written on the way are deleted."""
    with temporary(spark):
        out, path = build(), scratch(spark, name)
        out.write.parquet(path)
    if _written.stack:
        _written.stack[-1].append(path)
    return spark.read.schema(out.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, dealt out anew for work that costs more than moving its rows; any other scan as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
