"""Append-only logs and resuming as Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.sources.readers import last_by_key
from tessella.sources.writers import current, replace_atomically


def run_log(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda d: d, files: int | None = None) -> StreamingQuery:
    """New files of a folder through `change` into a log, once each however often it is started; it ends when no file is left."""
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files) if files else stream
    return change(stream.parquet(source)).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink, format="parquet", outputMode="append")


def upsert_latest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str, order: str) -> StreamingQuery:
    """The last row of each key, merged batch by batch into the versions of sink (`writers.current` names the last one); a batch that
    runs again, or whose commit was cut short, changes nothing that is committed."""

    def merge(batch: DataFrame, _: int) -> None:
        own = batch.sparkSession
        before = current(own, sink)
        now = own.read.schema(batch.schema).parquet(before).unionByName(batch) if before else batch
        replace_atomically(last_by_key(now, key, order), sink)

    return spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(merge).start()


def keep_latest(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str, order: str, files: int | None = None) -> StreamingQuery:
    """S8 as a stream: the last row of each key is the state of a streaming aggregation, so a batch costs what its own keys cost, however many there are.

    Each batch writes the keys that its rows touched, as they stand after it, into a folder of its own in sink; a batch that runs again after a stop
    writes the same folder anew. `latest` reads the sink. State and progress are in checkpoint, from where a stopped query goes on."""
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files) if files else stream
    rows = stream.parquet(source)
    rest = [c for c in rows.columns if c != key]
    # Ties in order go by the other columns, so that the row kept doesn't depend on batches. Columns that Spark can't order would fail here.
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *(c for c in rest if c != order))).alias("_row"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return last.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def latest(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """The rows of a sink of `keep_latest`: for each key what its last batch wrote, by a maximum that combines before the shuffle."""
    log = spark.read.option("basePath", sink).parquet(sink)
    return log.groupBy(key).agg(F.max_by("_row", "batch").alias("_row")).select(key, "_row.*")


def windowed_counts(stream: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by time window with a watermark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


class TokenBucket:
    """A limit of so many tokens a minute, for sinks that call a service; clock and sleep can be given."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.level, self.clock, self.sleep = per_minute / 60, per_minute, clock, sleep
        self.most, self.last = per_minute, clock()

    def take(self, tokens: float) -> float:
        """Waits until the tokens are there; the seconds waited. More than a minute's worth counts as that."""
        tokens, waited = min(tokens, self.most), 0.0
        while True:
            now = self.clock()
            self.level, self.last = min(self.most, self.level + (now - self.last) * self.rate), now
            if self.level >= tokens:
                self.level -= tokens
                return waited
            need = (tokens - self.level) / self.rate
            self.sleep(need)
            waited += need
