"""Line dedup over levelled sorted runs of line hashes (DataFrame functions only).

A run is a bucketed table of (h1, h2, n_docs, max_doc), one row for each 128-bit line hash: in how many
documents of its batch a line key stands and the largest doc_id holding it. All runs are dealt to the same
buckets and sorted in each, so that merges need neither a shuffle nor a sort. Each batch of documents is
merge-anti-joined with the runs: keys that no run holds make the batch's own run at level 0, known ones an
update of their counts. So no two runs share a key, and FANOUT runs of a level are merged into one run of the
next. Keys whose counts reach the limit lose their lines but in the largest doc_id.

Defined cases: null or empty text is one empty line; keys are compared after stripping ASCII white space
at both ends and lowering A-Z; rows that repeat a doc_id count as one document, each row loses its own lines;
documents without a doc_id count for nothing and keep all lines; there are no ties, as doc_ids of a key
differ; an empty table gives an empty result; extra columns, whatever their names, are left out of the
result. Very long texts are split by Spark's own string functions; no line is cut, and the work on a text is
linear in its lines.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import materialize, remove, scratch, settle, ship

MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEED = 7919


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else as it is; texts in ASCII only take the quick way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z lowered."""
    return F.btrim(lower_ascii(line), F.lit(_SPACE))


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(d, t, line_no, h1, h2) of each line whose key has min_chars code points; t: a hash of the text, as a doc_id may come twice."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.filter(F.col(doc_col).isNotNull()).select(F.col(doc_col).alias("d"), F.xxhash64(text).alias("t"), F.posexplode(_split(lower_ascii(text))).alias("line_no", "line"))
    keys = lines.filter(F.length("line") >= min_chars).select("d", "t", "line_no", F.btrim("line", F.lit(_SPACE)).alias("key")).filter(F.length("key") >= min_chars)
    return keys.select("d", "t", "line_no", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(_SEED), "key").alias("h2"))


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Within, scans of bucketed tables with one file a bucket count as sorted; the caller's setting comes back after."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The levelled store of sorted runs. Its list of runs is small metadata and lives on the driver."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.root, self.fanout = spark, scratch(spark, "line-runs"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.made = f"line_runs_{uuid.uuid4().hex}", 0
        self.levels: list[list[str]] = []
        self.updates: list[str] = []

    def _write(self, rows: DataFrame) -> str:
        """A new bucketed table in the shared folder; rows are dealt to its buckets already."""
        name = f"{self.name}_{self.made}"
        self.made += 1
        rows.select("h1", "h2", "n_docs", "max_doc").write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{name}").saveAsTable(name)
        return name

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        remove(self.spark, f"{self.root}/{name}")

    def _runs(self) -> list[DataFrame]:
        return [self.spark.table(x) for level in self.levels for x in level]

    def _own(self, lines: DataFrame) -> DataFrame:
        """The batch's keys, dealt to the buckets."""
        own = lines.select("h1", "h2", "d").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("d").alias("max_doc"))
        return own.repartition(self.buckets, "h1", "h2")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (h1, h2, ...) that no run holds: one merge anti join a run."""
        return reduce(lambda left, run: left.join(run.hint("merge"), ["h1", "h2"], "left_anti"), self._runs(), keys)

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch of `hashed_lines`: unseen keys are its own run, seen ones update their counts; then full levels are compacted."""
        with _sorted_scans(self.spark):
            own = self._write(self._own(lines))
            if self.made > 1:
                batch = self.spark.table(own)
                fresh = self._write(self.unseen(batch))
                self.updates += [self._write(batch.join(run.hint("merge"), ["h1", "h2"], "left_semi")) for run in self._runs()]
                self._forget(own)
                own = fresh
            self._put(own, 0)
            level = 0
            while len(self.levels[level]) >= self.fanout:
                full, self.levels[level] = self.levels[level], []
                self._put(self._write(self._merged([self.spark.table(x) for x in full])), level + 1)
                for x in full:
                    self._forget(x)
                level += 1

    def _put(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        """Sorted runs merged into one; keys of several runs, as updates have them, are added up."""
        both = lambda a, b: a.join(b.select("h1", "h2", F.col("n_docs").alias("n"), F.col("max_doc").alias("m")).hint("merge"), ["h1", "h2"], "full_outer").select(
            "h1", "h2", (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("max_doc", "m").alias("max_doc")
        )
        return reduce(both, runs)

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, max_doc) of all keys."""
        every = [x.select("h1", "h2", "n_docs", "max_doc") for x in [*self._runs(), *map(self.spark.table, self.updates)]]
        return self._merged(every)

    def drop(self) -> None:
        for name in [*(x for level in self.levels for x in level), *self.updates]:
            self._forget(name)
        self.levels, self.updates = [], []
        remove(self.spark, self.root)


def _frequent(lines: DataFrame, min_docs: int, batches: int, fanout: int) -> DataFrame:
    """(h1, h2, max_doc) of the keys found in min_docs documents or more."""
    store = LineRuns(lines.sparkSession, fanout)
    try:
        for k in range(batches):
            store.add(lines.filter(F.pmod(F.xxhash64("d"), F.lit(batches)) == k))
        with _sorted_scans(lines.sparkSession):
            return materialize(store.totals().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc"), "line-frequent")
    finally:
        store.drop()


def _gone(docs: DataFrame, min_chars: int, min_docs: int, batches: int, fanout: int, doc_col: str, text_col: str) -> DataFrame:
    """(d, t, gone): the numbers of the lines that go."""
    lines = materialize(hashed_lines(docs, min_chars, doc_col, text_col), "line-hashes")
    gone = lines.join(_frequent(lines, min_docs, batches, fanout), ["h1", "h2"]).filter(F.col("d") < F.col("max_doc"))
    return gone.groupBy("d", "t").agg(F.collect_set("line_no").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT, doc_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_col, the columns of keep, n_lines, n_dropped, kept (the text left); all lines of a key found in min_docs documents or more go, but for those of the largest doc_id."""
    spark = docs.sparkSession
    ship(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(doc_col).alias("__d"), text.alias("__text"), F.xxhash64(text).alias("__t"), F.struct(F.lit(0), *keep).alias("__keep"))
    gone = settle(spark, lambda: _gone(rows, min_chars, min_docs, batches, fanout, "__d", "__text"), "line-gone")
    joined = rows.join(gone, (F.col("__d") == F.col("d")) & (F.col("__t") == F.col("t")), "left")
    parts = joined.select("__d", "__keep", "__text", "gone", _split(F.col("__text")).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    own = [F.col("__keep")[k].alias(k) for k in keep]
    return parts.select(F.col("__d").alias(doc_col), *own, F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
