"""Files of printed pages in text layout as a data source of its own.

The format is what PDF tools write for a page as text: UTF-8, a line a row of the page, a form feed behind each page (behind the last one it may
be missing). A word's place is that of its cells: CELL points a code point, LINE points a line. `index` counts the pages of byte ranges in a first
scan; with it a file is read by page ranges, and a filter on `page` picks the ranges before any is opened. Without an index a file is one split.

A page belongs to the range in which it begins and is read whole. An empty file has no page, an empty page no word; bytes that aren't UTF-8 are replaced.
"""

from __future__ import annotations

import base64
import re
import struct
import sys
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

#: Workers get this module with the reader, wherever the driver was started.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "text_pages"
CELL, LINE = 6.0, 12.0
SPLIT_MB = 32
CHUNK = 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMAS = {
    "pages": "path string, page long, lines array<struct<top: double, words: array<struct<text: string, x0: double, x1: double>>>>",
    "images": "path string, page long, width int, height int, url string",
    "index": "path string, start long, stop long, pages long",
}
NEVER = 1 << 62


class Ranges(D.InputPartition):
    """(file, first byte, byte behind the last, number of the first page) of what one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]) -> None:
        self.ranges = ranges


def pages_between(handle, start: int, stop: int, chunk: int = CHUNK) -> Iterator[bytes]:
    """The pages that begin in [start, stop), each whole."""
    at, mine, held = max(start - 1, 0), start == 0, []
    handle.seek(at)
    while piece := handle.read(chunk):
        for i, part in enumerate(piece.split(b"\f")):
            if i:
                if mine:
                    yield b"".join(held)
                if at >= stop:
                    return
                mine, held = True, []
            if mine:
                held.append(part)
            at += len(part) + 1
        at -= 1
    if mine and any(held):
        yield b"".join(held)


def count_pages(handle, start: int, stop: int) -> int:
    """How many pages begin in [start, stop): form feeds one byte earlier, and the file's first page."""
    handle.seek(max(start - 1, 0))
    left, found = stop - 1 - max(start - 1, 0), int(start == 0 and stop > 0)
    while left > 0 and (piece := handle.read(min(CHUNK, left))):
        found, left = found + piece.count(b"\f"), left - len(piece)
    return found


def png(text: str, wrap: int) -> tuple[int, int, bytes]:
    """Width, height and bytes of a grey image of the page: a dot a cell, black where there is ink, lines cut at `wrap` cells."""
    rows = [line[i : i + wrap] for line in text.split("\n") for i in range(0, max(len(line), 1), wrap)]
    width = max(1, *map(len, rows))
    dots = np.full((len(rows), width + 1), 255, np.uint8)
    dots[:, 0] = 0  # each row begins with its filter's number
    for i, row in enumerate(rows):
        codes = np.frombuffer(row.encode("utf-32-le"), "<u4")
        dots[i, 1 : len(codes) + 1] = np.where((codes == 32) | ((codes >= 9) & (codes <= 13)), 255, 0)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return width, len(rows), b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(dots.tobytes())) + chunk(b"IEND", b"")


class PagesReader(D.DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.what, self.index = options["path"], options.get("what", "pages"), options.get("index")
        self.size, self.wrap = int(float(options.get("split_mb", SPLIT_MB)) * (1 << 20)), int(options.get("wrap", 120))
        self.low, self.high = 1, NEVER

    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:  # noqa: N802
        """Bounds on `page` are kept here; all others are left to Spark."""
        for f in filters:
            if self.what == "index" or getattr(f, "attribute", None) != ("page",) or isinstance(getattr(f, "value", None), bool):
                yield f
            elif isinstance(f, D.EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif isinstance(f, D.GreaterThanOrEqual | D.GreaterThan):
                self.low = max(self.low, f.value + isinstance(f, D.GreaterThan))
            elif isinstance(f, D.LessThanOrEqual | D.LessThan):
                self.high = min(self.high, f.value - isinstance(f, D.LessThan))
            elif not isinstance(f, D.IsNotNull):
                yield f

    def _files(self) -> list[tuple[str, int]]:
        fs, at = FileSystem.from_uri(self.path)
        info = fs.get_file_info(at)
        found = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(at, recursive=True))
        return sorted((f.path, f.size) for f in found if f.type == FileType.File and f.size and not f.base_name.startswith((".", "_")))

    def _ranges(self) -> Iterator[tuple[str, int, int, int]]:
        if self.what == "index":
            yield from ((p, a, min(a + self.size, n), 0) for p, n in self._files() for a in range(0, n, self.size))
        elif not self.index:
            yield from ((p, 0, n, 1) for p, n in self._files())
        else:
            fs, at = FileSystem.from_uri(self.index)
            wanted = (pads.field("first") <= self.high) & (pads.field("first") + pads.field("pages") > self.low) & (pads.field("pages") > 0)
            rows = pads.dataset(at, filesystem=fs, format="parquet").to_table(columns=["path", "start", "stop", "first"], filter=wanted)
            yield from sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True))

    def partitions(self) -> list[Ranges]:
        """Ranges put together up to the size of a split."""
        out: list[list] = []
        room = 0
        for r in self._ranges():
            if not out or r[2] - r[1] > room:
                out.append([])
                room = self.size
            out[-1].append(r)
            room -= r[2] - r[1]
        return [Ranges(r) for r in out] or [Ranges([])]

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"images": [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string()], "index": [pa.string(), pa.int64(), pa.int64(), pa.int64()]}[self.what]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMAS[self.what].split(", ")])

    def _nested(self, pages: list[tuple[str, int, str]]) -> pa.RecordBatch:
        """A row a page: its lines with words, as arrays by offsets."""
        texts, begins, ends, tops, words_upto, lines_upto = [], [], [], [], [0], [0]
        for _, _, text in pages:
            for i, line in enumerate(text.split("\n")):
                found = [(m[0], m.start(), m.end()) for m in WORD.finditer(line)]
                if found:
                    for to, values in zip((texts, begins, ends), zip(*found, strict=True), strict=True):
                        to.extend(values)
                    tops.append(i)
                    words_upto.append(len(texts))
            lines_upto.append(len(tops))
        cells = [pa.array(np.array(x, np.float64) * CELL) for x in (begins, ends)]
        words = pa.StructArray.from_arrays([pa.array(texts, pa.string()), *cells], ["text", "x0", "x1"])
        lines = pa.StructArray.from_arrays([pa.array(np.array(tops, np.float64) * LINE), pa.ListArray.from_arrays(pa.array(words_upto, pa.int32()), words)], ["top", "words"])
        return pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in pages]), pa.array([p[1] for p in pages], pa.int64()), pa.ListArray.from_arrays(pa.array(lines_upto, pa.int32()), lines)], ["path", "page", "lines"]
        )

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs = FileSystem.from_uri(self.path)[0]
        made = self._nested if self.what == "pages" else self._batch
        rows: list[tuple] = []
        weight = 0
        for path, start, stop, first in partition.ranges:
            with fs.open_input_file(path) as handle:
                if self.what == "index":
                    rows.append((path, start, stop, count_pages(handle, start, stop)))
                    continue
                for page, raw in enumerate(pages_between(handle, start, stop), first):
                    if page > self.high:
                        break
                    if page < self.low:
                        continue
                    text = raw.decode("utf-8", "replace")
                    if self.what == "images":
                        width, height, image = png(text, self.wrap)
                        text = "data:image/png;base64," + base64.b64encode(image).decode()
                        rows.append((path, page, width, height, text))
                    else:
                        rows.append((path, page, text))
                    weight += len(text)
                    if weight > CHUNK:
                        yield made(rows)
                        rows, weight = [], 0
        if rows:
            yield made(rows)


class TextPages(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMAS[self.options.get("what", "pages")]

    def reader(self, schema) -> PagesReader:  # noqa: ARG002
        return PagesReader(dict(self.options))


def _load(spark: SparkSession, path: str, what: str, **options: object) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TextPages)
    return spark.read.format(NAME).options(what=what, path=path, **{k: v for k, v in options.items() if v is not None}).load()


def index(spark: SparkSession, path: str, out: str, split_mb: float = SPLIT_MB) -> str:
    """Writes (path, start, stop, pages, first) of the byte ranges of all files to the folder out: how many pages begin in each, from which number on."""
    ranges = _load(spark, path, "index", split_mb=split_mb)
    before = W.partitionBy("path").orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # a row a range
    ranges.withColumn("first", F.coalesce(F.sum("pages").over(before), F.lit(0)) + 1).write.parquet(out)
    return out


def pages(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """(path, page, lines) with the words of each line that has any in order: top, words (text, x0, x1); index: a folder written by `index`."""
    return _load(spark, path, "pages", index=index)


def words(spark: SparkSession, path: str, index: str | None = None) -> DataFrame:
    """(path, page, text, x0, x1, top, bottom) of all words."""
    lines = pages(spark, path, index).select("path", "page", F.explode("lines").alias("l")).select("path", "page", "l.top", F.explode("l.words").alias("w"))
    return lines.select("path", "page", "w.*", "top", (F.col("top") + LINE).alias("bottom"))


def images(spark: SparkSession, path: str, index: str | None = None, wrap: int = 120) -> DataFrame:
    """(path, page, width, height, url) of a rough image of each page as a data URL: ink as dots, no letters, as no font comes with this library."""
    return _load(spark, path, "images", index=index, wrap=wrap)


def write(df: DataFrame, path: str, column: str = "text") -> None:
    """A page a row, null as an empty one; a form feed inside becomes a blank."""
    df.select(F.translate(F.coalesce(column, F.lit("")), "\f", " ").alias("value")).write.option("lineSep", "\f").text(path)
