"""Quality rules: text statistics and cross-document line frequency by host.

Each text's statistics come from its bytes in one pass. Normalised lines (white space runs as one space,
A-Z lowered, digits as 0) are hashed; (host, line) pairs found in more than MAX_DOCS documents of the host
are above the limit and are removed from all of them but the smallest doc_id, so that of copies one
stays. A document that loses more than MAX_LOST of its words to removed lines, or keeps fewer than
MIN_WORDS, is depleted and rejected. `quality_rules` judges, `clean` gives the texts without the removed lines.

Defined cases: null text has no word and fails the base rules; null host is a host of its own; a row
without doc_id has its statistics but no part in line counts; repeated rows each get a row and count once;
a doc_id on several texts is one document in the counts, and each text loses its own lines; a line found as
often as the limit stays, only one found more often goes; a very long text goes through a worker by itself;
an empty table gives an empty result; other columns are ignored. Every line with a word counts, however short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.session import materialize, settle, ship

MIN_WORDS, MAX_REPEAT = 10, 20
MAX_DOCS, MAX_LOST = 10, 80
SYMBOLS = b"#*$%&|<>"
U = np.uint64

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48
_NORMAL[[9, 11, 12, 13]] = 32


def _per(doc: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weight, minlength=n).astype(np.int64)


def _runs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal values of a document together, and the size of each place's run in that order."""
    key = value + doc.astype(np.uint64) * U(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (d[1:] != d[:-1])))) if len(k) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate((edge, [len(k)])))
    return order, np.repeat(size, size)


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words by document; and line_doc, line_hash, line_words of the normalised lines with a word and where they begin and end."""
    n = len(offsets) - 1
    starts, ends, docs, word = tb.words(data, offsets)
    out = {"n_words": _per(docs, n)}
    point = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out["word_chars"] = _per(docs, n, point[ends] - point[starts])
    at = np.flatnonzero(_SYMBOL[data])
    out["n_symbols"] = _per(np.searchsorted(offsets, at, side="right") - 1, n)
    # Words in windows of five that come twice or more.
    first, wdoc, value = tb.windows(word, docs, n)
    full = _per(docs, n)[wdoc] >= 5
    first, wdoc, value = first[full], wdoc[full], value[full]
    order, size = _runs(wdoc, value)
    hit = first[order[size > 1]]
    cover = np.zeros(len(word) + 6, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + 5, -1)
    out["n_repeat_words"] = _per(docs[np.cumsum(cover)[: len(word)] > 0], n)
    # Lines: split at \n, document bounds end them too. An empty line has no word and counts for nothing.
    begin, end = tb.spans(data != 10, offsets)
    ldoc = np.searchsorted(offsets, begin, side="right") - 1
    lwords = np.searchsorted(starts, end) - np.searchsorted(starts, begin)
    some = lwords > 0
    begin, end, ldoc, lwords = begin[some], end[some], ldoc[some], lwords[some]
    raw = tb.hashed(tb.prefix(data), begin, end)
    order, size = _runs(ldoc, raw)
    distinct = np.zeros(n, np.float64)
    np.add.at(distinct, ldoc[order], 1.0 / np.maximum(size, 1))
    out["n_dup_lines"] = _per(ldoc, n) - np.rint(distinct).astype(np.int64)
    # Normalised: the line's words with case and digits folded, so that white space doesn't matter.
    folded = tb.hashed(tb.prefix(_NORMAL[data]), starts, ends)
    a, b = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    place = np.arange(len(folded), dtype=np.int64) - np.repeat(a, b - a) if len(folded) else np.zeros(0, np.int64)
    powers, _ = tb._power(len(folded) + 1)
    total = np.concatenate((np.zeros(1, U), np.cumsum(folded * powers[place])))
    line = tb.mix(total[b] - total[a] + (b - a).astype(np.uint64))
    out |= {"line_doc": ldoc, "line_hash": line, "line_words": lwords, "line_begin": begin, "line_end": end}
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tb.chunks(batch.column(3)):
            s = statistics(data, offsets)
            n = j - i
            order = np.lexsort((s["line_hash"], s["line_doc"]))
            doc, line, count = s["line_doc"][order], s["line_hash"][order], s["line_words"][order]
            edge = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (line[1:] != line[:-1])))) if len(doc) else np.zeros(0, np.int64)
            count = np.add.reduceat(count, edge) if len(edge) else count
            doc, line = doc[edge], line[edge]
            at = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n)))).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(line.view(np.int64)), pa.array(count.astype(np.int64))], ["h", "w"])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k).slice(i, n) for k in range(3)), *(pa.array(s[c]) for c in _COUNTS), pa.ListArray.from_arrays(pa.array(at), items)],
                [*_KEYS, *_COUNTS, "lines"],
            )


#: What a row's removed lines hang on: its document, its text and its host.
_KEYS = ("doc_id", "t", "host")


def _rows(docs: DataFrame, doc_col: str, host_col: str, text_col: str) -> DataFrame:
    host = F.xxhash64(F.coalesce(F.col(host_col).cast("string"), F.lit("\0")))
    return docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), host.alias("host"), F.col(text_col).alias("text"))


def _removed(measured: DataFrame, max_docs: int) -> DataFrame:
    """(doc_id, t, host, h, w): the lines that go, with their words in the text."""
    lines = measured.filter("doc_id is not null").select(*_KEYS, F.explode("lines").alias("l")).select(*_KEYS, "l.h", "l.w").distinct()
    frequent = lines.select("host", "h", "doc_id").distinct().groupBy("host", "h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter(F.col("n") > max_docs)
    # One text has a line's hash once, so a hot line's rows differ in their keys and AQE may split them.
    return lines.join(frequent.select("host", "h", "first"), ["host", "h"]).filter("doc_id > first")


def _judged(docs: DataFrame, max_docs: int, max_lost: int) -> DataFrame:
    schema = ", ".join(["doc_id long, t long, host long", *(f"{c} long" for c in _COUNTS), "lines array<struct<h: long, w: long>>"])
    rows = materialize(docs.mapInArrow(_measure, schema), "line-counts")
    lost = _removed(rows, max_docs).groupBy(*_KEYS).agg(F.sum("w").alias("lost"), F.collect_list("h").alias("gone"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    lost_words = F.coalesce("lost", F.lit(0))
    depleted = (100 * lost_words > max_lost * F.col("n_words")) | ((lost_words > 0) & (F.col("n_words") - lost_words < MIN_WORDS))
    out = rows.drop("lines").join(lost, [*_KEYS], "left")
    return out.select(*_KEYS, *_COUNTS, lost_words.alias("n_lost_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "gone")


def quality_rules(docs: DataFrame, doc_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """Per row: the statistics, n_lost_words, base_failed and kept."""
    ship(docs.sparkSession)
    rows = _rows(docs, doc_col, host_col, text_col)
    out = settle(docs.sparkSession, lambda: _judged(rows, max_docs, max_lost).drop("t", "host", "gone"), "quality")
    return out.withColumnRenamed("doc_id", doc_col)


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tb.chunks(batch.column(1)):
            s = statistics(data, offsets)
            gone = batch.column(2).slice(i, j - i)
            hashes = gone.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            of = gone.fill_null([]).value_lengths().to_numpy(zero_copy_only=False)
            wanted = np.sort(hashes + np.repeat(np.arange(j - i, dtype=np.uint64), of) * U(0x9E3779B97F4A7C15))
            key = s["line_hash"] + s["line_doc"].astype(np.uint64) * U(0x9E3779B97F4A7C15)
            at = np.searchsorted(wanted, key)
            hit = np.zeros(len(key), bool)
            hit[at < len(wanted)] = wanted[at[at < len(wanted)]] == key[at < len(wanted)]
            # A line goes with the \n after it, or with the one before it where it ends the text.
            doc, begin, end = s["line_doc"][hit], s["line_begin"][hit], s["line_end"][hit]
            last = end == offsets[doc + 1]
            edges = np.zeros(len(data) + 2, np.int64)
            np.add.at(edges, np.where(last, np.maximum(begin - 1, offsets[doc]), begin), 1)
            np.add.at(edges, np.where(last, end, end + 1), -1)
            stay = np.cumsum(edges)[: len(data)] <= 0
            sizes = np.concatenate(([0], np.cumsum(stay)))[offsets]
            texts = pa.StringArray.from_buffers(j - i, pa.py_buffer(sizes.astype(np.int32).tobytes()), pa.py_buffer(data[stay].tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), texts], ["doc_id", "text"])


def clean(docs: DataFrame, doc_col: str = "doc_id", host_col: str = "source", text_col: str = "text", max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST) -> DataFrame:
    """(doc_col, text) of the rows that are kept, without their removed lines; repeated rows stay repeated."""
    spark = docs.sparkSession
    ship(spark)
    rows = _rows(docs, doc_col, host_col, text_col)
    verdicts = settle(spark, lambda: _judged(rows, max_docs, max_lost).filter("kept").select(*(F.col(k).alias(f"{k}_of") for k in _KEYS), "gone").dropDuplicates([f"{k}_of" for k in _KEYS]), "verdicts")
    joined = rows.join(verdicts, [F.col(k).eqNullSafe(F.col(f"{k}_of")) for k in _KEYS])
    return joined.select("doc_id", "text", "gone").mapInArrow(_without, "doc_id long, text string").withColumnRenamed("doc_id", doc_col)
