"""Many names or spellings found in texts at once, by automata with goto and fail links.

Names are dealt to blocks of at most BLOCK, whatever their lengths; a block is broadcast after its size is known, and each text runs once through its
automaton, in time linear in the text and its hits. With one block, which most dictionaries are, a row's mentions are settled where they are found;
with more, hits meet by row and are settled there. Nothing is paired with texts in which it doesn't stand.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.rules import NAME_BOUNDARY
from tessella.operators.folding import fold, folded
from tessella.session import materialize, ship

#: Most names of one automaton, which driver and workers hold at once.
BLOCK = 200_000

_built: dict[str, tuple] = {}


def _automaton(values: dict[str, object]) -> ahocorasick.Automaton | None:
    out = ahocorasick.Automaton()
    for key, value in values.items():
        out.add_word(key, (len(key), value))
    if not values:
        return None
    out.make_automaton()
    return out


def _once(name: str, make: Callable[[], tuple]) -> tuple:
    """A worker keeps the automata of one block: the last it was asked for."""
    if name not in _built:
        _built.clear()
        _built[name] = make()
    return _built[name]


@cache
def _inside(boundary: str) -> Callable[[str], bool]:
    """Whether a character belongs to a name."""
    match = re.compile(f"[{boundary}]").match
    return cache(lambda c: match(c) is not None)


def hits(text: str, automaton: ahocorasick.Automaton | None, boundary: str | None) -> Iterator[tuple[int, int, object]]:
    """(start, end, value) of all occurrences; boundary: of those between characters that aren't in the class."""
    if automaton is None or not text:
        return
    inside, n = _inside(boundary) if boundary else None, len(text)
    for last, (size, value) in automaton.iter(text):
        start, end = last + 1 - size, last + 1
        if not inside or not ((start and inside(text[start - 1])) or (end < n and inside(text[end]))):
            yield start, end, value


def leftmost_longest(found: list[tuple[int, int, str]]) -> list[tuple[int, str]]:
    """(start, value) of the hits that a search for any of the names takes from left to right: the first place, there the longest."""
    out, free = [], 0
    for start, negative, value in sorted((s, -e, v) for s, e, v in found):
        if start >= free:
            out.append((start, value))
            free = -negative
    return out


def _first(found: list[tuple[int, int, str]], surfaces: dict[str, tuple[int, str]]) -> list[tuple[str, str, int]]:
    """(entry, name, place) of the entries taken, each once, that also stand in the text in a spelling of their own."""
    at: dict[str, int] = {}
    for start, entry in leftmost_longest(found):
        if entry in surfaces:
            at.setdefault(entry, start)
    return [(entry, surfaces[entry][1], start) for entry, start in at.items()]


def _surfaces(text: str, automaton: ahocorasick.Automaton | None, boundary: str) -> dict[str, tuple[int, str]]:
    """The longest own spelling of each entry that stands in the text; of ties the last in order."""
    own = {text[start:end]: entries for start, end, entries in hits(text, automaton, boundary)}  # each name once, however often it stands there
    out: dict[str, tuple[int, str]] = {}
    for n, entries in own.items():
        told = (len(n), n)
        for e in entries:
            if e not in out or told > out[e]:
                out[e] = told
    return out


def _blocks(names: DataFrame, key: str) -> Iterator[tuple[str, object, int]]:
    """(name, broadcast rows, number of blocks): the rows of names, dealt by their key. Each block is collected alone."""
    spark = names.sparkSession
    n = names.count()
    many = max(1, -(-2 * n // BLOCK)) if n > BLOCK else 1
    dealt = names.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(many)))
    dealt = materialize(dealt, "name-blocks") if many > 1 else dealt
    for b in range(many):
        rows = [tuple(r)[:-1] for r in (dealt.filter(F.col("_block") == b) if many > 1 else dealt).collect()]
        sent = spark.sparkContext.broadcast(rows)
        yield f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id()}", sent, many


def _name_automata(rows: list[tuple[str, str, str, str]]) -> tuple:
    """Of (folded, winner, name, entry): folded name to the entry that has it, own name to all entries with it."""
    own: dict[str, set[str]] = {}
    for _, _, name, entry in rows:
        own.setdefault(name, set()).add(entry)
    return _automaton({f: w for f, w, _, _ in rows if f}), _automaton({k: tuple(v) for k, v in own.items() if k})


_FOUND = "entry string, name string, pos long"


def mentions(docs: DataFrame, names: DataFrame, key: str, text: str, entry: str, name: str, boundary: str = NAME_BOUNDARY) -> DataFrame:
    """(key, entry, name, pos) of the entries that a row mentions, each once: by a folded name of theirs in the folded text, from left to right the longest
    first, between characters that aren't in `boundary`; and only if one of their names stands in the text as it is written. name: the longest such;
    pos: the first place in the folded text. Of entries that share a folded name the last has it. Names of any length; null texts mention nothing."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    told = names.select(folded(F.col(name)).alias("_f"), F.col(entry).cast("string").alias("_e"), F.array_join(F.filter(F.split(F.col(name), r"\s+"), lambda x: x != ""), " ").alias("_n"), F.col(entry).alias("_o"))
    told = told.dropDuplicates(["_f", "_e", "_n"])  # empty ones are left out where automata are made
    winners = told.groupBy("_f").agg(F.max_by("_e", "_o").alias("_w"))
    told = told.join(winners, "_f").select("_f", "_w", "_n", "_e")
    every = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL")
    parts, rows = [], every
    for block, sent, many in _blocks(told, "_f"):
        if many > 1 and not parts:
            rows = materialize(every.withColumn("r", F.monotonically_increasing_id()), "texts")

        def alone(batches: Iterator[pa.RecordBatch], block: str = block, sent: object = sent) -> Iterator[pa.RecordBatch]:
            flat, own = _once(block, lambda: _name_automata(sent.value))
            for b in batches:
                out: tuple[list, ...] = ([], [], [], [])
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    found = list(hits(f" {fold(t)} ", flat, boundary))
                    for x in _first(found, _surfaces(t, own, boundary)) if found else ():
                        for column, v in zip(out, (k, *x), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], b.schema[0].type), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], ["k", "entry", "name", "pos"])

        def raw(batches: Iterator[pa.RecordBatch], block: str = block, sent: object = sent) -> Iterator[pa.RecordBatch]:
            flat, own = _once(block, lambda: _name_automata(sent.value))
            for b in batches:
                out: tuple[list, ...] = ([], [], [], [], [])
                for r, t in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for s, e, x in hits(f" {fold(t)} ", flat, boundary):
                        for column, v in zip(out, (r, s, e, x, None), strict=True):
                            column.append(v)
                    for x, (size, n) in _surfaces(t, own, boundary).items():
                        for column, v in zip(out, (r, -1, size, x, n), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["r", "s", "e", "entry", "name"])

        if many == 1:
            found = rows.mapInArrow(alone, f"k {kind}, {_FOUND}")
            return found.select(F.col("k").alias(key), F.col("entry").alias(entry), F.col("name").alias(name), "pos")
        parts.append(rows.mapInArrow(raw, "r long, s long, e long, entry string, name string"))
    met = parts[0]
    for p in parts[1:]:
        met = met.unionAll(p)

    def settled(part: pd.DataFrame) -> pd.DataFrame:
        surfaces: dict[str, tuple[int, str]] = {}
        for x in part[part["s"] < 0].itertuples():
            surfaces[x.entry] = max(surfaces.get(x.entry, (0, "")), (x.e, x.name))
        own = part[part["s"] >= 0]
        found = _first(list(zip(own["s"], own["e"], own["entry"], strict=True)), surfaces)
        return pd.DataFrame([(part["r"].iloc[0], *f) for f in found], columns=["r", "entry", "name", "pos"])

    found = met.groupBy("r").applyInPandas(settled, f"r long, {_FOUND}")
    return rows.select("r", "k").join(found, "r").select(F.col("k").alias(key), F.col("entry").alias(entry), F.col("name").alias(name), "pos")


def present(docs: DataFrame, wanted: DataFrame, spellings: DataFrame, key: str, text: str, entry: str, spelling: str, fold_both: bool = False) -> DataFrame:
    """(key, entry) of the rows' wanted entries (key, entry) one of whose spellings stands anywhere in the text; fold_both: but for accents and case."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[key].dataType.simpleString()
    asked = wanted.groupBy(F.col(key).alias("k")).agg(F.collect_set(F.col(entry).cast("string")).alias("want"))  # no more than the row's own mentions
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t IS NOT NULL").join(asked, "k").select("k", "t", "want")
    told = spellings.select(F.col(spelling).alias("_s"), F.col(entry).cast("string").alias("_e")).filter("_s <> ''").distinct()
    out = None
    for block, sent, _ in _blocks(told, "_s"):

        def scan(batches: Iterator[pa.RecordBatch], block: str = block, sent: object = sent) -> Iterator[pa.RecordBatch]:
            def make() -> tuple:
                own: dict[str, set[str]] = {}
                for s, e in sent.value:
                    own.setdefault(fold(s) if fold_both else s, set()).add(e)
                return (_automaton({s: tuple(e) for s, e in own.items() if s}),)

            (automaton,) = _once(block, make)
            for b in batches:
                keys, entries = [], []
                for k, t, want in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                    left = set(want)
                    for _, _, found in hits(fold(t) if fold_both else t, automaton, None):
                        for e in left.intersection(found):
                            keys.append(k)
                            entries.append(e)
                            left.discard(e)
                        if not left:
                            break
                yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema[0].type), pa.array(entries, pa.string())], ["k", "entry"])

        part = rows.mapInArrow(scan, f"k {kind}, entry string")
        out = part if out is None else out.unionAll(part)
    return out.distinct().select(F.col("k").alias(key), F.col("entry").alias(entry))


def missing_matches(found: DataFrame, docs: DataFrame, spellings: DataFrame, key: str, entry: str, source: str, spelling: str, loose: str | None = None) -> DataFrame:
    """The mentions (key, entry, ...) none of whose entry's spellings stands in the row's source. Both are compared as `text.match_key` has them;
    spellings whose flag `loose` is set also but for accents and case, as those of an onomasticon are."""
    from tessella.functions.text import match_key

    wanted = found.select(key, entry).distinct()
    spelled = spellings.select(F.col(entry), match_key(F.col(spelling)).alias("_s"), (F.coalesce(F.col(loose), F.lit(False)) if loose else F.lit(False)).alias("_loose")).filter("_s <> ''")
    texts = docs.select(F.col(key), match_key(F.col(source)).alias("_t"))
    there = present(texts, wanted, spelled, key, "_t", entry, "_s")
    if loose:
        more = present(texts, wanted, spelled.filter("_loose"), key, "_t", entry, "_s", fold_both=True)
        there = there.unionAll(more).distinct()
    return found.join(there, [key, entry], "left_anti")


def mention_frequency(docs: DataFrame, names: DataFrame, key: str, text: str, entry: str, name: str, boundary: str = NAME_BOUNDARY) -> DataFrame:
    """Per entry how many mentions and rows; an entry counts once a row."""
    return mentions(docs, names, key, text, entry, name, boundary).groupBy(entry).agg(F.count("*").alias("mention_count"), F.countDistinct(key).alias("row_count"))


def surface_frequency(docs: DataFrame, names: DataFrame, key: str, text: str, entry: str, name: str, boundary: str = NAME_BOUNDARY) -> DataFrame:
    """The longest of an entry's names that stands in the text as it is written, counted over rows."""
    return mentions(docs, names, key, text, entry, name, boundary).groupBy(F.col(name).alias("surface")).agg(F.count("*").alias("mention_count"), F.countDistinct(key).alias("row_count"))
