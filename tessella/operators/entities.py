"""Entities with names and spellings, their merging and their mentions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.folding import fold, folded
from tessella.operators.joins import double_index
from tessella.operators.mentions import mention_frequency, surface_frequency
from tessella.operators.skew import lookup_hot
from tessella.session import materialize, settle

__all__ = ["find_folded", "fold", "folded", "folded_places", "folded_spot", "mention_frequency", "merge_entities", "merge_ordered", "source_frequency", "surface_frequency"]


def folded_places(t: str) -> tuple[str, list[int]]:
    """A folded text, and for each of its characters the own place of the one it came from."""
    chars, places = [], []
    for i, c in enumerate(t):
        for x in unicodedata.normalize("NFKD", c):
            if not unicodedata.combining(x):
                chars.append(x.lower()[0] if x.lower() else x)
                places.append(i)
    return "".join(chars).replace("—", "-").replace("–", "-"), places


def folded_spot(t: str, places: list[int], at: int, size: int) -> tuple[int, int]:
    """Own start and end of the folded characters from `at`, with the marks that follow."""
    start, end = places[at], places[at + size - 1] + 1
    while end < len(t) and unicodedata.combining(t[end]):
        end += 1
    return start, end


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])))
def find_folded(text: pd.Series, wanted: pd.Series) -> pd.Series:
    """Where folded names stand in a text: offsets and the text in its own spelling, through a map of folded to own places."""

    def one(t: str, w: str) -> list[dict]:
        flat, places = folded_places(t or "")
        key, out, at = fold(w), [], 0
        while key and (at := flat.find(key, at)) >= 0:
            start, end = folded_spot(t, places, at, len(key))
            out.append({"start": start, "end": end, "text": t[start:end]})
            at += 1
        return out

    return pd.Series([one(t, w) for t, w in zip(text, wanted, strict=True)])


class _Ordered:
    """A19, one entry after the other: each joins the first one before it that shares a folded name; not transitive, as the first such decides.
    Holds the merged entries and, by folded name, the first of them that has it."""

    def __init__(self) -> None:
        self.merged: list[dict] = []
        self.first: dict[str, int] = {}

    def take(self, e: dict, place: int = 0) -> None:
        own = {fold(n) for n in e["names"]} - {""}
        at = min((self.first[k] for k in own if k in self.first), default=None)
        if at is None:
            at = len(self.merged)
            self.merged.append({"display": e["display"], "names": set(), "spellings": set(), "sources": set(), "place": place})
        for field in ("names", "spellings", "sources"):
            self.merged[at][field].update(e[field])
        for k in own:
            self.first[k] = min(at, self.first.get(k, at))


def merge_ordered(entries: Iterable[dict]) -> list[dict]:
    """A19 over a list. Of merged entries whose folded display names agree the last stays."""
    state = _Ordered()
    for e in entries:
        state.take(e)
    return [{k: v for k, v in m.items() if k != "place"} for m in {fold(m["display"]): m for m in state.merged}.values()]


_ENTITY = "display string, names array<string>, spellings array<string>, sources array<string>"


def _roots(names: DataFrame) -> DataFrame:
    """(id, root) of the components of ids (id, key) that share keys: the least key spreads through shared names until none changes."""
    now = names.groupBy("id").agg(F.min("key").alias("root"))
    while True:
        least = materialize(names.join(now, "id").groupBy("key").agg(F.min("root").alias("root"), F.count("*").alias("n")), "least")
        new = materialize(lookup_hot(names, least, ["key"], "n", F.col("id")).groupBy("id").agg(F.min("root").alias("root")), "roots")
        if new.join(now.withColumnRenamed("root", "before"), "id").filter("root <> before").isEmpty():
            return new
        now = new


def merge_entities(df: DataFrame, order: str, mode: str = "ordered") -> DataFrame:
    """A19 over (display, names, spellings, sources). 'ordered' follows the order exactly: entries without a common name never meet, so each component of
    shared folded names is folded alone, in order, by one task that holds its merged entries and not its rows. 'components' joins all that share names,
    however indirectly. order: a column of distinct values. Null names count as none; nulls in the lists are left out."""
    lists = ("names", "spellings", "sources")
    clean = df.select(F.col(order).alias("id"), "display", *(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in lists))

    def build() -> DataFrame:
        rows = materialize(clean, "entities")
        names = materialize(rows.select("id", F.explode("names").alias("n")).withColumn("key", folded("n")).filter("key <> ''").select("id", "key").distinct(), "entity-names")
        rooted = rows.join(_roots(names), "id", "left").withColumn("root", F.coalesce(F.concat(F.lit("n"), "root"), F.concat(F.lit("i"), F.col("id").cast("string"))))
        if mode == "components":
            sets = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
            return rooted.groupBy("root").agg(F.min_by("display", "id").alias("display"), *sets).select("display", *lists)
        numbered = rooted.select("root", "id", "display", *lists).repartition("root").sortWithinPartitions("root", "id")
        # Of merged entries with one folded display name the last stays: the one whose first entry came last.
        merged = numbered.mapInPandas(_fold_components, f"place {df.schema[order].dataType.simpleString()}, key string, {_ENTITY}")
        return merged.groupBy("key").agg(F.max_by(F.struct("display", *lists), "place").alias("e")).select("e.*")

    return settle(df.sparkSession, build, "merged-entities")


def _fold_components(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of components in order, each component's fold alone."""
    root, state = None, _Ordered()

    def out() -> pd.DataFrame:
        rows = [{"place": m["place"], "key": fold(m["display"]), "display": m["display"], **{k: sorted(m[k]) for k in ("names", "spellings", "sources")}} for m in state.merged]
        return pd.DataFrame(rows, columns=["place", "key", "display", "names", "spellings", "sources"])

    for part in parts:
        for r in part.to_dict("records"):
            if r["root"] != root:
                if state.merged:
                    yield out()
                root, state = r["root"], _Ordered()
            state.take(r, r["id"])
    if state.merged:
        yield out()


def source_frequency(tokens: DataFrame, exact: DataFrame, loose: DataFrame, key: str, token: str, folded_token: str, entry: str) -> DataFrame:
    """The larger of exact and folded counts by row (J15), summed; and rows."""
    return double_index(tokens, exact, loose, [key], token, folded_token, entry).groupBy(entry).agg(F.sum("n").alias("mention_count"), F.countDistinct(key).alias("row_count"))
