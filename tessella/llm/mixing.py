"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of (source, language, topic); a cell's mass is its number of words. Raking
scales the cells' weights to each marginal's target shares in turn until all three agree. The targets
follow from the data: a share to the power TEMPER, then normalised, which lifts small categories; callers
may give shares of their own. A document's probability is min(1, scale * fitted weight / mass of its cell),
with one scale such that the expected words are FRACTION of all; it is sampled where a hash of its doc_id,
as a number from 0 to 1, lies below.

The topic of a text is a cluster of its words. Each word of 4 letters or more votes for the topic that a table of
SLOTS word hashes gives it, and the topic with most votes is the text's. The table comes from all words of all rows:
one pass sums the products of the slots' weights (logarithms of counts, of one length for each text) in whole numbers,
so that the order of rows doesn't matter; each language's mean is taken off so that topics are not languages; and
k-means by cosine over the main directions of that covariance deals the slots to topics.

Cells are aggregated first. Up to LOCAL_CELLS of them are raked on the driver in numpy; beyond that bound, and
by the same steps, by joins and aggregates of cell tables. Raking ends when no margin is off by more than
TOLERANCE; if it isn't there after ROUNDS, as where targets and empty cells contradict each other, a warning says
how far off it is.

Defined cases: null source or language is a category of its own, spelled ''; a row without doc_id is never sampled; a text without words (null
ones too) has mass 0, topic 0 and its cell's probability; texts whose words have no slot have topic 0; the least of the
topics with most votes wins; repeated rows each get a row and are sampled alike; a very long text is read by Spark's own
string functions as a whole; an empty table gives an empty result; other columns are kept by `sample` and ignored by `weights`.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping
from functools import reduce
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.regex import let
from tessella.session import materialize, settle, ship

TEMPER, FRACTION, TOPICS, ROUNDS, LOCAL_CELLS, TOLERANCE = 0.7, 0.8, 8, 1000, 200_000, 1e-9
#: The topic model: word hashes, rounds of k-means.
SLOTS, STEPS = 1024, 20
#: Length of a text's vector of whole numbers, texts multiplied at once (_LENGTH**2 * _TEXTS <= 2**24, which float32 holds), rows of a block of products,
#: languages whose sums a task holds.
_LENGTH, _TEXTS, _ROWS, _LANGS = 256, 256, 32, 1000
#: A topic's mark in the string of a text's votes.
_MARKS = "0123456789abcdefghijklmnopqrstuvwxyz"
BISECTIONS = 100
MARGINS = ("source", "lang", "topic")
_WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_WORD)).cast("long")


def _slots(text: Column) -> Column:
    """The slots of a text's words of 4 letters or more."""
    long = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) >= 4)
    return F.transform(long, lambda w: F.pmod(F.xxhash64(w), F.lit(SLOTS)).cast("int"))


def _table(key: list[str], sums: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate([v.ravel() for v in sums]).astype(np.int64) if sums else np.zeros(0, np.int64)
    ends = np.cumsum([0, *(v.size for v in sums)])
    return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["k", "v"])


def _blocks(gram: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, SLOTS, _ROWS):
        yield _table([f"g{i:04}"], [gram[i : i + _ROWS]])


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (lang, slots) the sums of a task: blocks of products g, rows by slot d with their number behind, and l: vectors by language with their number."""
    gram, seen, langs = np.zeros((SLOTS, SLOTS)), np.zeros(SLOTS + 1, np.int64), {}
    for batch in batches:
        for at in range(0, batch.num_rows, _TEXTS):
            b = batch.slice(at, _TEXTS)
            n, slots = b.num_rows, b.column(1)
            of = np.repeat(np.arange(n), np.diff(slots.offsets.to_numpy()))
            x = np.log1p(np.bincount(of * SLOTS + slots.flatten().to_numpy(), minlength=n * SLOTS).reshape(n, SLOTS))
            x = np.rint(x * (_LENGTH / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)))
            single = x.astype(np.float32)
            gram += single.T @ single
            seen[:-1] += (x > 0).sum(axis=0)
            seen[-1] += n
            names = np.array(b.column(0).to_pylist(), object)
            for name in dict.fromkeys(names):
                own = names == name
                mine = langs.setdefault(name, np.zeros(SLOTS + 1, np.int64))
                mine[:-1] += x[own].sum(axis=0).astype(np.int64)
                mine[-1] += int(own.sum())
            if len(langs) > _LANGS:
                yield _table([f"l{k}" for k in langs], list(langs.values()))
                langs.clear()
    if seen[-1]:
        yield from _blocks(gram)
        yield _table(["d", *(f"l{k}" for k in langs)], [seen, *langs.values()])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of k: each key's sum; a language's becomes what its mean takes off the products, in whole numbers."""
    key, total, less = None, None, None

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal less
        if key is not None and key[0] != "l":
            yield _table([key], [total])
        elif key is not None:
            less = np.zeros((SLOTS, SLOTS)) if less is None else less
            less -= np.rint(np.outer(total[:-1].astype(np.float64), total[:-1] / total[-1]))

    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            own = v.values.to_numpy()
            if k == key:
                total = total + own
            else:
                yield from out()
                key, total = k, own
    yield from out()
    if less is not None:
        yield from _blocks(less)


def topic_table(rows: DataFrame, topics: int = TOPICS) -> list[int]:
    """The topic of each slot, -1 for slots that no topic has, from all of (lang, slots). What reaches the driver is SLOTS by SLOTS."""
    ship(rows.sparkSession)
    sums = rows.select("lang", "slots").mapInArrow(_products, "k string, v array<bigint>")
    for _ in range(2):  # the second time adds what the languages' means take off
        sums = sums.repartition("k").sortWithinPartitions("k").mapInArrow(_added, "k string, v array<bigint>")
    got = {r.k: r.v for r in sums.collect()}
    seen = np.array(got.pop("d", [0] * (SLOTS + 1)), np.float64)
    if not seen[:-1].any():
        return [-1] * SLOTS
    rare = np.log((seen[-1] + 1) / (seen[:-1] + 1))
    within = np.concatenate([np.array(got[k], np.float64).reshape(-1, SLOTS) for k in sorted(got)]) * np.outer(rare, rare)
    values, vectors = np.linalg.eigh(within)
    x = vectors[:, -2 * topics :] * np.sqrt(np.maximum(values[-2 * topics :], 0))
    size = np.linalg.norm(x, axis=1)
    of = np.full(SLOTS, -1)
    used = (seen[:-1] > 0) & (size > 1e-6 * size.max(initial=0))
    if not used.any():
        return [-1] * SLOTS
    of[used] = _clusters(x[used] / size[used, None], size[used], topics)
    return [int(k) for k in of]


def _clusters(x: np.ndarray, weight: np.ndarray, most: int) -> np.ndarray:
    """K-means by cosine of unit rows. Centres begin far apart: the first at the heaviest row, each at the weighty one that is least like those before."""
    centres = [x[int(np.argmax(weight))]]
    while len(centres) < min(most, len(x)):
        unlike = 1 - np.max(x @ np.stack(centres).T, axis=1)
        centres.append(x[int(np.argmax(unlike * weight))])
    centre = np.stack(centres)
    for _ in range(STEPS):
        of = np.argmax(x @ centre.T, axis=1)
        centre = np.stack([(x[of == k] * weight[of == k, None]).sum(axis=0) if (of == k).any() else centre[k] for k in range(len(centre))])
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return np.argmax(x @ centre.T, axis=1)


def topic(text: Column, table: list[int], topics: int = TOPICS) -> Column:
    """The topic with most votes of the text's words, the least among equals."""
    return _voted(_slots(text), table, topics)


def _voted(slots: Column, table: list[int], topics: int) -> Column:
    if topics > len(_MARKS):
        raise ValueError(f"at most {len(_MARKS)} topics")
    of = F.array(*(F.lit(_MARKS[k] if k >= 0 else "") for k in table))  # a constant, folded into one literal

    def most(votes: Column) -> Column:
        counts = [F.struct((F.length(votes) - F.length(F.replace(votes, F.lit(_MARKS[k]), F.lit("")))).alias("n"), F.lit(-k).alias("k")) for k in range(topics)]
        return (-F.array_max(F.array(*counts))["k"]).cast("int")

    # The votes are bound once; every count looks at them again.
    return let(F.array_join(F.transform(slots, lambda i: F.get(of, i)), ""), most)


def rake(cells: np.ndarray, mass: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Fitted masses of cells (cell, margin) of category numbers; the targets are masses by category."""
    fitted = mass.astype(np.float64).copy()
    for _ in range(rounds):
        worst = 0.0
        for k, target in enumerate(targets):
            now = np.bincount(cells[:, k], weights=fitted, minlength=len(target))
            factor = np.divide(target, now, out=np.ones(len(target)), where=now > 0)
            worst = max(worst, float(np.abs(factor[now > 0] - 1).max(initial=0)))
            fitted *= factor[cells[:, k]]
        if worst < TOLERANCE:
            break
    else:
        _off(worst)
    return fitted


def _off(worst: float) -> None:
    warnings.warn(f"raking stopped with a margin off by {worst:.2g} of its target", stacklevel=3)


def tempered(mass: np.ndarray, power: float) -> np.ndarray:
    """Target masses: shares to a power, over the same total."""
    raised = np.where(mass > 0, np.maximum(mass, 1e-300) ** power, 0.0)
    return raised * (mass.sum() / raised.sum()) if raised.sum() else raised


def scale_for(weight: np.ndarray, mass: np.ndarray, budget: float) -> float:
    """The scale at which the sum of min(1, scale * weight) * mass is the budget."""
    if not mass.sum() or budget >= mass[weight > 0].sum():
        return float("inf")
    low, high = 0.0, 1.0
    spent = lambda x: float((np.minimum(1, x * weight) * mass).sum())
    while spent(high) < budget:
        high *= 2
    for _ in range(BISECTIONS):
        middle = (low + high) / 2
        low, high = (middle, high) if spent(middle) < budget else (low, middle)
    return high


def _given(names: list, mass: np.ndarray, own: Mapping | None, power: float) -> np.ndarray:
    if own is None:
        return tempered(mass, power)
    wanted = np.array([float(own.get(n, 0.0)) for n in names]) * (mass > 0)
    return wanted * (mass.sum() / wanted.sum()) if wanted.sum() else mass


def _local(cells: DataFrame, targets: Mapping[str, Mapping], temper: float, fraction: float, rounds: int) -> DataFrame:
    rows = sorted(cells.collect(), key=lambda r: tuple(r[m] for m in MARGINS))  # at most LOCAL_CELLS
    spark = cells.sparkSession
    mass = np.array([r.mass for r in rows], np.float64)
    numbers, wanted = [], []
    for m in MARGINS:
        names = sorted({r[m] for r in rows})
        at = {n: i for i, n in enumerate(names)}
        number = np.array([at[r[m]] for r in rows], np.int64)
        numbers.append(number)
        wanted.append(_given(names, np.bincount(number, weights=mass, minlength=len(names)), targets.get(m), temper))
    fitted = rake(np.stack(numbers, axis=1) if rows else np.zeros((0, 3), np.int64), mass, wanted, rounds)
    weight = np.divide(fitted, mass, out=np.zeros(len(mass)), where=mass > 0)
    scale = scale_for(weight, mass, fraction * mass.sum())
    prob = np.where(weight > 0, np.minimum(1, weight * scale) if np.isfinite(scale) else 1.0, 0.0)
    # By Arrow: a list of rows would start Python workers of its own.
    columns = {"source": pa.string(), "lang": pa.string(), "topic": pa.int32()}
    own = [pa.array([r[m] for r in rows], t) for m, t in columns.items()]
    return spark.createDataFrame(pa.table([*own, pa.array(weight, pa.float64()), pa.array(prob, pa.float64())], names=[*columns, "weight", "prob"]))


def _spread(cells: DataFrame, targets: Mapping[str, Mapping], temper: float, fraction: float, rounds: int) -> DataFrame:
    """The same by joins. The cells are never written again: a cell's fitted mass is its mass times one factor of each of its categories, and a
    round writes the factors alone, a row a category."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("mass")).first()[0] or 0.0
    wanted = {}
    for m in MARGINS:
        by = cells.groupBy(m).agg(F.sum("mass").cast("double").alias("now"))
        if targets.get(m) is None:
            raised = by.withColumn("want", F.when(F.col("now") > 0, F.pow("now", F.lit(temper))).otherwise(0.0))
        else:
            own = spark.createDataFrame([(k, float(v)) for k, v in targets[m].items()], f"{m} {dict(cells.dtypes)[m]}, want double")
            raised = by.join(own, m, "left").withColumn("want", F.when(F.col("now") > 0, F.coalesce("want", F.lit(0.0))).otherwise(0.0))
        base = raised.agg(F.sum("want")).first()[0] or 1.0
        wanted[m] = materialize(raised.select(m, (F.col("want") * (total / base)).alias("want")), f"target-{m}")
    factors = {m: wanted[m].select(m, F.lit(1.0).alias(f"f_{m}"), F.lit(1.0).alias("step")) for m in MARGINS}

    def times() -> DataFrame:
        out = cells
        for m in MARGINS:
            out = out.join(factors[m].drop("step"), m)
        return out.withColumn("fitted", F.col("mass").cast("double") * reduce(mul, (F.col(f"f_{m}") for m in MARGINS))).drop(*(f"f_{m}" for m in MARGINS))

    for _ in range(rounds):
        worst = 0.0
        for m in MARGINS:
            by = times().groupBy(m).agg(F.sum("fitted").alias("now")).join(wanted[m], m).join(factors[m].drop("step"), m)
            step = F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(1.0)
            factors[m] = materialize(by.select(m, (F.col(f"f_{m}") * step).alias(f"f_{m}"), step.alias("step")), "factors")
            worst = max(worst, factors[m].agg(F.max(F.abs(F.col("step") - 1))).first()[0] or 0.0)
        if worst < TOLERANCE:
            break
    else:
        _off(worst)
    now = materialize(times(), "fitted").withColumn("weight", F.when(F.col("mass") > 0, F.col("fitted") / F.col("mass")).otherwise(0.0))
    low, high = 0.0, 1.0
    spent = lambda x: now.agg(F.sum(F.least(F.lit(1.0), F.col("weight") * x) * F.col("mass"))).first()[0] or 0.0
    whole = now.agg(F.sum(F.when(F.col("weight") > 0, F.col("mass")))).first()[0] or 0.0
    if fraction * total >= whole:
        high = float("1e300")
    else:
        while spent(high) < fraction * total:
            high *= 2
        for _ in range(BISECTIONS):
            middle = (low + high) / 2
            low, high = (middle, high) if spent(middle) < fraction * total else (low, middle)
    return now.select(*MARGINS, "weight", F.when(F.col("weight") > 0, F.least(F.lit(1.0), F.col("weight") * high)).otherwise(0.0).alias("prob"))


def fit(cells: DataFrame, targets: Mapping[str, Mapping] | None = None, temper: float = TEMPER, fraction: float = FRACTION, local_cells: int = LOCAL_CELLS, rounds: int = ROUNDS) -> DataFrame:
    """Weight and probability of each cell (source, lang, topic, mass)."""
    few = cells.count() <= local_cells
    return _local(cells, targets or {}, temper, fraction, rounds) if few else _spread(cells, targets or {}, temper, fraction, rounds)


def _fitted(docs: DataFrame, targets: Mapping[str, Mapping] | None, temper: float, fraction: float, topics: int, local_cells: int, doc_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Column]:
    """The rows (__d, n_words and the margins), the cells with weight and prob, and the topic of a text."""
    slots = materialize(docs.select(F.col(doc_col).alias("__d"), n_words(F.col(text_col)).alias("n_words"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), _slots(F.col(text_col)).alias("slots")), "mix-slots")
    table = topic_table(slots, topics)
    of = topic(F.col(text_col), table, topics)
    rows = materialize(slots.select("__d", "n_words", "source", "lang", _voted(F.col("slots"), table, topics).alias("topic")), "mix-rows")
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("n_words").alias("mass")), "mix-cells")
    return rows, fit(cells, targets, temper, fraction, local_cells), of


def _lies_below(doc_id: Column, prob: Column, seed: int) -> Column:
    return doc_id.isNotNull() & (F.xxhash64(doc_id, F.lit(seed)).cast("double") / F.lit(2.0**64) + 0.5 < prob)


def weights(docs: DataFrame, targets: Mapping[str, Mapping] | None = None, temper: float = TEMPER, fraction: float = FRACTION, topics: int = TOPICS, seed: int = 0, local_cells: int = LOCAL_CELLS, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_col, n_words, source, lang, topic, weight, prob, sampled."""

    def build() -> DataFrame:
        rows, cells, _ = _fitted(docs, targets, temper, fraction, topics, local_cells, doc_col, text_col)
        # The join side has at most LOCAL_CELLS rows or else comes from tables that Spark sizes itself.
        return rows.join(cells, list(MARGINS)).select("__d", "n_words", *MARGINS, "weight", "prob", _lies_below(F.col("__d"), F.col("prob"), seed).alias("sampled"))

    return settle(docs.sparkSession, build, "mixed").withColumnRenamed("__d", doc_col)


def sample(docs: DataFrame, targets: Mapping[str, Mapping] | None = None, temper: float = TEMPER, fraction: float = FRACTION, topics: int = TOPICS, seed: int = 0, local_cells: int = LOCAL_CELLS, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled rows of docs, all columns. Each row's probability follows from its cell, so documents stay where they are."""
    spark = docs.sparkSession
    found: list[Column] = []

    def build() -> DataFrame:
        _, cells, of = _fitted(docs, targets, temper, fraction, topics, local_cells, doc_col, text_col)
        found.append(of)
        return cells.filter("prob > 0").select(F.col("source").alias("__source"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.col("prob").alias("__prob"))

    cells = settle(spark, build, "cells")
    cells = F.broadcast(cells) if cells.count() <= LOCAL_CELLS else cells
    # The rows' own columns, whatever their names, go along as one.
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    named = docs.select(own.alias("__row"), F.col(doc_col).alias("__d"), F.coalesce("source", F.lit("")).alias("__own_source"), F.coalesce("lang", F.lit("")).alias("__own_lang"), found[0].alias("__of"))
    joined = named.join(cells, (F.col("__own_source") == F.col("__source")) & (F.col("__own_lang") == F.col("__lang")) & (F.col("__of") == F.col("__topic")))
    return joined.filter(_lies_below(F.col("__d"), F.col("__prob"), seed)).select("__row.*")
