"""Embedding whitening: exact sums, a covariance in double-double, components by a tridiagonal divide-and-conquer solver.

Entries become integers x = floor(scale * entry) + shift, so that the number of rows n and the sums S are exact, and so is the centred
vector c = n * x - S. Each task adds up the outer products of its centred vectors in double-double: products by Dekker's splitting, sums
by Knuth's two-sum, none of which loses a bit but below the low part. The tasks' high and low parts are merged in two levels of groups by
matrix row, still in double-double; divided by n ** 3 that is the covariance. numpy.linalg.eigh solves it by LAPACK's syevd, which makes the
matrix tridiagonal and divides and conquers. What reaches the driver is S and one matrix of D x D; a task holds two of them.

Defined cases: rows are left out whose vector is null or empty, holds a null, NaN or infinite entry, or an entry whose scaled value isn't
below 2 ** 51; or whose length is not the most frequent one (of ties the largest). Repeated rows and rows without an id count as rows. A table without rows left gives an
empty result; a component without variance (one row, equal rows, fewer rows than dimensions) has whitened 0.0, so identity_error is 1.0 there; a deviation
beyond the range of a long is null. Only the two named columns are read. Vectors of any length are used whole, for D x D doubles of memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import settle, ship

COMPONENTS, SCALE, SHIFT = 8, 1024.0, 100_000
_HALF = 26
_SPLIT = float((1 << 27) + 1)
#: Products that a task works on at once.
_BLOCK = 1 << 17
#: Groups of tasks in the first level of merging.
_GROUPS = 32

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The sum and what rounding took from it."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """The product and what rounding took from it."""
    p, u, v = a * b, a * _SPLIT, b * _SPLIT
    ah, bh = u - (u - a), v - (v - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(x: Pair, y: Pair) -> Pair:
    """Sum of double-double numbers."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def total(x: Pair) -> Pair:
    """Sum over the first axis by halves."""
    hi, lo = x
    while len(hi) > 1:
        half = len(hi) // 2
        odd = (hi[2 * half :], lo[2 * half :])
        hi, lo = add((hi[:half], lo[:half]), (hi[half : 2 * half], lo[half : 2 * half]))
        hi, lo = np.concatenate((hi, odd[0])), np.concatenate((lo, odd[1]))
    return hi[0], lo[0]


def outer_sum(c: np.ndarray) -> Pair:
    """Double-double sum of the outer products of integer rows (long, or Python's own), as the upper triangle row by row."""
    rows, cols = np.triu_indices(c.shape[1])
    acc = (np.zeros(len(rows)), np.zeros(len(rows)))
    high = c.astype(np.float64)
    low = (c - high.astype(c.dtype) if c.dtype != object else np.array([[int(x) - int(y) for x, y in zip(r, h, strict=True)] for r, h in zip(c, high, strict=True)], object)).astype(np.float64)
    whole = not low.any()
    step = max(1, _BLOCK // max(1, len(rows)))
    for i in range(0, len(c), step):
        a, b = high[i : i + step, rows], high[i : i + step, cols]
        p, e = two_product(a, b)
        if not whole:
            e = e + (a * low[i : i + step, cols] + low[i : i + step, rows] * b)
        acc = add(acc, total(two_sum(p, e)))
    return acc


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: in longs where they hold it, else in Python's integers."""
    if x.size and (int(np.abs(x).max()) * n >= 1 << 61 or max(map(abs, sums)) >= 1 << 61):
        return n * x.astype(object) - np.array(sums, object)
    return n * x - np.array(sums, np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


@dataclass(frozen=True)
class Whitening:
    """n rows, sums by dimension, covariance, eigenvalues (falling) and unit eigenvectors (as rows)."""

    n: int
    sums: list[int]
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        trace = float(np.trace(self.covariance))
        return self.values / trace if trace > 0 else np.zeros(len(self.values))

    def project(self, x: np.ndarray) -> np.ndarray:
        c = centred(x, self.n, self.sums).astype(np.float64) / self.n
        least = len(self.sums) * np.finfo(float).eps * max(float(self.values[0]), 0.0)
        scale = np.array([v**-0.5 if v > least else 0.0 for v in self.values])
        return (c @ self.vectors.T) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        c = centred(x, self.n, self.sums)
        if c.dtype != object and c.size and int(np.abs(c).max()) ** 2 * c.shape[1] >= 1 << 62:
            c = c.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (c * c).sum(axis=1)]


def fixed_point(vector: Column, scale: float = SCALE, shift: int = SHIFT) -> Column:
    """floor(scale * entry) + shift of each entry."""
    return F.transform(vector, lambda v: F.floor(v.cast("double") * F.lit(scale)).cast("long") + F.lit(shift).cast("long"))


def usable(vector: Column, scale: float = SCALE) -> Column:
    """Whether a vector has entries and all are finite numbers in range."""
    fine = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double") * F.lit(scale)) < float(1 << 51), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def _rows(df: DataFrame, id_col: str, vec_col: str, scale: float, shift: int) -> tuple[DataFrame, int]:
    """(id, x) of the rows that count, and their length."""
    good = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).filter(usable(F.col("v"), scale))
    best = good.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = best[0]["dims"] if best else 0
    return good.filter(F.size("v") == dims).select("id", fixed_point(F.col("v"), scale, shift).alias("x")), dims


def _sums(rows: DataFrame, dims: int) -> tuple[int, list[int]]:
    """n and S: a row of two halves a task, added up by dimension."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(dims, np.int64), np.zeros(dims, np.int64)
        for b in batches:
            x = _matrix(b.column(0), dims)
            n, high, low = n + len(x), high + (x >> _HALF).sum(axis=0), low + (x & ((1 << _HALF) - 1)).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_pydict({"dim": np.arange(dims, dtype=np.int32), "n": np.full(dims, n), "high": high, "low": low})

    parts = rows.select("x").mapInArrow(halves, "dim int, n long, high long, low long")
    found = sorted(parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low")).collect())
    return found[0]["n"], [(r["high"] << _HALF) + r["low"] for r in found]


_PART = "row int, task int, high array<double>, low array<double>"


def _merge(part: pd.DataFrame) -> pd.DataFrame:
    """The parts of one matrix row as one, in the order of tasks."""
    part = part.sort_values("task")
    high, low = total((np.stack(part["high"].to_list()), np.stack(part["low"].to_list())))
    return pd.DataFrame({"row": [part["row"].iloc[0]], "task": [part["task"].iloc[0]], "high": [high], "low": [low]})


def _covariance(rows: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    edges = np.concatenate(([0], np.cumsum(np.arange(dims, 0, -1))))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for b in batches:
            if b.num_rows:
                new = outer_sum(centred(_matrix(b.column(0), dims), n, sums))
                acc = new if acc is None else add(acc, new)
        if acc is not None:
            cut = [pa.array([x[i:j] for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.list_(pa.float64())) for x in acc]
            task = np.full(dims, TaskContext.get().partitionId(), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(task), *cut], ["row", "task", "high", "low"])

    first = rows.select("x").mapInArrow(parts, _PART).groupBy("row", F.pmod("task", F.lit(_GROUPS))).applyInPandas(lambda _, p: _merge(p), _PART)
    merged = first.groupBy("row").applyInPandas(_merge, _PART).collect()
    out, cube = np.zeros((dims, dims)), Fraction(n) ** 3
    for r in merged:
        i = r["row"]
        out[i, i:] = out[i:, i] = [float((Fraction(h) + Fraction(e)) / cube) for h, e in zip(r["high"], r["low"], strict=True)]
    return out


def _fit(rows: DataFrame, dims: int) -> Whitening:
    n, sums = _sums(rows, dims)
    covariance = _covariance(rows, dims, n, sums)
    values, vectors = np.linalg.eigh(covariance)  # LAPACK's syevd
    return Whitening(n, sums, covariance, values[::-1], vectors.T[::-1])


def fit(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = SCALE, shift: int = SHIFT) -> Whitening | None:
    """The model of all rows that count; None if there are none."""
    ship(df.sparkSession)
    rows, dims = _rows(df, id_col, vec_col, scale, shift)
    return _fit(rows, dims) if dims else None


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """Per row that counts: id_col, n, deviation, whitened (an array, the largest components first), explained (an array), identity_error."""
    spark = df.sparkSession
    ship(spark)
    rows, dims = _rows(df, id_col, vec_col, scale, shift)
    kind = df.schema[id_col].dataType.simpleString()
    if not dims:
        return spark.createDataFrame([], f"`{id_col}` {kind}, n long, deviation long, whitened array<double>, explained array<double>, identity_error double")
    model = _fit(rows, dims)
    k = min(components, dims)
    top = Whitening(model.n, model.sums, np.zeros((0, 0)), model.values[:k], model.vectors[:k])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dims)
            w = top.project(x)
            whitened = pa.ListArray.from_arrays(np.arange(0, w.size + 1, k, dtype=np.int32), w.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(top.deviations(x), pa.int64()), whitened], ["id", "deviation", "whitened"])

    made = settle(spark, lambda: rows.mapInArrow(work, f"id {kind}, deviation long, whitened array<double>"), "whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cells = made.agg(*(F.covar_pop(F.get("whitened", F.lit(i)), F.get("whitened", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(cells[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    share = F.array(*(F.lit(float(v)) for v in model.explained[:k]))
    return made.select(F.col("id").alias(id_col), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(float(error)).alias("identity_error"))
