"""Exact order statistics without one task that holds all values: rounds of range counts.

Each wanted rank keeps an open interval of values known to hold it. A round takes splitters on both sides of the rank from a sketch of the interval's
values, then counts exactly how many are below, at and above each; the rank is at a splitter, or its interval shrinks to what lies between them, a few
ten-thousandths of what it was. Intervals of at most SETTLED values are counted value by value. Every count combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.session import materialize, temporary

#: Values of an interval that the driver may get, each with its count; and the accuracy of the sketch.
SETTLED, ACCURACY = 20_000, 10_000


def order_statistics(df: DataFrame, value: str, ranks: Callable[[int], list[int]], settled: int = SETTLED, accuracy: int = ACCURACY) -> tuple[int, dict[int, float]]:
    """How many values of a numeric column aren't null, and the values at the ranks (from 1) that `ranks` gives for that number."""
    with temporary(df.sparkSession):
        values = materialize(df.select(F.col(value).alias("v")).filter("v IS NOT NULL"), "values")
        n = values.count()
        found: dict[int, float] = {}
        # (low, high, values up to low, values between) by rank; None is no bound.
        spans = {r: (None, None, 0, n) for r in ranks(n) if 1 <= r <= n}
        while spans:
            small = {r: s for r, s in spans.items() if s[3] <= settled}
            found |= _settle(values, small)
            spans = {r: s for r, s in spans.items() if r not in small}
            if spans:
                at, spans = _round(values, spans, accuracy)
                found |= at
        return n, found


def _inside(span: tuple) -> Column:
    low, high = span[:2]
    one = F.lit(True) if low is None else F.col("v") > F.lit(low)
    return one if high is None else one & (F.col("v") < F.lit(high))


def _settle(values: DataFrame, spans: dict[int, tuple]) -> dict[int, float]:
    if not spans:
        return {}
    any_of = F.lit(False)
    for s in set(spans.values()):
        any_of = any_of | _inside(s)
    counts = sorted((r["v"], r["c"]) for r in values.filter(any_of).groupBy("v").agg(F.count("*").alias("c")).collect())
    out = {}
    for rank, (low, high, before, _) in spans.items():
        for v, c in counts:
            if (low is None or v > low) and (high is None or v < high):
                before += c
                if before >= rank:
                    out[rank] = v
                    break
    return out


def _round(values: DataFrame, spans: dict[int, tuple], accuracy: int) -> tuple[dict[int, float], dict[int, tuple]]:
    sketches, order = [], list(spans)
    for i, rank in enumerate(order):
        _, _, before, many = spans[rank]
        share = [min(1.0, max(0.0, (rank - before) / many + d * 2 / accuracy)) for d in (-1, 0, 1)]
        sketches.append(F.percentile_approx(F.when(_inside(spans[rank]), F.col("v")), share, accuracy).alias(f"s{i}"))
    splits = values.agg(*sketches).first()
    counts = [x for i in range(len(order)) for j, v in enumerate(splits[f"s{i}"]) for x in (F.count_if(F.col("v") < F.lit(v)).alias(f"b{i}_{j}"), F.count_if(F.col("v") <= F.lit(v)).alias(f"e{i}_{j}"))]
    told = values.agg(*counts).first()
    found, left = {}, {}
    for i, rank in enumerate(order):
        low, high, before, _ = spans[rank]
        upto = None
        for j, v in enumerate(splits[f"s{i}"]):
            if told[f"b{i}_{j}"] < rank <= told[f"e{i}_{j}"]:
                found[rank] = v
                break
            if rank > told[f"e{i}_{j}"]:
                low, before = v, told[f"e{i}_{j}"]
            else:
                high, upto = v, told[f"b{i}_{j}"]
                break
        if rank not in found:
            upto = spans[rank][2] + spans[rank][3] if upto is None else upto
            left[rank] = (low, high, before, upto - before)
    return found, left


def percentiles(df: DataFrame, value: str, shares: list[float], **limits: int) -> tuple[int, list[float | None]]:
    """The number of values and their percentiles by linear interpolation; None where there are no values."""

    def ends(n: int) -> list[tuple[float, int, int]]:
        return [(p * (n - 1), int(p * (n - 1)), -int(-(p * (n - 1)) // 1)) for p in shares]

    n, at = order_statistics(df, value, lambda n: [k + 1 for _, low, high in ends(n) for k in (low, high)], **limits)
    if not n:
        return 0, [None] * len(shares)
    mixed = lambda p, low, high: float(at[low + 1]) if low == high else (high - p) * float(at[low + 1]) + (p - low) * float(at[high + 1])
    return n, [mixed(*e) for e in ends(n)]


def nearest_ranks(df: DataFrame, value: str, percents: tuple[int, ...], **limits: int) -> list[float | None]:
    """Nearest-rank percentiles: the least value with at least so many percent of the values up to it."""
    rank = lambda p, n: max(1, -(-p * n // 100))
    n, at = order_statistics(df, value, lambda n: [rank(p, n) for p in percents], **limits)
    return [float(at[rank(p, n)]) if n else None for p in percents]
