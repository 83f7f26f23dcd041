"""Order statistics by rounds against sorted lists, with limits that force many rounds."""

import random
import statistics

import pytest

from tessella.operators import ranks


@pytest.mark.parametrize("kind", ["spread", "ties", "one", "few"])
def test_rounds_of_range_counts(spark, kind):
    rng = random.Random(3)
    values = {"spread": [rng.gauss(0, 1e6) for _ in range(30_000)], "ties": [float(min(40, rng.randrange(100))) for _ in range(30_000)], "one": [2.5] * 9000, "few": [3.0, 1.0, 2.0]}[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double")
    at = sorted({1, 2, len(values) // 3 or 1, len(values) // 2 or 1, len(values)})
    n, got = ranks.order_statistics(df, "v", lambda n: at, settled=20, accuracy=100)
    assert n == len(values) and got == {k: sorted(values)[k - 1] for k in at}


def test_percentiles(spark):
    values = [float(v * v % 97) for v in range(1001)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    n, got = ranks.percentiles(df, "v", [0.25, 0.5, 0.75, 0.333], settled=10, accuracy=50)
    assert n == 1001 and got[:3] == pytest.approx(statistics.quantiles(values, n=4, method="inclusive"))
    assert ranks.nearest_ranks(df, "v", (0, 10, 50, 100), settled=10, accuracy=50) == [sorted(values)[k] for k in (0, 100, 500, 1000)]
    assert ranks.percentiles(df.filter("v < 0"), "v", [0.5]) == (0, [None])


def test_one_value_has_most_rows(spark):
    """A million equal rows in one value: nothing but counts reaches the driver."""
    df = spark.range(1_000_000).selectExpr("CAST(IF(id % 10 = 0, id, 7) AS double) AS v")
    n, got = ranks.order_statistics(df, "v", lambda n: [1, n // 2, n])
    assert (n, got[1], got[n // 2], got[n]) == (1_000_000, 0.0, 7.0, 999_990.0)
