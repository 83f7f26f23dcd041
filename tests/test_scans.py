"""Running values in two levels, against a loop over the rows of each key."""

import random
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tessella.operators import scans, windows
from tessella.session import temporary

R = random.Random(5)
#: A key with most of the rows, a null key, keys of one row, and nulls and blanks among the values.
ROWS = [(k, o, R.choice(["a", "b", "", None])) for k, n in ((1, 3000), (None, 40), (2, 1), (3, 7)) for o in R.sample(range(10 * n), n)]


@pytest.fixture
def df(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would be one range
    yield spark.createDataFrame(ROWS, "k int, o int, v string").repartition(5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def by_key():
    order = lambda r: (r[0] is not None, r[0] or 0, r[1])
    return groupby(sorted(ROWS, key=order), key=lambda r: r[0])


def test_a_key_is_spread(spark, df):
    with temporary(spark):
        dealt = scans.deal(df, ["k"], "o")
        parts = dealt.filter("k = 1").groupBy("_range").count().collect()
        assert len(parts) > 1 and max(r["count"] for r in parts) < 2000


def test_against_a_loop(spark, df):
    islands, filled, runs = {}, {}, {}
    for k, own in by_key():
        island, last, run, before = 0, "", 0, object()
        for _, o, v in own:
            islands[k, o] = island
            island += v == "a"
            last = v or last
            filled[k, o] = last
            run += v != before
            before = v
            runs[k, o] = run
    with temporary(spark):
        assert {(r.k, r.o): r.island for r in windows.islands(df, ["k"], "o", F.col("v") == "a").collect()} == islands
        assert {(r.k, r.o): r.v for r in windows.forward_fill(df, ["k"], "o", "v").collect()} == filled
        assert {(r.k, r.o): r.run for r in windows.runs(df, ["k"], "o", "v").collect()} == runs
        assert windows.runs(df.limit(0), ["k"], "o", "v").count() == 0 == windows.forward_fill(df.limit(0), ["k"], "o", "v").count()
