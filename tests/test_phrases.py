"""Phrases found by their rarest token, against a search place by place."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import joins
from tessella.operators.phrases import BLOCK, find
from tessella.session import temporary


def plain(docs, phrases):
    return sorted((k, i, len(p), x) for k, w in docs if w for x, p in phrases if p for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p)


@pytest.mark.parametrize("limit", [1 << 24, 0])  # broadcast, and shuffles throughout
def test_every_place(spark, limit):
    r = random.Random(3)
    word = lambda: "the" if r.random() < 0.5 else f"w{r.randrange(12)}"
    docs = [(k, [word() for _ in range(r.choice([0, 1, 2, 7, 60]))]) for k in range(40)]
    docs += [(100, ["the"] * (BLOCK + 5)), (101, ["x"] * (BLOCK - 2) + ["over", "the", "edge", "of", "it"] + ["y"] * (2 * BLOCK) + ["end"]), (102, None), (102, ["end"])]
    phrases = [(i, [word() for _ in range(r.randint(1, 5))]) for i in range(60)]
    phrases += [(200, ["the"]), (201, ["the", "the"]), (202, ["over", "the", "edge", "of", "it"]), (203, ["never", "the"]), (204, []), (205, None), (206, ["y", "end"]), (207, ["end"]), (207, ["end"]), (208, ["w1", "w1"]), (209, ["edge", "the"])]
    d, p = spark.createDataFrame(docs, "k int, w array<string>").repartition(3), spark.createDataFrame(phrases, "x int, p array<string>")
    with temporary(spark):
        got = find(d, "k", F.col("w"), p, F.col("p"), ["x"], limit)
        assert sorted(map(tuple, got.collect())) == plain(docs, phrases)
        assert find(d, "k", F.col("w"), p.limit(0), F.col("p"), ["x"], limit).count() == 0
        assert find(d.limit(0), "k", F.col("w"), p, F.col("p"), ["x"], limit).count() == 0


def test_common_words_bring_nothing_together(spark):
    """A phrase with a common word leaves the scan at the places of its rare one only."""
    docs = spark.range(50).select(F.col("id").alias("k"), F.array_repeat(F.lit("of"), 400).alias("w"))
    docs = docs.withColumn("w", F.when(F.col("k") == 7, F.concat("w", F.array(F.lit("rare"), F.lit("of")))).otherwise(F.col("w")))
    phrases = spark.createDataFrame([(1, ["of", "rare"]), (2, ["rare", "of"]), (3, ["of", "missing"])], "x int, p array<string>")
    with temporary(spark):
        got = find(docs, "k", F.col("w"), phrases, F.col("p"), ["x"])
        assert sorted(map(tuple, got.collect())) == [(7, 399, 2, 1), (7, 400, 2, 2)]
        shapes = [t for t in got.inputFiles() if "phrase-shapes" in t]
        listed = spark.read.parquet(shapes[0].rsplit("/", 1)[0])
        assert [(r.c, sorted(tuple(s) for s in r.shapes)) for r in listed.collect()] == [(1, [(0, 2), (1, 2)])]


def test_hints_of_four_tokens(spark):
    docs = spark.createDataFrame([(1, "say a b c d again"), (2, "a b x"), (3, None)], "k int, t string")
    lexicon = spark.createDataFrame([("a\x01b\x01c\x01d", "four"), ("a\x01b", "two"), ("d", "one"), ("a\x01b\x01c\x01d\x01again", "five")], "form string, hint string")
    with temporary(spark):
        got = joins.hints(docs, lexicon, "k", F.split(F.coalesce("t", F.lit("")), " "), "form", "hint")
        assert {r.k: [(h.pos, h.n, h.hint) for h in r.hints] for r in got.collect()} == {1: [(1, 4, "four")], 2: [(0, 2, "two")], 3: []}


def test_neighbours_only_for_places_left(spark):
    """Tokens that no phrase lists leave the scan without neighbours; those left have them across the bounds of blocks."""
    from tessella.operators import phrases

    n = phrases.BLOCK + 3
    text = spark.createDataFrame([(1, [f"a{i}" for i in range(n)]), (2, [])], "_k long, _t array<string>")
    places = phrases._places(text, 3)
    assert "_near" not in places.columns and places.count() == n
    near = {r["pos"]: (r["_from"], r["_near"]) for r in phrases._near(places.filter(f"pos in (0, {phrases.BLOCK})"), 3).collect()}
    b = phrases.BLOCK
    assert near == {0: (0, ["a0", "a1", "a2", "a3", "a4"]), b: (b - 2, [f"a{i}" for i in range(b - 2, n)])}
