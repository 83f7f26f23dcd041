"""Exact dedup against a dictionary of texts, with collisions forced by a weak hash."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def weak(text):
    """Six values: most groups hold several texts."""
    return F.pmod(F.xxhash64(text), F.lit(3)), F.pmod(F.length(text), F.lit(2)).cast("long")


def brute(rows, largest):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    pick = max if largest else min
    keep = {t: pick([d for d in ds if d is not None], default=None) for t, ds in groups.items()}
    out = []
    for d, t in rows:
        k = (t or "").translate(LOWER)
        out.append((d, keep[k], len(groups[k]), hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def rows():
    rng = random.Random(5)
    texts = ["", "a", "A", "Ä", "ä", "a ", "b\n", "B\n", "hot", "HOT", "x" * 300_000, "X" * 299_999 + "x"]
    return [(i, rng.choice(texts) if i % 3 else "hot") for i in range(400)] + [(1000, None), (None, "only null"), (None, "Only Null"), (None, "hot"), (7, "twice"), (7, "twice"), (8, "twice")]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("hashes", [exact_dedup.content_hash, weak])
def test_against_groups_of_texts(spark, largest, hashes):
    data = rows()
    got = exact_dedup.dedup(spark.createDataFrame(data, "doc_id long, text string"), largest=largest, hashes=hashes).collect()
    want, n = brute(data, largest)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_empty_extra_columns_and_texts_kept(spark):
    assert exact_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    odd = spark.createDataFrame([(1, "a", 5, "u", 9, "p")], "doc_id long, text string, n long, keep_id string, h1 long, own string")
    row = exact_dedup.dedup(odd, keep=("text", "n", "own")).collect()[0]
    assert (row.doc_id, row.keep_id, row.group_size, row.kept, row.text, row.n, row.own) == (1, 1, 1, True, "a", 5, "p")


def test_bit_filter_keeps_all_members(spark):
    from tessella.operators.skew import bit_filter

    keys = spark.range(0, 5000, 7).select(F.xxhash64("id").alias("h"))
    every = spark.range(5000).select("id", F.xxhash64("id").alias("h"))
    for bits in (64, 1 << 24):
        left = {r.id for r in bit_filter(keys, "h", bits)(every, "h").collect()}
        assert set(range(0, 5000, 7)) <= left
    assert len(left) < 1500
