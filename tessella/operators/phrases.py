"""Phrases of many tokens found in texts by their rarest token.

The tokens of all phrases are counted in the texts first (a scan whose counts combine before the shuffle). A phrase with a token that no text holds is left
out; any other is listed under its rarest token, as the shapes (offset of that token, number of tokens) that its phrases have. Only places of listed
tokens leave the scan, and give one n-gram for each shape, which meets the phrases as a whole. So common words bring nothing together, unless a
phrase has no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.skew import bit_filter, lookup_hot
from tessella.session import materialize

#: Tokens of a text that are worked on at once; and up to how many bytes of phrases are broadcast (measured first), beyond which they are shuffled.
BLOCK, BROADCAST_BYTES = 256, 16 << 20


def find(docs: DataFrame, key: str, tokens: Column, phrases: DataFrame, phrase_tokens: Column, keep: list[str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, pos from 0, n, keep...): every place of every phrase, with the phrase's columns `keep`. Phrases without tokens stand nowhere; a phrase that is
    there twice is found twice. Writes two small tables on the way (`session.settle` deletes them)."""
    index = phrases.select(F.struct(*keep).alias("_keep"), phrase_tokens.alias("_p")).filter(F.size("_p") > 0)
    size = index.agg(F.max(F.size("_p")).alias("longest"), F.sum(F.octet_length(F.array_join("_p", " ")) + 16 * F.size("_p")).alias("bytes")).first()
    longest, small = size["longest"] or 1, (size["bytes"] or 0) <= broadcast_bytes
    text = docs.select(F.col(key).alias("_k"), tokens.alias("_t"))

    each = index.select("_p").distinct().select("_p", F.posexplode("_p").alias("o", "_w")).select("_p", "o", F.xxhash64("_w").alias("t"))
    known = each.groupBy("t").agg(F.count("*").alias("in_phrases"))
    words = bit_filter(known, "t")(text.select(F.explode(F.transform("_t", lambda w: F.xxhash64(w))).alias("t")), "t")
    counted = materialize(words.groupBy("t").agg(F.count("*").alias("c")).join(known, "t"), "phrase-words")
    told = each.join(F.broadcast(counted), "t", "left") if small else lookup_hot(each, counted, ["t"], "in_phrases", F.xxhash64("_p", "o"))
    rarest = told.groupBy("_p").agg(F.min(F.struct("c", "o", "t")).alias("_r"), F.count("c").alias("_seen")).filter(F.col("_seen") == F.size("_p")).drop("_seen")
    index = materialize(index.join(rarest, "_p"), "phrases")
    shape = F.struct(F.col("_r.o").alias("o"), F.size("_p").alias("n"))
    shapes = index.groupBy(F.col("_r.t").alias("t")).agg(F.first("_r.c").alias("c"), F.collect_set(shape).alias("shapes"))
    shapes = materialize(shapes, "phrase-shapes")  # at most longest * (longest + 1) / 2 shapes a token

    at = _near(bit_filter(shapes, "t")(_places(text, longest), "t"), longest)
    if small:
        listed = at.join(F.broadcast(shapes.drop("c")), "t")
    else:
        listed = lookup_hot(at, shapes, ["t"], "c", F.xxhash64("_k", "pos")).filter("shapes IS NOT NULL")
    grams = listed.select("_k", "pos", "_from", "_near", "t", F.explode("shapes").alias("s")).filter("pos >= s.o")
    grams = grams.select("_k", (F.col("pos") - F.col("s.o")).alias("pos"), "t", "s.*", F.slice("_near", F.col("pos") - F.col("s.o") - F.col("_from") + 1, F.col("s.n")).alias("_g"))
    grams = grams.filter(F.size("_g") == F.col("n"))
    # Another token of the phrase may be listed too, with the same shape for other phrases; the phrase is found by its own alone.
    same = (F.col("_g") == F.col("_p")) & (F.col("t") == F.col("_r.t")) & (F.col("o") == F.col("_r.o"))
    return grams.join(F.broadcast(index) if small else index, same).select(F.col("_k").alias(key), "pos", "n", "_keep.*")


def _places(text: DataFrame, longest: int) -> DataFrame:
    """(_k, pos, t, f, w): each token's hash, with the tokens of its block and where they begin; long texts go by blocks, which overlap by longest - 1 on both sides."""
    n, around = F.size("_t"), longest - 1
    begins = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    low = lambda i: F.greatest(i - around, F.lit(0))
    block = F.transform(begins, lambda b: F.struct(b.alias("b"), low(b).alias("f"), F.slice("_t", low(b) + 1, F.least(b + BLOCK, n) - low(b) + around).alias("w"), F.least(b + BLOCK, n).alias("e")))
    blocks = text.select("_k", F.explode(block).alias("x")).select("_k", "x.*")
    each = blocks.select("_k", "b", "f", "w", F.posexplode(F.slice("w", F.col("b") - F.col("f") + 1, F.col("e") - F.col("b"))).alias("i", "x"))
    return each.select("_k", (F.col("b") + F.col("i")).alias("pos"), F.xxhash64("x").alias("t"), "f", "w")


def _near(places: DataFrame, longest: int) -> DataFrame:
    """(_k, pos, t, _from, _near): the places left with their neighbours, up to longest - 1 on both sides; made for these alone, not for each token."""
    around = longest - 1
    low = F.greatest(F.col("pos") - around, F.lit(0))
    return places.select("_k", "pos", "t", low.alias("_from"), F.slice("w", low - F.col("f") + 1, F.lit(2 * around + 1)).alias("_near"))
