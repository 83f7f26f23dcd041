"""Consensus and translation scores, from their published definitions."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.regex import let
from tessella.session import ship

BLEU_N, CHAR_N, WORD_N, BETA = 4, 6, 2, 2.0
_TOKEN = ((re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "))


def tokenize_13a(text: str) -> list[str]:
    """The usual tokens for BLEU."""
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    if "&" in text:
        for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            text = text.replace(a, b)
    text = f" {text} "
    for rx, to in _TOKEN:
        text = rx.sub(to, text)
    return text.split()


def bleu_statistics(hyp: str, ref: str) -> list[int]:
    """Lengths of both, then matches and totals of 1- to 4-grams."""
    h, r = tokenize_13a(hyp), tokenize_13a(ref)
    out = [len(h), len(r)]
    for n in range(1, BLEU_N + 1):
        a, b = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (h, r))
        out += [sum((a & b).values()), max(0, len(h) - n + 1)]
    return out


def bleu(stats: list[int] | tuple[int, ...], effective_order: bool = False) -> float:
    """From summed statistics; orders without a match are smoothed by halving an assumed one. Effective order leaves out those without any n-gram."""
    hyp, ref = stats[0], stats[1]
    if not hyp or not stats[2]:
        return 0.0
    logs, smooth, used = 0.0, 1.0, 0
    for n in range(BLEU_N):
        match, total = stats[2 + 2 * n], stats[3 + 2 * n]
        if not total:
            if effective_order:
                break
            return 0.0
        used += 1
        if not match:
            smooth *= 2
            logs += math.log(100.0 / (smooth * total))
        else:
            logs += math.log(100.0 * match / total)
    short = math.exp(1 - ref / hyp) if hyp < ref else 1.0
    return short * math.exp(logs / (used if effective_order else BLEU_N))


def _chr_words(text: str) -> list[str]:
    out: list[str] = []
    punctuation = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    for w in text.split():
        if len(w) == 1:
            out.append(w)
        elif w[-1] in punctuation:
            out += [w[:-1], w[-1]]
        elif w[0] in punctuation:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def chrf_statistics(hyp: str, ref: str, word_n: int = WORD_N) -> list[int]:
    """For character 1- to 6-grams without white space, then word n-grams: how many in hyp, in ref, in both."""
    out: list[int] = []
    for n, units in [(n, ("".join(hyp.split()), "".join(ref.split()))) for n in range(1, CHAR_N + 1)] + [(n, (_chr_words(hyp), _chr_words(ref))) for n in range(1, word_n + 1)]:
        a, b = (Counter(tuple(x[i : i + n]) if isinstance(x, list) else x[i : i + n] for i in range(len(x) - n + 1)) for x in units)
        # Without any n-gram in the reference an order counts for nothing.
        out += [sum(a.values()) if b else 0, sum(b.values()), sum((a & b).values())]
    return out


def chrf(stats: list[int] | tuple[int, ...]) -> float:
    """F of beta 2 over the mean precision and recall of the orders that both sides have."""
    precision = recall = 0.0
    orders = 0
    for i in range(0, len(stats), 3):
        hyp, ref, both = stats[i : i + 3]
        if hyp > 0 and ref > 0:
            precision += both / hyp
            recall += both / ref
            orders += 1
    if not orders:
        return 0.0
    p, r = precision / orders, recall / orders
    return 100 * (1 + BETA**2) * p * r / (BETA**2 * p + r) if p + r else 0.0


_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Units of text that are compared at once.
CHUNK = 400_000


def _hashed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _overlaps(units: list[np.ndarray], rows: list[np.ndarray], n_rows: int, longest: int) -> list[np.ndarray]:
    """For each order up to the longest: n-grams by row of either side, and of both (the smaller counts). units, rows: a side's units
    one after another and the row of each. N-grams are compared by 64-bit hashes."""
    out, keys = [], [np.zeros(len(u), np.uint64) for u in units]
    for n in range(1, longest + 1):
        hashes, owners = [], []
        for k in (0, 1):
            size = max(0, len(units[k]) - n + 1)
            keys[k] = _hashed(keys[k][:size] * _STEP + units[k][n - 1 : n - 1 + size])
            whole = rows[k][:size] == rows[k][n - 1 : n - 1 + size]
            owners.append(rows[k][:size][whole])
            hashes.append(keys[k][whole] + owners[k].astype(np.uint64) * _STEP)
        unique, of = np.unique(np.concatenate(hashes), return_inverse=True)
        first = len(hashes[0])
        counts = [np.bincount(of[:first], minlength=len(unique)), np.bincount(of[first:], minlength=len(unique))]
        owner = np.zeros(len(unique), np.int64)
        owner[of] = np.concatenate(owners)
        totals = [np.bincount(o, minlength=n_rows) for o in owners]
        out.append(np.stack([*totals, np.bincount(owner, weights=np.minimum(*counts), minlength=n_rows).astype(np.int64)]))
    return out


def _numbered(lists: list[list[str]], names: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter((names.setdefault(w, len(names) + 1) for x in lists for w in x), np.uint64)
    return flat, np.repeat(np.arange(len(lists)), [len(x) for x in lists])


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = ["".join(t.split()) for t in texts]
    flat = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return flat, np.repeat(np.arange(len(joined)), [len(x) for x in joined])


def _chunks(hyps: list[str], refs: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    size = np.cumsum([len(h) + len(r) for h, r in zip(hyps, refs, strict=True)])
    at = 0
    while at < len(hyps):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK, side="right")))
        yield hyps[at:end], refs[at:end]
        at = end


def bleu_table(hyps: list[str], refs: list[str]) -> np.ndarray:
    """`bleu_statistics` of each pair as a row, all pairs at once."""
    parts = []
    for h, r in _chunks(hyps, refs):
        names: dict[str, int] = {}
        (a, x), (b, y) = (_numbered([tokenize_13a(t) for t in side], names) for side in (h, r))
        orders = _overlaps([a, b], [x, y], len(h), BLEU_N)
        parts.append(np.stack([orders[0][0], orders[0][1], *(c for o in orders for c in (o[2], o[0]))], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, 2 + 2 * BLEU_N), np.int64)


def chrf_table(hyps: list[str], refs: list[str]) -> np.ndarray:
    """`chrf_statistics` of each pair as a row, all pairs at once."""
    parts = []
    for h, r in _chunks(hyps, refs):
        names: dict[str, int] = {}
        (a, x), (b, y) = _points(h), _points(r)
        (c, u), (d, v) = (_numbered([_chr_words(t) for t in side], names) for side in (h, r))
        orders = _overlaps([a, b], [x, y], len(h), CHAR_N) + _overlaps([c, d], [u, v], len(h), WORD_N)
        parts.append(np.stack([col for o in orders for col in (np.where(o[1] > 0, o[0], 0), o[1], o[2])], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, 3 * (CHAR_N + WORD_N)), np.int64)


@F.pandas_udf(T.DoubleType())
def sentence_chrf(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """M3"""
    return pd.Series([chrf(x) for x in chrf_table(hyp.fillna("").tolist(), ref.fillna("").tolist()).tolist()], dtype="float64")


@F.pandas_udf(T.DoubleType())
def sentence_bleu(hyp: pd.Series, ref: pd.Series) -> pd.Series:
    """M4: with effective order."""
    return pd.Series([bleu(x, True) for x in bleu_table(hyp.fillna("").tolist(), ref.fillna("").tolist()).tolist()], dtype="float64")


BOTH_WAYS = T.StructType([T.StructField(x, T.DoubleType()) for x in ("ab", "ba")])


def _turned(table: np.ndarray, chrf_orders: bool) -> np.ndarray:
    """Statistics of pairs with their sides exchanged: what both share is the same from either side."""
    if chrf_orders:
        ref, hyp, both = table[:, 1::3], table[:, 0::3], table[:, 2::3]
        return np.stack([ref, hyp, both], axis=2).reshape(len(table), -1)
    length = table[:, 1:2]
    totals = np.maximum(0, length - np.arange(BLEU_N))
    return np.concatenate([length, table[:, :1], np.stack([table[:, 2::2], totals], axis=2).reshape(len(table), -1)], axis=1)


@F.pandas_udf(BOTH_WAYS)
def chrf_both_ways(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """M3 of a against b and of b against a, counted once."""
    table = chrf_table(a.fillna("").tolist(), b.fillna("").tolist())
    return pd.DataFrame({k: np.array([chrf(x) for x in t.tolist()], "float64") for k, t in (("ab", table), ("ba", _turned(table, True)))})


@F.pandas_udf(BOTH_WAYS)
def bleu_both_ways(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """M4 of a against b and of b against a, counted once."""
    table = bleu_table(a.fillna("").tolist(), b.fillna("").tolist())
    return pd.DataFrame({k: np.array([bleu(x, True) for x in t.tolist()], "float64") for k, t in (("ab", table), ("ba", _turned(table, False)))})


def corpus_scores(df: DataFrame, hypothesis: str, reference: str, by: list[str] | None = None) -> DataFrame:
    """Corpus BLEU, chrF++ and the root of their product. Statistics are summed in Spark; the closed forms see one row a group."""
    n = 2 + 2 * BLEU_N
    names = [f"b{i}" for i in range(n)] + [f"c{i}" for i in range(3 * (CHAR_N + WORD_N))]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sides = f["_h"].fillna("").tolist(), f["_r"].fillna("").tolist()
            rows = np.concatenate([bleu_table(*sides), chrf_table(*sides)], axis=1)
            yield pd.concat([f[by or []].reset_index(drop=True), pd.DataFrame(rows, columns=names, dtype="int64")], axis=1)

    base = df.select(*(by or []), F.col(hypothesis).alias("_h"), F.col(reference).alias("_r"))
    schema = ", ".join([f"`{c}` {t}" for c, t in base.dtypes if c in (by or [])] + [f"{c} long" for c in names])
    summed = base.mapInPandas(count, schema).groupBy(*(by or [])).agg(*(F.sum(c).alias(c) for c in names), F.count("*").alias("n"))

    @F.pandas_udf("bleu double, chrf double, geometric_mean double")
    def close(*cols: pd.Series) -> pd.DataFrame:
        rows = list(zip(*cols, strict=True))
        b = [bleu(r[:n]) for r in rows]
        c = [chrf(r[n:]) for r in rows]
        return pd.DataFrame({"bleu": b, "chrf": c, "geometric_mean": [math.sqrt(x * y) for x, y in zip(b, c, strict=True)]})

    return summed.withColumn("_s", close(*names)).select(*(by or []), "n", "_s.*")


def row_scores(df: DataFrame, hypothesis: str, reference: str) -> DataFrame:
    """Sentence scores a row; columns of these names that exist stay as *_old."""
    for c in ("bleu", "chrf", "geometric_mean"):
        df = df.withColumnRenamed(c, f"{c}_old") if c in df.columns else df
    h, r = F.coalesce(F.col(hypothesis), F.lit("")), F.coalesce(F.col(reference), F.lit(""))
    scored = df.withColumn("bleu", sentence_bleu(h, r)).withColumn("chrf", sentence_chrf(h, r))
    return scored.withColumn("geometric_mean", F.sqrt(F.col("bleu") * F.col("chrf")))


def reward(bleu_score: Column, chrf_score: Column, w: float = 0.5) -> Column:
    """A weighted mean of both, from 0 to 1."""
    return (w * bleu_score + (1 - w) * chrf_score) / 100


def rouge2(hyp: Column, ref: Column) -> Column:
    """struct(precision, recall, f1) over bigrams of lower-case words, repeats counted."""

    def tagged(text: Column) -> Column:
        """Sorted bigrams, each with its number among its equals."""
        words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
        pairs = let(words, lambda w: F.array_sort(F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x))))
        return let(pairs, lambda g: F.transform(g, lambda x, i: F.concat(x, F.lit(" "), (i + 1 - F.array_position(g, x)).cast("string"))))

    def score(ab: Column) -> Column:
        p = ab["both"] / F.greatest(ab["a"], F.lit(1))
        r = ab["both"] / F.greatest(ab["b"], F.lit(1))
        return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))

    sides = let(F.struct(tagged(hyp).alias("a"), tagged(ref).alias("b")), lambda s: F.struct(F.size(s["a"]).alias("a"), F.size(s["b"]).alias("b"), F.size(F.array_intersect(s["a"], s["b"])).alias("both")))
    return let(sides, score)


def _token_set(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """M2: of sets of lower-case tokens, 0 to 100; 100 if both are empty."""
    counts = let(F.struct(_token_set(a).alias("a"), _token_set(b).alias("b")), lambda s: F.struct(F.size(F.array_union(s["a"], s["b"])).alias("union"), F.size(F.array_intersect(s["a"], s["b"])).alias("both")))
    return let(counts, lambda c: F.when(c["union"] == 0, 100.0).otherwise(100.0 * c["both"] / c["union"]))


def dedupe_candidates(df: DataFrame, by: str, text: str, pos: str, fold: bool = True, priority: str | None = None) -> DataFrame:
    """M1: candidates that agree (but for case and white space, if folded) once, with their support, first place and greatest priority."""
    key = F.trim(F.regexp_replace(F.lower(F.col(text)), r"\s+", " ")) if fold else F.col(text)
    more = [F.max(priority).alias("priority")] if priority else []
    return df.withColumn("_key", key).groupBy(by, "_key").agg(F.count("*").alias("support"), F.min_by(text, pos).alias(text), F.min(pos).alias(pos), *more).drop("_key")


def length_bonus(df: DataFrame, by: str, size: Column) -> Column:
    """M6: 100 at the median length of a row's candidates, less away from it."""
    median = F.percentile(size, F.lit(0.5)).over(W.partitionBy(by))
    return 100 * F.exp(-0.5 * F.pow((size - median) / F.greatest(0.4 * median, F.lit(5.0)), 2))


def scaled(value: Column, by: str) -> Column:
    """M7: 0 to 100 between a row's least and greatest; 0 where they are equal."""
    w = W.partitionBy(by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(high > low, 100 * (value - low) / (high - low)).otherwise(0.0)


def _shared(units: np.ndarray, owner: np.ndarray, pool: np.ndarray, local: np.ndarray, slot: np.ndarray, width: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order up to the longest: n-grams of each text, and at place slot[pool] + i * width[pool] + j what texts i < j of a pool share (the
    smaller counts). units, owner: the texts' units one after another and the text of each. N-grams of a text are sorted once, whatever the
    number of texts that they are compared with; single units are compared as they are, longer ones by hashes."""
    bits = np.uint64(max(1, int(width.max() - 1).bit_length()))
    first = pool[owner].astype(np.uint64) * (units.max(initial=np.uint64(0)) + np.uint64(1)) + units
    places, keys, out = int(slot[-1] + width[-1] ** 2), first, []
    for n in range(1, longest + 1):
        if n > 1:
            keys = _hashed(keys[:-1] * _STEP + first[n - 1 :])
        of = owner[: len(keys)]
        whole = of == owner[n - 1 :]
        of = of[whole]
        key = (keys[whole] << bits) | local[of].astype(np.uint64)
        order = np.argsort(key)
        key, text = key[order], of[order]
        # One entry a text and n-gram; those of an n-gram stand side by side.
        start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else np.zeros(0, np.int64)
        many, gram, text = np.diff(np.append(start, len(key))), key[start] >> bits, text[start]
        at, found, least = np.arange(len(start)), [], []
        for d in range(1, int(width.max())):
            at = at[: np.searchsorted(at, len(start) - d)]
            at = at[(gram[at] == gram[at + d]) & (pool[text[at]] == pool[text[at + d]])]
            if not len(at):
                break
            x, y = text[at], text[at + d]
            found.append(slot[pool[x]] + local[x] * width[pool[x]] + local[y])
            least.append(np.minimum(many[at], many[at + d]))
        both = np.bincount(np.concatenate(found), np.concatenate(least), places) if found else np.zeros(places)
        out.append((np.bincount(of, minlength=len(pool)).astype(np.float64), both))
        if not len(keys):
            keys = np.zeros(1, np.uint64)
    return out


def _chrf_ways(orders: list[tuple[np.ndarray, np.ndarray]], a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`chrf` of texts a against texts b and of b against a."""
    precision, recall, used = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for total, both in orders:
        live = (total[a] > 0) & (total[b] > 0)
        precision += np.where(live, both[at] / np.maximum(total[a], 1), 0)
        recall += np.where(live, both[at] / np.maximum(total[b], 1), 0)
        used += live
    p, r = precision / np.maximum(used, 1), recall / np.maximum(used, 1)
    score = lambda p, r: np.where(p + r > 0, 100 * (1 + BETA**2) * p * r / np.where(p + r > 0, BETA**2 * p + r, 1), 0)
    return score(p, r), score(r, p)


def _bleu_way(orders: list[tuple[np.ndarray, np.ndarray]], hyp: np.ndarray, ref: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`bleu` of texts hyp against texts ref, with effective order."""
    length, other = orders[0][0][hyp], orders[0][0][ref]
    logs, smooth, used = np.zeros(len(hyp)), np.ones(len(hyp)), np.zeros(len(hyp))
    for n, (_, both) in enumerate(orders):
        total, match = np.maximum(length - n, 0), both[at]
        live = total > 0
        smooth = np.where(live & (match == 0), smooth * 2, smooth)
        logs += np.where(live, np.log(100 * np.where(match > 0, match, 1 / smooth) / np.maximum(total, 1)), 0)
        used += live
    short = np.exp(np.minimum(1 - other / np.maximum(length, 1), 0))
    return np.where((length > 0) & (orders[0][1][at] > 0), short * np.exp(logs / np.maximum(used, 1)), 0)


def _pool_chunks(pools: list[list[tuple[str, str]]]) -> Iterator[list[list[tuple[str, str]]]]:
    """Pools with CHUNK units of text or places of pairs, or one larger pool."""
    chunk: list[list[tuple[str, str]]] = []
    size = 0
    for p in pools:
        own = max(sum(len(t) + len(s) for t, s in p), len(p) ** 2)
        if chunk and size + own > CHUNK:
            yield chunk
            chunk, size = [], 0
        chunk.append(p)
        size += own
    if chunk:
        yield chunk


def pool_means(pools: list[list[tuple[str, str]]], w_chrf: float, w_bleu: float, w_jaccard: float) -> list[np.ndarray]:
    """M5: for each text of each pool the mean of its weighted scores against the pool's other texts; 0 where there is none.
    A text comes with its set of tokens, joined by blanks."""
    out: list[np.ndarray] = []
    for chunk in _pool_chunks(pools):
        width = np.array([len(p) for p in chunk])
        slot, begin = np.cumsum(width**2) - width**2, np.cumsum(width) - width
        pool = np.repeat(np.arange(len(chunk)), width)
        local = np.arange(len(pool)) - begin[pool]
        texts, sets = [t for p in chunk for t, _ in p], [s for p in chunk for _, s in p]
        shared = lambda flat, owner, longest: _shared(flat, owner, pool, local, slot, width, longest)  # noqa: B023, E731
        listed = lambda lists, longest: shared(*_numbered(lists, {}), longest)  # noqa: B023, E731
        place = np.arange(int(slot[-1] + width[-1] ** 2))
        of = np.repeat(np.arange(len(chunk)), width**2)
        i, j = np.divmod(place - slot[of], width[of])
        at = place[i < j]
        a, b = (begin[of] + i)[at], (begin[of] + j)[at]
        ab, ba = np.zeros(len(at)), np.zeros(len(at))
        if w_jaccard:
            ((total, both),) = listed([s.split(" ") if s else [] for s in sets], 1)
            union = total[a] + total[b] - both[at]
            score = np.where(union > 0, 100.0 * both[at] / np.maximum(union, 1), 100.0)
            ab, ba = ab + w_jaccard * score, ba + w_jaccard * score
        if w_chrf:
            x, y = _chrf_ways(shared(*_points(texts), CHAR_N) + listed([_chr_words(t) for t in texts], WORD_N), a, b, at)
            ab, ba = ab + w_chrf * x, ba + w_chrf * y
        if w_bleu:
            orders = listed([tokenize_13a(t) for t in texts], BLEU_N)
            ab, ba = ab + w_bleu * _bleu_way(orders, a, b, at), ba + w_bleu * _bleu_way(orders, b, a, at)
        sums = np.bincount(a, ab, len(pool)) + np.bincount(b, ba, len(pool))
        means = sums / ((w_chrf + w_bleu + w_jaccard) or 1) / np.maximum(width[pool] - 1, 1)
        out += np.split(means, begin[1:])
    return out


def mbr(df: DataFrame, by: str, text: str, pos: str, w_chrf: float = 0.55, w_bleu: float = 0.25, w_jaccard: float = 0.2, w_length: float = 0.1, w_support: float = 0.0, w_priority: float = 0.0, cap: int = 32) -> DataFrame:
    """M5, M8: the candidate most like the others. Pools are capped (T8) as the method has it, so a pool is one row of `cap` texts at most and
    no text is moved for each of its pairs. Scores that are equal to nine places are ties, which go to the first place."""
    ship(df.sparkSession)
    cands = dedupe_candidates(df, by, text, pos, priority="priority" if "priority" in df.columns else None)
    cands = cands.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("support"), pos))).filter(F.col("_r") <= cap)
    extra = ["priority"] if "priority" in cands.columns else []
    words = F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != ""))
    cands = cands.withColumn("_len", length_bonus(cands, by, words.cast("double")))
    cands = cands.withColumn("_bonus", w_length * F.col("_len") + w_support * scaled(F.col("support"), by) + (w_priority * scaled(F.col("priority"), by) if extra else 0.0))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def means(texts: pd.Series, sets: pd.Series) -> pd.Series:
        return pd.Series(pool_means([list(zip(t, s, strict=True)) for t, s in zip(texts, sets, strict=True)], w_chrf, w_bleu, w_jaccard), dtype=object)

    entry = F.struct(F.col(pos).alias("pos"), F.col(text).alias("text"), "support", F.col("_bonus").alias("bonus"))
    pools = cands.groupBy(by).agg(F.collect_list(entry).alias("_p"))
    # Rows without a pool are candidates, but none is compared with another.
    some = lambda f: F.when(F.col(by).isNull(), F.array().cast("array<string>")).otherwise(F.transform("_p", lambda x: f(F.coalesce(x["text"], F.lit("")))))
    scored = pools.select(by, "_p", means(some(lambda t: t), some(lambda t: F.array_join(_token_set(t), " "))).alias("_m"))
    ranked = F.transform("_p", lambda x, i: let(F.coalesce(F.get("_m", i), F.lit(0.0)) + x["bonus"], lambda s: F.struct((-F.round(s, 9)).alias("order"), x["pos"].alias("pos"), x["text"].alias("text"), x["support"].alias("support"), s.alias("score"))))
    best = scored.select(by, F.array_min(ranked).alias("_x"))
    return best.select(by, F.col("_x.pos").alias(pos), F.col("_x.text").alias(text), F.col("_x.support").alias("support"), F.col("_x.score").alias("score"))


def diverse_subset(texts: Column, k: int) -> Column:
    """M9: the first text, then again and again the one whose greatest likeness to those taken is least."""
    start = F.slice(texts, 1, 1)

    def add(acc: Column, _: Column) -> Column:
        rest = F.array_except(texts, acc)
        ranked = F.transform(rest, lambda t: F.struct(F.array_max(F.transform(acc, lambda x: token_jaccard(x, t))).alias("d"), F.array_position(texts, t).alias("i"), t.alias("t")))
        return F.when((F.size(rest) > 0) & (F.size(acc) < k), F.concat(acc, F.array(F.array_min(ranked)["t"]))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, k - 1))), start, add) if k > 1 else start
