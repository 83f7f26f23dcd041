"""Aggregations."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.regex import let
from tessella.operators.ranks import nearest_ranks, percentiles
from tessella.operators.skew import bit_filter
from tessella.session import materialize


def join_unique(value: str, order: str, sep: str = "\n---------\n") -> Column:
    """A1: distinct non-blank values in order of first sight, joined."""
    seen = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value)))), lambda s: s[value])
    return F.array_join(F.array_distinct(F.filter(seen, lambda x: F.trim(x) != "")), sep)


def quartile_fences(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """A2: one row: n, q1, median, q3, iqr, fences, and the whiskers (least and greatest value inside the fences)."""
    n, (q1, median, q3) = percentiles(df, value, [0.25, 0.5, 0.75])
    iqr = q3 - q1 if n else None
    low, high = (q1 - k * iqr, q3 + k * iqr) if n else (None, None)
    row = df.agg(F.min(F.when(F.col(value).between(F.lit(low), F.lit(high)), F.col(value))).alias("lower_whisker"), F.max(F.when(F.col(value).between(F.lit(low), F.lit(high)), F.col(value))).alias("upper_whisker"))
    told = {"n": n, "q1": q1, "median": median, "q3": q3, "iqr": iqr, "lower_fence": low, "upper_fence": high}
    return row.select(*(F.lit(v).cast("long" if c == "n" else "double").alias(c) for c, v in told.items()), "lower_whisker", "upper_whisker")


def describe(df: DataFrame, value: str) -> DataFrame:
    """A3: count, mean, median, population variance, extremes."""
    c, (_, (median,)) = F.col(value), percentiles(df, value, [0.5])
    return df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.lit(median).cast("double").alias("median"), F.var_pop(c).alias("variance"), F.min(c).alias("min"), F.max(c).alias("max"))


def drop_outliers(df: DataFrame, value: str, k: float = 1.5) -> DataFrame:
    """A4: rows within the fences of all rows given."""
    fences = quartile_fences(df, value, k).select("lower_fence", "upper_fence")
    return df.join(F.broadcast(fences), F.col(value).between(F.col("lower_fence"), F.col("upper_fence"))).drop("lower_fence", "upper_fence")


def percentile_profile(df: DataFrame, value: str, percents: tuple[int, ...] = (0, 5, 10, 25, 50, 75, 90, 95, 99, 100)) -> DataFrame:
    """A5: nearest-rank percentiles as rows."""
    return df.sparkSession.createDataFrame(list(zip(percents, nearest_ranks(df, value, percents), strict=True)), "percent int, value double")


def ratio_of_sums(df: DataFrame, part: str, whole: str) -> DataFrame:
    """A6"""
    return df.agg(F.sum(part).cast("long").alias("part"), F.sum(whole).cast("long").alias("whole"), (F.sum(part) / F.sum(whole)).alias("ratio"))


def rule_hits(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows each rule hits, one pass over the data."""
    wide = df.agg(*(F.count_if(c).alias(f"r{i}") for i, c in enumerate(rules.values())))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(f"r{i}").alias("hits")) for i, k in enumerate(rules)))).alias("x")).select("x.*")


def changed_rows(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """A8"""
    return df.agg(F.count("*").alias("n"), F.count_if(~before.eqNullSafe(after)).alias("changed"))


def char_inventory(df: DataFrame, text: str, key: str) -> DataFrame:
    """Characters, their count, and the first row (by key) that has them."""
    chars = df.select(F.col(key).alias("k"), F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "")).alias("ch")).filter("ch <> ''")
    return chars.groupBy("ch").agg(F.count("*").alias("n"), F.min("k").alias("first_key"))


def disallowed_syllables(df: DataFrame, text: str, key: str, alphabet: str) -> DataFrame:
    """A10: syllables (words split at hyphens) with characters outside the alphabet, the first row that has each."""
    from tessella.functions.regex import words_ws
    from tessella.operators.filters import disallowed_characters

    # Most words have plain letters alone: a look at each spares the rest of the work.
    other = F.lit("[^" + "".join("\\" + c if c in "\\]-[^&" else c for c in alphabet) + "]" if alphabet else "(?s).")
    odd = F.filter(words_ws(F.coalesce(F.col(text), F.lit(""))), lambda w: F.regexp_like(w, other))
    parts = df.select(F.col(key).alias("k"), F.explode(F.array_distinct(F.filter(F.flatten(F.transform(odd, lambda w: F.split(w, "-"))), lambda x: F.regexp_like(x, other)))).alias("syllable"))
    bad = parts.select("k", "syllable", disallowed_characters(F.col("syllable"), alphabet).alias("bad")).filter(F.size("bad") > 0)
    return bad.groupBy("syllable").agg(F.min("k").alias("first_key"), F.array_join(F.first("bad"), "").alias("disallowed"))


def pattern_inventory(df: DataFrame, columns: list[str], pattern: str) -> DataFrame:
    """The distinct matches of a pattern over several columns."""
    found = F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(pattern), F.lit(0)) for c in columns)))
    return df.select(F.explode(F.array_distinct(found)).alias("match")).distinct()


#: Of how many of the commonest words pairs are counted first, for each pair asked for; most words that a plan holds as a set.
PAIRED, SET_WORDS = 20, 5_000


def _pairs(words: Column) -> Column:
    """Adjacent words, joined by a blank; null where either is null."""
    return let(words, lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(F.get(w, i), F.lit(" "), x)))


def _several(df: DataFrame, key: str) -> DataFrame | None:
    """The keys that more than one row has, as a table of their own (`session.settle` deletes it); None where there are none."""
    keys = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_own")).count().filter("count > 1").select("_own")
    return materialize(keys, "repeated-keys") if keys.head(1) else None


def _counted(df: DataFrame, key: str, terms: Column, several: DataFrame | None) -> DataFrame:
    """(term, n, rows): how often a term is there, and at how many keys that are not null. A row's repeats are told apart where the row is,
    so that terms are added up before anything moves; only terms of keys with several rows meet by key."""
    own = [] if several is None else ["_own"]
    rows = df if several is None else df.join(several, F.col(key) == F.col("_own"), "left")
    both = let(terms, lambda t: F.struct(F.size(t).alias("k"), F.concat(t, F.array_distinct(t)).alias("t")))
    each = rows.select(*own, F.col(key).isNotNull().alias("known"), both.alias("x")).select(*own, "known", "x.k", F.posexplode("x.t").alias("i", "term"))
    per = each.groupBy("term", *own).agg(F.count_if(F.col("i") < F.col("k")).alias("n"), F.count_if((F.col("i") >= F.col("k")) & F.col("known")).alias("rows"))
    return per.groupBy("term").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_own").isNull(), F.col("rows")).otherwise(1)).alias("rows")) if own else per


def cooccurrence(df: DataFrame, key: str, words: Column) -> DataFrame:
    """Counts of words and of adjacent pairs, over the words left after filtering; one pass gives both kinds."""
    counts = _counted(df, key, let(words, lambda w: F.concat(w, _pairs(w))), _several(df, key))
    # A word has no blank in it, a pair has one.
    return counts.select(F.when(F.contains("term", F.lit(" ")), "bigram").otherwise("word").alias("kind"), "term", "n", "rows")


def top_cooccurrence(df: DataFrame, key: str, words: Column, k: int, least: int = 1) -> DataFrame:
    """Of `cooccurrence` the k commonest words and pairs that are there `least` times, ties by term.

    No pair is there more often than either of its words. So pairs of the commonest words are counted first, and the k-th of them tells
    which words a pair must have to be as common; if others than those counted can be in one, pairs of all such words are counted. Words and
    pairs are written on the way (`session.settle` deletes them)."""
    several = _several(df, key)
    of_words = materialize(_counted(df, key, words, several).filter(F.col("n") >= least), "word-counts")
    most: int | None = PAIRED * k
    while True:
        common = None if most is None else [r["term"] for r in of_words.orderBy(F.desc("n"), "term").limit(most).select("term").collect()]
        left = words if common is None else F.transform(words, lambda w: F.when(w.isin(common), w))  # noqa: B023
        of_pairs = materialize(_counted(df, key, F.filter(_pairs(left), lambda p: p.isNotNull()), several).filter(F.col("n") >= least), "pair-counts")
        if common is None:
            break
        last = of_pairs.orderBy(F.desc("n")).limit(k).select("n").collect()
        able = of_words.filter(F.col("n") >= (last[-1]["n"] if len(last) == k else least)).count()
        if able <= len(common):
            break
        most = able if able <= SET_WORDS else None
    kinds = [t.select(F.lit(kind).alias("kind"), "term", "n", "rows") for kind, t in (("word", of_words), ("bigram", of_pairs))]
    return top_k(kinds[0].unionByName(kinds[1]), ["kind"], [F.desc("n"), F.asc("term")], k)


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank")


def token_dictionary(df: DataFrame, key: str, tokens: Column, words: Column | None, min_rows: int = 2, k: int = 5, examples: int = 3) -> DataFrame:
    """For each source token its rows, occurrences, first examples and, if words are given, the commonest words of the other side. With words, a few
    small tables are written on the way (`session.settle` deletes them)."""
    base = df.select(F.col(key).alias("key"), tokens.alias("t"), *([words.alias("w")] if words is not None else []))
    per_row = base.select("key", F.explode("t").alias("token")).groupBy("token", "key").agg(F.count("*").alias("n"))
    totals = per_row.groupBy("token").agg(F.count("*").alias("n_rows"), F.sum("n").alias("n_occurrences")).filter(F.col("n_rows") >= min_rows)
    # The first keys of a token are cut before they meet: no task holds all keys of a frequent one.
    first = top_k(per_row, ["token"], [F.asc("key")], examples).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("e"))
    totals = totals.join(first, "token").select("token", "n_rows", "n_occurrences", F.col("e.key").alias("examples"))
    if words is None:
        return totals
    totals = materialize(totals, "tokens")
    return totals.join(_top_words(base, totals, k), "token", "left")


#: Rows of a task that counts words by token; the share of all rows from which a token's are dealt over tasks; in which part of a token's rows its commonest words likely are.
TOKEN_ROWS, HOT_SHARE, LIKELY = 200_000, 1 / 100, 10


def _top_words(base: DataFrame, totals: DataFrame, k: int) -> DataFrame:
    """(token, top_words): the commonest k words of the rows that hold a token, ties by word.

    Words go as 64-bit numbers, by a hash that gives no two words of the texts the same. A token's rows come together with their words, which are
    counted where they are, so that pairs of token and word are never moved. Tokens with a large share of all rows, fewer than 1 / HOT_SHARE, are counted on
    both sides of a shuffle instead."""
    for seed in count():
        number = lambda w: F.xxhash64(w, F.lit(seed))  # noqa: B023, E731
        names = base.select(F.explode(F.array_distinct("w")).alias("word")).distinct().select("word", number(F.col("word")).alias("x"))
        names = materialize(names, "words")
        if not names.groupBy("x").count().filter("count > 1").head(1):
            break
    n = totals.agg(F.sum("n_rows")).first()[0] or 0
    hot = [r["token"] for r in totals.filter(F.col("n_rows") > n * HOT_SHARE).select("token").collect()]
    rows = base.select(F.array_distinct("t").alias("t"), F.transform("w", number).alias("w")).select(F.explode("t").alias("token"), "w")  # numbered once a row

    def best(of: DataFrame, least: Column) -> DataFrame:
        """Of the tokens of `of`, the words counted `least` times or more that may be among the k commonest: ties stay in."""
        some = bit_filter(of.select(F.xxhash64("token").alias("h")), "h")(rows.withColumn("h", F.xxhash64("token")), "h").drop("h")
        parts = max(rows.sparkSession.sparkContext.defaultParallelism, n // TOKEN_ROWS + 1)
        sides = [some.filter(~F.col("token").isin(hot)).repartition(parts, "token"), *([some.filter(F.col("token").isin(hot))] if hot else [])]
        counted = [x.join(of, "token").select("token", "n_rows", F.explode("w").alias("x")).groupBy("token", "n_rows", "x").agg(F.count("*").alias("n")).filter(least) for x in sides]
        ranked = [c.withColumn("_rank", F.rank().over(W.partitionBy("token").orderBy(F.desc("n")))).filter(F.col("_rank") <= k) for c in counted]
        return materialize(reduce(DataFrame.unionByName, ranked).select("token", "x", "n"), "words-of-tokens")

    # Sorting all pairs would cost more than counting them: words of few of a token's rows are left out first. Tokens that then have fewer than k words are done again with all.
    tokens = totals.select("token", "n_rows")
    ties = best(tokens, F.col("n") * LIKELY >= F.col("n_rows"))
    full = ties.groupBy("token").count().filter(F.col("count") >= k)
    short = materialize(tokens.join(full, "token", "left_anti"), "short-tokens")
    if short.head(1):
        ties = ties.join(full, "token", "left_semi").unionByName(best(short, F.lit(True)))
    top = top_k(ties.join(names, "x"), ["token"], [F.desc("n"), F.asc("word")], k)
    top = top.groupBy("token").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))).alias("top"))
    return top.select("token", F.col("top.word").alias("top_words"))


def phrase_summary(df: DataFrame, key: str, tokens: Column, phrase: list[str], window: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, positions, contexts) of the rows that hold the phrase, and their columns `keep`; overlapping occurrences count each."""
    k = len(phrase)
    query = F.array(*map(F.lit, phrase))

    def found_in(t: Column) -> Column:
        spots = F.when(F.size(t) >= k, F.filter(F.sequence(F.lit(1), F.greatest(F.size(t) - (k - 1), F.lit(1))), lambda i: (F.get(t, i - 1) == query[0]) & (F.slice(t, i, k) == query))).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.struct((i - 1).cast("long").alias("pos"), F.array_join(F.slice(t, F.greatest(i - window, F.lit(1)), F.least(i, F.lit(window + 1)) - 1 + k + window), " ").alias("context")))

    found = df.select(F.col(key), *keep, let(tokens, found_in).alias("_f")).filter(F.size("_f") > 0)
    return found.select(key, *keep, F.size("_f").cast("long").alias("n"), F.col("_f.pos").alias("positions"), F.col("_f.context").alias("contexts"))


def phrase_report(df: DataFrame, key: str, order: str, tokens: Column, translation: str, words: Column, phrase: list[str], k: int = 10, examples: int = 5, window: int = 3, least: int = 2) -> DataFrame:
    """A13, whole: (kind, rank, item, context, n). Kinds: rows and occurrences (one row each, n their number); word, bigram and translation: the k
    commonest of the rows that hold the phrase, least times or more, ties in order of first sight; example: the first occurrences, by `order` and place, with
    the row's key, its context and its translation. Counts and cuts combine before the shuffle; a null translation counts as an empty one. Writes one table on the way (`session.settle` deletes it)."""
    # A row takes its own columns along: no text moves. Only rows with the phrase are written, for the three uses below.
    base = df.select("*", F.col(key).cast("string").alias("_key"), F.col(order).alias("_o"), F.trim(F.coalesce(F.col(translation), F.lit(""))).alias("_x"))
    summed = phrase_summary(base, "_key", tokens, phrase, window, keep=("_o", "_x", *dict.fromkeys(df.columns)))
    found = summed.select(F.col("_key").alias("key"), F.col("_o").alias("o"), F.col("_x").alias("x"), words.alias("w"), "n", "contexts")
    found = materialize(found, "phrase-rows")
    pairs = F.when(F.size("w") > 1, F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", F.get("w", i), x))).otherwise(F.array().cast("array<string>"))
    kinds = {"word": F.col("w"), "bigram": pairs, "translation": F.array("x")}
    each = found.select("o", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), v.alias("v")) for c, v in kinds.items()))).alias("s")).select("o", "s.kind", F.posexplode("s.v").alias("i", "item"))
    counted = each.groupBy("kind", "item").agg(F.count("*").alias("n"), F.min(F.struct("o", "i")).alias("first")).filter(F.col("n") >= least)
    ranked = counted.withColumn("rank", F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "first"))).filter(F.col("rank") <= k)
    none = F.lit(None).cast("string")
    tops = ranked.select("kind", F.col("rank").cast("long").alias("rank"), "item", none.alias("context"), "n")
    spots = found.select("o", "key", "x", F.posexplode("contexts").alias("i", "context")).orderBy("o", "i").limit(examples)
    shown = spots.withColumn("rank", F.row_number().over(W.orderBy("o", "i")).cast("long"))  # `examples` rows
    told = shown.select(F.lit("example").alias("kind"), "rank", F.concat_ws("\t", "key", "x").alias("item"), "context", F.lit(1).cast("long").alias("n"))
    sums = found.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"))
    heads = sums.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("n")) for c in ("rows", "occurrences")))).alias("h")).select("h.kind", F.lit(1).cast("long").alias("rank"), none.alias("item"), none.alias("context"), "h.n")
    return heads.unionByName(tops).unionByName(told)


def type_sets(df: DataFrame, form: str, kind: str) -> DataFrame:
    """The sorted types of each form."""
    return df.groupBy(form).agg(F.array_sort(F.collect_set(kind)).alias("types"))


def vote(df: DataFrame, token: str, choice: str, confidence: str | None = None, low: str = "low", max_variants: int = 4, sep: str = " / ") -> DataFrame:
    """Choices by (-count, choice), low confidence left out; tokens with too many variants go."""
    df = df.filter(F.coalesce(F.col(confidence), F.lit("")) != low) if confidence else df
    counts = df.groupBy(token, choice).agg(F.count("*").alias("n"))
    ranked = counts.groupBy(token).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col(choice).alias("c")))).alias("r"))
    return ranked.filter(F.size("r") <= max_variants).select(token, F.array_join(F.transform("r", lambda x: x["c"].cast("string")), sep).alias("choices"), (-F.col("r")[0]["n"]).alias("best_n"))


def coverage(df: DataFrame, hints: Column) -> DataFrame:
    """Rows with a hint, and hints a row."""
    return df.agg(F.count("*").alias("n"), F.count_if(hints > 0).alias("covered"), F.avg(hints).alias("mean_hints"))


def result_profile(df: DataFrame, text: str) -> DataFrame:
    """Share of empty results and their lengths."""
    sized = df.select(F.length(F.coalesce(F.col(text), F.lit(""))).alias("size"))
    size, (_, (median,)) = F.col("size"), percentiles(sized, "size", [0.5])
    return sized.agg(F.count("*").alias("n"), (100.0 * F.count_if(size == 0) / F.count("*")).alias("empty_percent"), F.avg(size).alias("mean"), F.lit(median).cast("double").alias("median"), F.min(size).alias("min"), F.max(size).alias("max"))


def span_bounds(df: DataFrame, by: list[str], page: str, order: str, key: str) -> DataFrame:
    """First and last page and id of each span."""
    return df.groupBy(*by).agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.min_by(key, order).alias("first_id"), F.max_by(key, order).alias("last_id"), F.count("*").alias("length"))


def page_titles(df: DataFrame, page: str, top: str, text: str, limit: float = 90.0, pattern: str = ".") -> DataFrame:
    """The joined text of the rows at the top of a page, on all its rows, where it matches the pattern."""
    title = df.filter(F.col(top) <= limit).groupBy(page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(top, text))), lambda s: s[text]), " ").alias("title"))
    return df.join(title.filter(F.regexp_like("title", F.lit(pattern))), page, "left")


def token_estimate(text: Column) -> Column:
    """A third of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 3).cast("long")


def cost(tokens_in: Column, tokens_out: Column, cached: Column, price_in: Column, price_out: Column, price_cached: Column) -> Column:
    """US dollars, prices a million tokens; a missing cached price is the input price."""
    return ((tokens_in - cached) * price_in + cached * F.coalesce(price_cached, price_in) + tokens_out * price_out) / 1e6


def usage_rollup(df: DataFrame, by: list[str], tokens_in: str, tokens_out: str, usd: str, pending: int = 0) -> DataFrame:
    """Sums, means and the projected cost of what is pending."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"), F.avg(tokens_in).alias("mean_in"), F.sum(usd).alias("usd"), (F.avg(usd) * pending).alias("usd_pending")
    )
