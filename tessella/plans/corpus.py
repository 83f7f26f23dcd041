"""Queries on pairs and texts: filters, statistics, normalisation, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import numbers, text
from tessella.functions.regex import let, squeeze, words_space, words_ws
from tessella.operators import aggregates, filters, windows
from tessella.plans.registry import query, table
from tessella.session import settle

PAIRS_SQL = """
WITH pairs AS (
  SELECT * FROM (
    SELECT conv_id, turn, coalesce(text, '') AS source, lead(text) OVER w AS target
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  ) WHERE target IS NOT NULL
), counted AS (
  SELECT conv_id, turn, source, target,
    len(list_filter(regexp_split_to_array(source, '\\s+'), lambda x: x <> '')) AS n_source,
    len(list_filter(regexp_split_to_array(target, '\\s+'), lambda x: x <> '')) AS n_target
  FROM pairs
), ratios AS (SELECT *, n_target / n_source::DOUBLE AS ratio FROM counted WHERE n_source > 0 AND n_target > 0)
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn and the next one of its conversation."""
    w = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("source"), F.lead("text").over(w).alias("target"))
    return rows.filter("target is not null")


def ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = pairs(spark, sf_dir).withColumns({"n_source": F.size(words_ws(F.col("source"))).cast("long"), "n_target": F.size(words_ws(F.col("target"))).cast("long")})
    return counted.filter("n_source > 0 and n_target > 0").withColumn("ratio", F.col("n_target") / F.col("n_source"))


_FENCES = """, q AS (
  SELECT count(*) AS n, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.5) AS median, quantile_cont(ratio, 0.75) AS q3 FROM ratios
), fences AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
"""


@query(PAIRS_SQL + _FENCES + "SELECT f.*, min(ratio) AS lower_whisker, max(ratio) AS upper_whisker FROM fences f JOIN ratios r ON ratio BETWEEN lower_fence AND upper_fence GROUP BY ALL")
def length_ratio_stats(spark, sf_dir):
    """A2: quartiles, fences and whiskers of the length ratio of turns."""
    return aggregates.quartile_fences(ratios(spark, sf_dir).select("ratio"), "ratio")


@query(PAIRS_SQL + _FENCES + "SELECT conv_id, turn, n_source, n_target, ratio FROM ratios JOIN fences ON ratio BETWEEN lower_fence AND upper_fence")
def length_ratio_outliers(spark, sf_dir):
    """A4: pairs within the fences."""
    return aggregates.drop_outliers(ratios(spark, sf_dir).select("conv_id", "turn", "n_source", "n_target", "ratio"), "ratio")


@query(PAIRS_SQL + "SELECT count(*) AS n, avg(ratio) AS mean, quantile_cont(ratio, 0.5) AS median, var_pop(ratio) AS variance, min(ratio) AS min, max(ratio) AS max FROM ratios")
def ratio_describe(spark, sf_dir):
    """A3"""
    return aggregates.describe(ratios(spark, sf_dir).select("ratio"), "ratio")


@query(PAIRS_SQL + "SELECT conv_id, turn FROM counted WHERE n_source > 5 AND n_target > 5")
def min_words(spark, sf_dir):
    """F2"""
    return filters.min_words(pairs(spark, sf_dir), "source", "target").select("conv_id", "turn")


@query(PAIRS_SQL + "SELECT conv_id, turn, n_source FROM counted WHERE n_source <= 10")
def short_rows(spark, sf_dir):
    """F3"""
    short = filters.short_rows(pairs(spark, sf_dir), "source", 10)
    return short.select("conv_id", "turn", F.size(words_ws(F.col("source"))).cast("long").alias("n_source"))


_TEXT = "coalesce(text, '')"


@query(f"SELECT doc_id, md5(trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g'))) AS digest, length(trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g'))) AS n FROM documents")
def whitespace_clean(spark, sf_dir):
    """N8"""
    clean = squeeze(text.nonnull(F.col("text")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("n"))


@query(f"SELECT doc_id, len(list_filter(string_split({_TEXT}, ' '), lambda x: x <> '')) AS by_blank, len(list_filter(regexp_split_to_array({_TEXT}, '\\s+'), lambda x: x <> '')) AS by_space FROM documents")
def word_counts(spark, sf_dir):
    """H3: both definitions of a word."""
    t = text.nonnull(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words_space(t)).cast("long").alias("by_blank"), F.size(words_ws(t)).cast("long").alias("by_space"))


@query(f"SELECT doc_id, md5(translate({_TEXT}, 'ḫḪ₀₁₂₃₄₅₆₇₈₉—–ʾ', 'hH0123456789--')) AS digest FROM documents")
def char_translate(spark, sf_dir):
    """N17"""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.characters(text.nonnull(F.col("text")))).alias("digest"))


def _sql_diacritics(x: str) -> str:
    for a, b in (("sz", "š"), ("SZ", "Š"), ("s,", "ṣ"), ("S,", "Ṣ"), ("t,", "ṭ"), ("T,", "Ṭ")):
        x = f"replace({x}, '{a}', '{b}')"
    for digit, to in (("2", "áéíúÁÉÍÚ"), ("3", "àèìùÀÈÌÙ")):
        for v, a in zip("aeiuAEIU", to, strict=True):
            x = f"replace({x}, '{v}{digit}', '{a}')"
    return x


@query(f"SELECT doc_id, md5({_sql_diacritics('coalesce(text, chr(32))')}) AS digest FROM documents")
def diacritics(spark, sf_dir):
    """N11"""
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.md5(text.diacritics(F.coalesce("text", F.lit(" ")))).alias("digest"))


def _sql_signs(x: str) -> str:
    for a, b in (("0.8333", "⅚"), ("0.6666", "⅔"), ("0.3333", "⅓"), ("0.1666", "⅙"), ("0.625", "⅝"), ("0.75", "¾"), ("0.25", "¼"), ("0.5", "½")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(f"SELECT l_orderkey, l_linenumber, {_sql_signs('printf(chr(37) || chr(46) || chr(50) || chr(102), l_discount * 5)')} AS signs FROM lineitem")
def fraction_signs(spark, sf_dir):
    """N18, on discounts as texts: not anchored, so 10.5 becomes 1½."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", text.fraction_signs(F.format_string("%.2f", F.col("l_discount") * 5)).alias("signs"))


@query("SELECT p_partkey, CASE WHEN p_size = 0 THEN '1 / 0' ELSE regexp_replace(regexp_replace(printf('%.4f', round(1.0::DOUBLE / p_size, 4)), '0+$', ''), '\\.$', '') END AS value FROM part")
def fraction_decimals(spark, sf_dir):
    """N6"""
    frac = F.concat(F.lit("1 / "), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", numbers.fractions_to_decimals(frac).alias("value"))


@query("SELECT l_orderkey, l_linenumber, 'sum ' || CAST(CAST(l_quantity AS BIGINT) + l_linenumber AS VARCHAR) || ' end' AS value FROM lineitem")
def addition_folding(spark, sf_dir):
    """N7"""
    expr = F.concat(F.lit("sum "), F.col("l_quantity").cast("long").cast("string"), F.lit(" + "), F.col("l_linenumber").cast("string"), F.lit(" end"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numbers.fold_additions(expr).alias("value"))


@query()
def gap_unify(spark, sf_dir):
    """N14, on all texts; its lookarounds have no counterpart in the other engine, tests hold it against Python."""
    t = text.nonnull(F.col("text"))
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.md5(squeeze(text.unify_gaps(t))).alias("digest"))


@query()
def normalize_source_v2(spark, sf_dir):
    """N22"""
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.md5(text.normalize_source(F.col("text"), "v2")).alias("digest"))


@query()
def normalize_target_v2(spark, sf_dir):
    """N23"""
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.md5(text.normalize_target(F.col("text"), "v2")).alias("digest"))


@query()
def normalize_inference(spark, sf_dir):
    """All inference profiles on both sides."""
    sides = [f"{side}_{p}" for p in ("infer", "simple", "best") for side in ("source", "target")]
    digest = let(text.inference(F.col("text")), lambda s: F.md5(F.concat_ws("\x01", *(s[k] for k in sides))))
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", digest.alias("digest"))


@query()
def clean_v1(spark, sf_dir):
    """N1, N2"""
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.md5(text.clean_source_v1(F.col("text"))).alias("source"), F.md5(text.clean_target_v1(F.col("text"))).alias("target"))


@query()
def repeated_word_dedupe(spark, sf_dir):
    """Needs backreferences, which the other engine lacks."""
    t = text.nonnull(F.col("text"))
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", F.length(text.repeated_words(t)).cast("long").alias("n"))


@query("SELECT doc_id, text, lang FROM documents WHERE NOT (coalesce(trim(text), '') IN ('', 'Other', 'None') OR regexp_matches(coalesce(trim(text), ''), '^[A-Z!]+$'))")
def exclusion_filter(spark, sf_dir):
    """F1"""
    return filters.exclude(table(spark, sf_dir, "documents"), "text", ("", "Other", "None"), ("^[A-Z!]+$",)).select("doc_id", "text", "lang")


@query("SELECT label, count(*) AS n FROM (SELECT unnest([CASE WHEN contains(text, 'token') THEN 'secret' END, CASE WHEN contains(text, 'License') THEN 'license' END, CASE WHEN regexp_matches(text, '[0-9]{4}') THEN 'digits' END]) AS label FROM documents) WHERE label IS NOT NULL GROUP BY label")
def detection_counts(spark, sf_dir):
    """F4"""
    rules = [("secret", "text", "token", False), ("license", "text", "License", False), ("digits", "text", "[0-9]{4}", True)]
    return filters.detect(table(spark, sf_dir, "documents").select("text"), rules).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT 'upper' AS rule, count(*) FILTER (regexp_matches(text, '[A-Z]{5}')) AS hits FROM documents UNION ALL SELECT 'literal', count(*) FILTER (contains(text, ' the ')) FROM documents UNION ALL SELECT 'token', count(*) FILTER (list_contains(regexp_split_to_array(text, '\\s+'), 'the')) FROM documents")
def rule_hits(spark, sf_dir):
    """A7"""
    t = F.col("text")
    return aggregates.rule_hits(table(spark, sf_dir, "documents"), {"upper": F.regexp_like(t, F.lit("[A-Z]{5}")), "literal": F.contains(t, F.lit(" the ")), "token": F.array_contains(F.split(t, r"\s+"), "the")})


@query(f"SELECT count(*) AS n, count(*) FILTER (text IS DISTINCT FROM trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g'))) AS changed FROM documents")
def changed_rows(spark, sf_dir):
    """A8"""
    return aggregates.changed_rows(table(spark, sf_dir, "documents"), F.col("text"), squeeze(text.nonnull(F.col("text"))))


_TAGGED = "replace(replace(coalesce(text, ''), ' the ', ' <x '), ' of ', ' y> ')"


@query(f"SELECT doc_id, field, opened, closed FROM (SELECT doc_id, unnest(['whole', 'head']) AS field, unnest([length(t) - length(replace(t, '<', '')), length(h) - length(replace(h, '<', ''))]) AS opened, unnest([length(t) - length(replace(t, '>', '')), length(h) - length(replace(h, '>', ''))]) AS closed FROM (SELECT doc_id, {_TAGGED} AS t, left({_TAGGED}, 80) AS h FROM documents)) WHERE opened <> closed")
def unbalanced_brackets(spark, sf_dir):
    """F9, with `the` and `of` standing for brackets."""
    whole = F.replace(F.replace(text.nonnull(F.col("text")), F.lit(" the "), F.lit(" <x ")), F.lit(" of "), F.lit(" y> "))
    docs = table(spark, sf_dir, "documents").select("doc_id", whole.alias("whole"), F.left(whole, F.lit(80)).alias("head"))
    return filters.unbalanced(docs, "whole", "head").select("doc_id", "field", "opened", "closed")


@query("SELECT ch, count(*) AS n, min(doc_id) AS first_key FROM (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch")
def char_inventory(spark, sf_dir):
    """A9"""
    return aggregates.char_inventory(table(spark, sf_dir, "documents", heavy=True), "text", "doc_id")


_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ,."


@query(f"""
SELECT syllable, min(doc_id) AS first_key, any_value(array_to_string(list_sort(list_distinct(list_filter(string_split(syllable, ''), lambda c: c <> '' AND NOT contains('{_ALPHABET}', c)))), '')) AS disallowed
FROM (SELECT doc_id, unnest(string_split(w, '-')) AS syllable FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents))
WHERE regexp_replace(syllable, '[a-zA-Z,.]', '', 'g') <> '' GROUP BY syllable""")
def disallowed_syllables(spark, sf_dir):
    """A10, F14"""
    return aggregates.disallowed_syllables(table(spark, sf_dir, "documents", heavy=True), "text", "doc_id", _ALPHABET)


@query("SELECT DISTINCT unnest(regexp_extract_all(html, '<[a-z0-9]+')) AS match FROM pages")
def tag_inventory(spark, sf_dir):
    """A11"""
    return aggregates.pattern_inventory(table(spark, sf_dir, "pages"), ["html"], "<[a-z0-9]+")


_DENSITY_SQL = """
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, len(w) AS words, len(list_filter(w, lambda x: length(x) <= 3)) AS marks FROM t),
dens AS (SELECT *, CASE WHEN words = 0 THEN 0.0 ELSE marks / words::DOUBLE END AS density FROM d)
"""


def _density(spark, sf_dir):
    w = words_ws(text.nonnull(F.col("text")))
    d = table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("words"), F.size(F.filter(w, lambda x: F.length(x) <= 3)).cast("long").alias("marks"))
    return d.withColumn("density", F.when(F.col("words") == 0, 0.0).otherwise(F.col("marks") / F.col("words")))


@query(_DENSITY_SQL + "SELECT doc_id, words, marks, density FROM (SELECT *, row_number() OVER (ORDER BY density DESC, marks DESC, words DESC, doc_id DESC) AS rn, ceil(count(*) OVER () * 0.15) AS cut FROM dens) WHERE rn > cut")
def top_fraction_removal(spark, sf_dir):
    """Without the densest 15 percent."""
    return windows.drop_top_fraction(_density(spark, sf_dir), [F.desc("density"), F.desc("marks"), F.desc("words"), F.desc("doc_id")], 0.15)


@query(_DENSITY_SQL + "SELECT unnest([0, 25, 50, 75, 90, 100]) AS percent, unnest([quantile_disc(density, 0.0), quantile_disc(density, 0.25), quantile_disc(density, 0.5), quantile_disc(density, 0.75), quantile_disc(density, 0.9), quantile_disc(density, 1.0)]) AS value FROM dens")
def percentile_profile(spark, sf_dir):
    """A5"""
    return aggregates.percentile_profile(_density(spark, sf_dir), "density", (0, 25, 50, 75, 90, 100))


@query(_DENSITY_SQL + "SELECT sum(marks)::BIGINT AS part, sum(words)::BIGINT AS whole, sum(marks) / sum(words)::DOUBLE AS ratio FROM dens")
def ratio_of_sums(spark, sf_dir):
    """A6"""
    return aggregates.ratio_of_sums(_density(spark, sf_dir), "marks", "words")


@query("""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(replace(replace(text, ' the ', ' [x] '), ' of ', ' (...) '), '\\s+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, list_transform(w, lambda x: trim(x, '[](){}<>⸢⸣⌈⌉⌊⌋⟦⟧')) AS o FROM t),
m AS (SELECT doc_id, list_filter(o, lambda x: regexp_matches(trim(x, '*''"'), '^(?:\\.{3,}|…+)$')) AS dots, list_filter(o, lambda x: trim(x, '*''"') <> '' AND NOT regexp_matches(trim(x, '*''"'), '^(?:\\.{3,}|…+)$') AND trim(x, '.,;:!?+-*''"') <> '') AS plain FROM s)
SELECT doc_id, (len(dots) + len(plain))::BIGINT AS words, len(list_filter(plain, lambda x: trim(x, '.,;:!?+-*''"') = 'x'))::BIGINT AS x, len(dots)::BIGINT AS ellipsis FROM m""")
def marker_counts(spark, sf_dir):
    """N52, with `the` and `of` standing for gap marks."""
    m = text.marker_counts(F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit(" [x] ")), F.lit(" of "), F.lit(" (...) ")))
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", m.alias("m")).select("doc_id", F.col("m.words").cast("long").alias("words"), F.col("m.x").cast("long").alias("x"), F.col("m.ellipsis").cast("long").alias("ellipsis"))


_TURNS_SQL = """
WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS text, coalesce(text LIKE '%.', false) AS ends FROM conversations),
i AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM t)
"""


@query(_TURNS_SQL + "SELECT conv_id, island, min(turn) AS first, max(turn) AS last, count(*) AS length, bool_or(ends) AS closed, md5(string_agg(text, ' ' ORDER BY turn)) AS digest FROM i GROUP BY conv_id, island")
def sentence_islands(spark, sf_dir):
    """Turns joined until one ends in a full stop."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", text.nonnull(F.col("text")))
    out = settle(spark, lambda: windows.merge_islands(turns, ["conv_id"], "turn", ["text"], F.endswith("text", F.lit("."))), "islands")
    return out.select("conv_id", "island", "first", "last", "length", "closed", F.md5("text").alias("digest"))


@query("""
WITH t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn, len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT a.conv_id, a.turn AS start, max(b.turn) AS "end", count(*) AS length, sum(b.n)::DOUBLE AS n
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.rn >= a.rn JOIN (SELECT unnest(range(1, 6)) AS k) ON b.rn < a.rn + k
WHERE a.rn + k - 1 <= (SELECT max(rn) FROM t c WHERE c.conv_id = a.conv_id) GROUP BY a.conv_id, a.turn, k HAVING sum(b.n) <= 200""")
def contiguous_windows(spark, sf_dir):
    """Runs of one to five turns within 200 words."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(words_ws(text.nonnull(F.col("text")))).cast("double").alias("n"))
    out = windows.spans(turns, ["conv_id"], "turn", ["n"], 200)
    return out.withColumn("length", F.col("length").cast("long"))


@query("SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN event_type || user_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), '') AS label FROM events")
def forward_fill(spark, sf_dir):
    """W3"""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") == "click", F.concat("event_type", F.col("user_id").cast("string"))).otherwise("").alias("label"))
    return settle(spark, lambda: windows.forward_fill(e, ["user_id"], "o", "label").select("event_id", "label"), "filled")


@query("SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 0 ELSE 1 END AS new FROM events)")
def run_grouping(spark, sf_dir):
    """W4"""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("o"))
    return settle(spark, lambda: windows.runs(e, ["user_id"], "o", "event_type").select("event_id", "run"), "runs")


@query("""
WITH t AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM (SELECT conv_id, turn, coalesce(regexp_matches(trim(text), '[.!?]["''”’)\\]]*$') AND NOT regexp_matches(trim(text), '(?:\\.{3,}|…)["''”’)\\]]*$'), false) AS ends FROM conversations)),
g AS (SELECT conv_id, island, min(turn) AS page_start, max(turn) AS page_end, count(*) AS length, bool_or(ends) AS closed FROM t GROUP BY conv_id, island)
SELECT conv_id, page_start, page_end, length, row_number() OVER (PARTITION BY conv_id ORDER BY island) AS segment_index FROM g WHERE closed""")
def segment_numbering(spark, sf_dir):
    """Finished segments with their bounds, numbered."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", text.nonnull(F.col("text")))
    marked = settle(spark, lambda: windows.islands(turns.withColumn("ends", filters.is_terminal(F.col("text"))), ["conv_id"], "turn", F.col("ends")), "islands")
    bounds = aggregates.span_bounds(marked, ["conv_id", "island"], "turn", "turn", "turn").join(marked.groupBy("conv_id", "island").agg(F.bool_or("ends").alias("closed")), ["conv_id", "island"])
    out = windows.number_segments(bounds, ["conv_id"], "island", F.col("closed"))
    return out.select("conv_id", "page_start", "page_end", "length", F.col("segment_index").cast("long").alias("segment_index"))


@query("SELECT event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def neighbours(spark, sf_dir):
    """W6"""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("o"))
    return windows.neighbours(e, ["user_id"], "o", "event_id").select("event_id", "previous", "next")


@query("SELECT min(doc_id) AS doc_id, text, lang FROM documents GROUP BY text, lang")
def exact_dedupe_first(spark, sf_dir):
    """The first row of each text and language."""
    return windows.dedupe_first(table(spark, sf_dir, "documents").select("text", "lang", "doc_id"), ["text", "lang"], "doc_id")


@query("SELECT source, lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def keyed_dedupe_cap(spark, sf_dir):
    """The first three of each key."""
    return aggregates.top_k(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], [F.col("doc_id")], 3)


@query("SELECT CAST(o_custkey AS VARCHAR) || '--swap-' || CAST(n AS VARCHAR) AS new_id, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3")
def capped_augmentation(spark, sf_dir):
    """W10"""
    return windows.cap_per_source(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("new_id", "o_orderkey")


@query("SELECT doc_id, bin FROM (SELECT doc_id, CASE WHEN (SELECT count(*) FROM documents) >= 500 THEN ntile(5) OVER (ORDER BY n_chars, doc_id) ELSE ntile(2) OVER (ORDER BY n_chars, doc_id) END AS bin FROM documents)")
def quantile_bins(spark, sf_dir):
    """W11"""
    return windows.quantile_bins(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", F.col("bin").cast("long").alias("bin"))


@query("SELECT doc_id, least((row_number() OVER (ORDER BY n_chars, doc_id) - 1) // (count(*) OVER () // 7), 6)::BIGINT AS bucket FROM documents")
def length_buckets(spark, sf_dir):
    """W12"""
    return windows.length_buckets(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 7).select("doc_id", F.col("bucket").cast("long").alias("bucket"))


@query("""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM conversations),
e AS (SELECT conv_id, turn, i, sum(length(w[i]) + 2) OVER (PARTITION BY conv_id, turn ORDER BY i) AS used FROM w, unnest(range(1, len(w) + 1)) AS u(i)),
c AS (SELECT conv_id, turn, max(i) AS cut FROM e WHERE used + 10 <= 60 GROUP BY ALL)
SELECT conv_id, turn, w[1:coalesce(cut, 0)] AS hints FROM w LEFT JOIN c USING (conv_id, turn)""")
def budget_trim(spark, sf_dir):
    """W13"""
    w = words_ws(text.nonnull(F.col("text")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", windows.trim_to_budget(w, lambda h: F.length(h) + 2, F.lit(10), 60).alias("hints"))


@query()
def line_packing(spark, sf_dir):
    """W18"""
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", windows.pack_lines(text.nonnull(F.col("text"))).alias("p")).select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "\x01")).alias("digest"))


@query("SELECT doc_id, source, rn <= greatest(1, floor(n * 0.1 + 0.5)) AS held_out FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents)")
def hash_split(spark, sf_dir):
    """A tenth of each source held out by hash."""
    return windows.split(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", ["source"], 0.1, seed=7)


@query()
def hash_sample(spark, sf_dir):
    """A hundred documents by the smallest hash."""
    return windows.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


@query("SELECT doc_id, clip FROM (SELECT doc_id, CASE WHEN length(text) > 40 THEN rtrim(left(text, 37)) || '...' ELSE text END AS clip FROM documents)")
def text_clip(spark, sf_dir):
    """N47"""
    return table(spark, sf_dir, "documents").select("doc_id", text.clip(F.col("text"), 40).alias("clip"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(c, '[!?]+$') THEN replace(replace(regexp_replace(c, '[!?]+$', '.'), '!', ''), '?', '') ELSE replace(replace(c, '!', ''), '?', '') END AS clean FROM (SELECT conv_id, turn, trim(replace(replace(coalesce(text, ''), chr(92), ''), '\"', '')) AS c FROM conversations)")
def nested_clean(spark, sf_dir):
    """N40"""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_segment(F.col("text")).alias("clean"))


@query()
def name_uuid(spark, sf_dir):
    """N49"""
    return table(spark, sf_dir, "documents").select("doc_id", text.uuid5_url(F.concat(F.lit("doc|"), F.col("doc_id").cast("string"))).alias("uuid"))


@query("SELECT doc_id, ceil(octet_length(encode(text)) / 3.0)::BIGINT AS tokens, CASE lang WHEN 'en' THEN 0.15 WHEN 'de' THEN 0.25 ELSE 0.4 END * ceil(octet_length(encode(text)) / 3.0) / 1e6 AS usd FROM documents")
def token_cost(spark, sf_dir):
    """A23"""
    tokens = aggregates.token_estimate(F.col("text"))
    price = F.when(F.col("lang") == "en", 0.15).when(F.col("lang") == "de", 0.25).otherwise(0.4)
    return table(spark, sf_dir, "documents").select("doc_id", tokens.alias("tokens"), (price * tokens / 1e6).alias("usd"))


@query("SELECT lang, count(*) AS n, sum(t)::BIGINT AS tokens_in, (count(*) * 200)::BIGINT AS tokens_out, avg(t) AS mean_in, round(sum(usd), 6) AS usd, round(avg(usd) * 1000, 6) AS usd_pending FROM (SELECT lang, ceil(octet_length(encode(text)) / 3.0) AS t, (ceil(octet_length(encode(text)) / 3.0) * 0.15 + 200 * 0.6) / 1e6 AS usd FROM documents) GROUP BY lang")
def cost_rollup(spark, sf_dir):
    """A22"""
    d = table(spark, sf_dir, "documents").select("lang", aggregates.token_estimate(F.col("text")).alias("t"), F.lit(200).cast("long").alias("out"))
    d = d.withColumn("usd", aggregates.cost(F.col("t"), F.col("out"), F.lit(0), F.lit(0.15), F.lit(0.6), F.lit(None).cast("double")))
    out = aggregates.usage_rollup(d, ["lang"], "t", "out", "usd", 1000)
    return out.withColumns({"usd": F.round("usd", 6), "usd_pending": F.round("usd_pending", 6)})


@query("SELECT count(*) AS n, 100.0 * count(*) FILTER (n = 0) / count(*) AS empty_percent, avg(n) AS mean, quantile_cont(n, 0.5) AS median, min(n) AS min, max(n) AS max FROM (SELECT length(coalesce(text, '')) AS n FROM documents)")
def result_profile(spark, sf_dir):
    """A24"""
    out = aggregates.result_profile(table(spark, sf_dir, "documents"), "text")
    return out.withColumns({"min": F.col("min").cast("long"), "max": F.col("max").cast("long")})


@query("SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, '{\"event\":\"' || event_type || '\",\"value\":' || json_extract(props, '$.k') || '}' AS line FROM events")
def json_extract(spark, sf_dir):
    """A field out of an object, and an object a line."""
    parsed = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", parsed["k"].alias("k"), F.to_json(F.struct(F.col("event_type").alias("event"), parsed["k"].alias("value"))).alias("line"))
