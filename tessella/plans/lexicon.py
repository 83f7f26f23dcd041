"""Queries on lookups, phrases, entities and swaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.functions.regex import words_ws
from tessella.functions.rules import STOPWORDS
from tessella.operators import aggregates, augment, entities, filters, joins, mentions, sets
from tessella.plans.registry import query, table
from tessella.session import settle


@query("SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lexicon_left_join(spark, sf_dir):
    """J1"""
    out = joins.lookup(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"), "n_regionkey", "r_regionkey")
    return out.select("n_nationkey", "n_name", "r_name")


@query("""
SELECT p_brand, string_agg(p_type, ' | ' ORDER BY first) AS types
FROM (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY p_brand, p_type) GROUP BY p_brand""")
def ordered_string_agg(spark, sf_dir):
    """A1: a brand's types in order of first sight."""
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(aggregates.join_unique("p_type", "p_partkey", " | ").alias("types"))


def _order_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as texts whose k-th word is k + orderkey mod 3, and line items as marks of what stands where."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (i + F.col("o_orderkey") % 3).cast("string")), " ").alias("words"))
    marks = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("string").alias("position"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("string").alias("spelling"), F.col("l_shipdate").cast("string").alias("value"))
    return orders, marks


_MARKS_SQL = """
WITH m AS (SELECT l_orderkey, l_linenumber AS position, l_linenumber + l_partkey % 3 AS spelling, coalesce(l_linenumber <= 5 AND l_linenumber + l_orderkey % 3 = l_linenumber + l_partkey % 3, false) AS good FROM lineitem)
"""


@query(_MARKS_SQL + "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM m WHERE NOT good)")
def alignment_antijoin(spark, sf_dir):
    """J2"""
    orders, marks = _order_words(spark, sf_dir)
    return joins.aligned(orders, marks, "o_orderkey", "l_orderkey", F.split("words", " "), "position", "spelling").select("o_orderkey")


@query(_MARKS_SQL + "SELECT l_orderkey, CASE WHEN good THEN 'Yes' ELSE 'No' END AS match, count(*) AS n FROM m GROUP BY ALL")
def mark_verdicts(spark, sf_dir):
    """J3"""
    orders, marks = _order_words(spark, sf_dir)
    told = joins.marks_with_verdict(orders, marks, "o_orderkey", "l_orderkey", F.split("words", " "), "position", "spelling", "value")
    return told.groupBy("l_orderkey", "match").agg(F.count("*").alias("n"))


@query(_MARKS_SQL + "SELECT count(DISTINCT l_orderkey) AS n_keys FROM m WHERE NOT good")
def any_mismatch_count(spark, sf_dir):
    """J4"""
    orders, marks = _order_words(spark, sf_dir)
    told = joins.marks_with_verdict(orders, marks, "o_orderkey", "l_orderkey", F.split("words", " "), "position", "spelling", "value")
    return joins.any_mismatch(told, "l_orderkey")


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents", heavy=True).select("doc_id", "source", words_ws(F.lower(text.nonnull(F.col("text")))).alias("w"))


def _phrases(spark, sf_dir):
    """Each three words in a row of each benchmark item, once; items of one or two words as they are."""
    items = table(spark, sf_dir, "benchmark").select("item_id", words_ws(F.lower(text.nonnull(F.col("text")))).alias("w"))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.slice("w", i, 3))
    return items.select("item_id", F.explode(F.array_distinct(grams)).alias("p")).filter(F.size("p") > 0)


_PHRASE_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, w[i:i + 2] AS p FROM b, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0),
spots AS (SELECT doc_id, i - 1 AS pos, w[i:i + n - 1] AS g FROM d, unnest(range(1, len(w) + 1)) AS u(i), unnest([1, 2, 3]) AS v(n) WHERE i + n - 1 <= len(w)),
found AS (SELECT doc_id, pos, item_id, len(p) AS n FROM spots JOIN p ON g = p)
"""


@query(_PHRASE_SQL + "SELECT doc_id, pos, item_id FROM found")
def phrase_positions(spark, sf_dir):
    """J5"""

    def build() -> DataFrame:
        out = joins.phrase_matches(_words(spark, sf_dir), _phrases(spark, sf_dir), "doc_id", F.col("w"), "item_id", F.col("p"))
        return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "item_id")

    return settle(spark, build, "phrase-positions")


@query(_PHRASE_SQL + "SELECT DISTINCT doc_id, item_id FROM found")
def phrase_contains(spark, sf_dir):
    """J6"""
    return settle(spark, lambda: joins.phrase_contains(_words(spark, sf_dir), _phrases(spark, sf_dir), "doc_id", F.col("w"), "item_id", F.col("p")), "phrase-contains")


@query("SELECT r_regionkey, r_name, coalesce(string_agg(n_name, '; ' ORDER BY n_nationkey), '') AS nations FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY ALL")
def lookup_list(spark, sf_dir):
    """J7"""
    return joins.lookup_list(table(spark, sf_dir, "region"), table(spark, sf_dir, "nation"), "r_regionkey", "n_regionkey", "n_name", "n_nationkey", name="nations").select("r_regionkey", "r_name", "nations")


@query(_PHRASE_SQL + "SELECT doc_id, item_id, rank FROM (SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY max(n) DESC, min(pos), item_id) AS rank FROM found GROUP BY doc_id, item_id) WHERE rank <= 12")
def ngram_join(spark, sf_dir):
    """J8"""

    def build() -> DataFrame:
        out = joins.ngram_join(_words(spark, sf_dir), _phrases(spark, sf_dir), "doc_id", F.col("w"), "item_id", F.array_join("p", joins.SEP), longest=3)
        return out.select("doc_id", "item_id", F.col("rank").cast("long").alias("rank"))

    return settle(spark, build, "ngram-join")


@query("""
WITH c AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM conversations),
t AS (SELECT conv_id, turn, i - 1 AS pos, w[i] AS token FROM c, unnest(range(1, len(w) + 1)) AS u(i)),
l AS (SELECT DISTINCT item_id, length(text) AS size, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '')) AS token FROM benchmark)
SELECT conv_id, turn, pos, item_id AS entry FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY size, item_id) AS k FROM t JOIN l USING (token)) WHERE k <= 3""")
def token_candidates(spark, sf_dir):
    """Every word of every turn looked up in the items that hold it, the first three by length."""
    words = words_ws(F.lower(text.nonnull(F.col("text"))))
    tokens = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(words).alias("pos", "token"))
    lex = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), F.length("text").alias("size"), F.explode(F.array_distinct(words)).alias("token"))
    out = joins.token_candidates(tokens, lex, "token", ["conv_id", "turn", "pos"], ["size", "entry"])
    return out.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "entry")


@query()
def greedy_hints(spark, sf_dir):
    """Longest phrases of one to four words from anywhere in the benchmark's items."""
    words = words_ws(F.lower(text.nonnull(F.col("text"))))
    run = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), joins.SEP))).otherwise(F.array().cast("array<string>"))
    lex = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w"))
    lex = lex.select(F.explode(F.concat(*map(run, range(1, 5)))).alias("form"), F.col("item_id").cast("string").alias("hint")).groupBy("form").agg(F.min("hint").alias("hint"))
    turns = table(spark, sf_dir, "conversations").withColumn("k", F.concat_ws(":", "conv_id", "turn"))
    out = settle(spark, lambda: joins.hints(turns, lex, "k", words, "form", "hint"), "hints")
    return out.select("conv_id", "turn", F.size("hints").cast("long").alias("n"), F.to_json("hints").alias("hints"))


@query("""
WITH s AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority))) AS s FROM orders GROUP BY o_custkey)
SELECT o_custkey, len(s) AS n FROM s a WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT s AS b FROM s) x WHERE len(x.b) > len(a.s) AND len(list_intersect(x.b, a.s)) = len(a.s))""")
def subset_dominance(spark, sf_dir):
    """Customers whose set of priorities is no strict subset of another's; equal sets are compared once."""
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("s"))
    kinds = own.select("s").distinct().withColumn("k", F.array_join("s", "|"))
    kept = joins.drop_dominated(kinds, "k", "s").select("s")
    return own.join(kept, "s", "left_semi").select("o_custkey", F.size("s").cast("long").alias("n"))


@query("SELECT user_id, event_type, greatest(coalesce(a, 0), coalesce(b, 0)) AS n FROM (SELECT user_id, event_type, count(*) AS a FROM events WHERE value > 50 GROUP BY ALL) FULL JOIN (SELECT user_id, event_type, count(*) AS b FROM events WHERE value <= 50 GROUP BY ALL) USING (user_id, event_type)")
def double_index(spark, sf_dir):
    """The larger of two counts."""
    e = table(spark, sf_dir, "events").withColumn("hi", F.when(F.col("value") > 50, F.col("event_type"))).withColumn("lo", F.when(F.col("value") <= 50, F.col("event_type")))
    kinds = e.select("event_type").distinct()
    return joins.double_index(e.drop("event_type"), kinds.withColumn("hi", F.col("event_type")), kinds.withColumn("lo", F.col("event_type")), ["user_id"], "hi", "lo", "event_type")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1 AND min(o_orderstatus) = 'F')")
def unambiguous_forms(spark, sf_dir):
    """J16"""
    return joins.unambiguous(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "F").select("o_orderkey")


@query("SELECT doc_id, quality AS value FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def precedence_union(spark, sf_dir):
    """J17"""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(-1).alias("value"))
    return joins.precedence_union(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value")), docs, "doc_id")


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def first_match(spark, sf_dir):
    """J18"""
    return joins.first_by(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])


@query("SELECT o_orderkey AS id, o_orderstatus AS reference, o_orderpriority AS hypothesis FROM orders")
def align_by_id(spark, sf_dir):
    """J19"""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "id")
    return joins.align_by_id(o.select("id", F.col("o_orderstatus").alias("v")), o.select("id", F.col("o_orderpriority").alias("v")), "id", "v")


_POOLS_SQL = "WITH c AS (SELECT conv_id, 0 AS pool, turn AS pos, coalesce(text, '') AS text FROM conversations UNION ALL SELECT conv_id, 1, turn, lower(coalesce(text, '')) FROM conversations) "


def _pools(spark, sf_dir):
    """Two pools of candidates for each conversation: its turns, and its turns in small letters."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), text.nonnull(F.col("text")).alias("text"))
    return joins.concat_pools(c, c.withColumn("text", F.lower("text")))


@query(_POOLS_SQL + "SELECT conv_id, pool, pos, md5(text) AS digest FROM c")
def pooled_candidates(spark, sf_dir):
    """J20"""
    return _pools(spark, sf_dir).select("conv_id", "pool", "pos", F.md5("text").alias("digest"))


@query(_POOLS_SQL + "SELECT a.conv_id, a.pos AS a_pos, a.pool AS a_pool, count(*) AS n, sum((a.text = b.text)::INT)::BIGINT AS same FROM c a JOIN c b ON a.conv_id = b.conv_id AND (a.pos, a.pool) <> (b.pos, b.pool) GROUP BY ALL")
def candidate_pairs(spark, sf_dir):
    """Ordered pairs of a conversation's candidates, of which there are as many as its turns."""
    pools = _pools(spark, sf_dir).withColumn("place", F.struct("pos", "pool"))
    pairs = joins.candidate_pairs(pools, "conv_id", "place", ["text"])
    return pairs.groupBy("conv_id", F.col("a_place.pos").alias("a_pos"), F.col("a_place.pool").alias("a_pool")).agg(F.count("*").alias("n"), F.sum((F.col("a_text") == F.col("b_text")).cast("long")).alias("same"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_rows(spark, sf_dir):
    """J22"""
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT field, key, n, min(ord) AS ord FROM (SELECT p_partkey AS ord, 'p_name' AS field, replace(lower(p_name), ' ', chr(1)) AS key, len(string_split(p_name, ' ')) AS n FROM part UNION ALL SELECT p_partkey, 'p_type', replace(lower(p_type), ' ', chr(1)), len(string_split(p_type, ' ')) FROM part) WHERE n <= 4 GROUP BY ALL")
def lexicon_index(spark, sf_dir):
    """Two fields of a lexicon as phrases of up to four tokens, the first row of each."""
    out = joins.lexicon_index(table(spark, sf_dir, "part"), ["p_name", "p_type"], F.lower, "p_partkey")
    return out.groupBy("field", "key", "n").agg(F.min("ord").alias("ord")).withColumn("n", F.col("n").cast("long"))


@query("""
WITH g AS (SELECT lang, list(source ORDER BY source) AS o FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang),
d AS (SELECT doc_id, list_filter(o, lambda x: x <> d.source) AS o, md5(CAST(doc_id AS VARCHAR) || '|' || d.source) AS h FROM documents d JOIN g USING (lang)),
m AS (SELECT doc_id, o, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(h, ''), lambda c: instr('0123456789abcdef', c) - 1)), lambda a, x: (a * 16 + x) % len(o)) AS i FROM d WHERE len(o) > 0)
SELECT doc_id, o[i + 1] AS replacement FROM m""")
def hash_choice_swap(spark, sf_dir):
    """Another source of the language, chosen by md5."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    seed = F.concat_ws("|", F.col("doc_id").cast("string"), "source")
    out = joins.pick_replacement(d, d, "lang", "source", "source", seed)
    return out.filter("replacement is not null").select("doc_id", "replacement")


_STOP = "[" + ",".join(f"'{x}'" for x in STOPWORDS) + "]"
_COOC_SQL = """
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[A-Za-z]+(?:[-''][A-Za-z]+)?'), lambda x: NOT list_contains(%s, x)) AS w FROM documents),
t AS (SELECT doc_id, 'word' AS kind, unnest(w) AS term FROM d UNION ALL SELECT doc_id, 'bigram', w[i] || ' ' || w[i + 1] FROM d, unnest(range(1, len(w))) AS u(i))
""" % _STOP


@query(_COOC_SQL + "SELECT kind, term, n, \"rows\" FROM (SELECT kind, term, count(*) AS n, count(DISTINCT doc_id) AS \"rows\", row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, term) AS k FROM t GROUP BY kind, term HAVING count(*) >= 2) WHERE k <= 50")
def cooccurrence_topk(spark, sf_dir):
    """The fifty commonest words and pairs."""
    docs = table(spark, sf_dir, "documents", heavy=True)
    return settle(spark, lambda: aggregates.top_cooccurrence(docs, "doc_id", filters.content_words(F.col("text")), 50, least=2), "cooccurrence-topk")


@query("""
WITH d AS (SELECT conv_id || ':' || turn AS key, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM conversations),
t AS (SELECT key, unnest(w) AS token FROM d)
SELECT token, count(DISTINCT key) AS n_rows, count(*) AS n_occurrences, list_sort(list_distinct(list(key)))[1:3] AS examples FROM t GROUP BY token HAVING count(DISTINCT key) >= 20""")
def token_dictionary(spark, sf_dir):
    """A14, F7"""
    w = words_ws(F.lower(text.nonnull(F.col("text"))))
    turns = table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return aggregates.token_dictionary(turns, "key", w, None, min_rows=20)


@query()
def token_translations(spark, sf_dir):
    """With the commonest words of the next turn."""
    from tessella.plans.corpus import pairs

    p = pairs(spark, sf_dir).withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return settle(spark, lambda: aggregates.token_dictionary(p, "key", words_ws(F.lower("source")), filters.content_words(F.col("target")), min_rows=20), "token-translations")


@query("SELECT doc_id, count(*) AS n, list(i - 1 ORDER BY i) AS positions FROM (SELECT doc_id, i FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS w FROM documents), unnest(range(1, len(w))) AS u(i) WHERE w[i] = 'of' AND w[i + 1] = 'the') GROUP BY doc_id")
def phrase_summary(spark, sf_dir):
    """A13"""
    out = aggregates.phrase_summary(_words(spark, sf_dir), "doc_id", F.col("w"), ["of", "the"])
    return out.select("doc_id", "n", "positions")


@query("""
WITH d AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS t FROM documents),
s AS (SELECT doc_id, i, array_to_string(t[greatest(i - 3, 1):i + 4], ' ') AS context FROM d, unnest(range(1, len(t))) AS u(i) WHERE t[i] = 'of' AND t[i + 1] = 'the'),
f AS (SELECT doc_id, trim(coalesce(lang, '')) AS x, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[A-Za-z]+(?:[-''][A-Za-z]+)?'), lambda x: NOT list_contains(%s, x)) AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM s)),
e AS (
  SELECT 'word' AS kind, doc_id, i, w[i] AS item FROM f, unnest(range(1, len(w) + 1)) AS u(i)
  UNION ALL SELECT 'bigram', doc_id, i, w[i] || ' ' || w[i + 1] FROM f, unnest(range(1, len(w))) AS u(i)
  UNION ALL SELECT 'translation', doc_id, 1, x FROM f
),
c AS (SELECT kind, item, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, min((doc_id, i))) AS rank FROM e GROUP BY kind, item HAVING count(*) >= 2)
SELECT 'rows' AS kind, 1 AS rank, NULL AS item, NULL AS context, count(DISTINCT doc_id) AS n FROM s
UNION ALL SELECT 'occurrences', 1, NULL, NULL, count(*) FROM s
UNION ALL SELECT kind, rank, item, NULL, n FROM c WHERE rank <= 10
UNION ALL SELECT 'example', row_number() OVER (ORDER BY doc_id, i), doc_id || chr(9) || x, context, 1 FROM (SELECT * FROM s ORDER BY doc_id, i LIMIT 5) JOIN f USING (doc_id)""" % _STOP)
def phrase_report(spark, sf_dir):
    """The whole report on a phrase; a document's own content words and its language stand for its translation."""
    docs = table(spark, sf_dir, "documents", heavy=True)
    words = words_ws(F.lower(text.nonnull(F.col("text"))))
    report = lambda: aggregates.phrase_report(docs, "doc_id", "doc_id", words, "lang", filters.content_words(text.nonnull(F.col("text"))), ["of", "the"])
    return settle(spark, report, "phrase-report")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def rows_without(spark, sf_dir):
    """Documents without those labelled toxic."""
    return sets.without(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").filter("toxic = 1"), "doc_id")


@query("SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS types FROM orders GROUP BY o_custkey")
def type_sets(spark, sf_dir):
    """A18"""
    return aggregates.type_sets(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus")


@query("""
WITH c AS (SELECT l_suppkey, l_linenumber AS line, count(*) AS n FROM lineitem WHERE l_quantity >= 49 GROUP BY ALL),
r AS (SELECT l_suppkey, count(*) AS k, string_agg(CAST(line AS VARCHAR), ' / ' ORDER BY n DESC, line) AS choices, max(n) AS best_n FROM c GROUP BY l_suppkey)
SELECT l_suppkey, choices, best_n FROM r WHERE k <= 5""")
def gloss_vote(spark, sf_dir):
    """A20"""
    votes = table(spark, sf_dir, "lineitem").withColumn("confidence", F.when(F.col("l_quantity") < 49, "low").otherwise("high"))
    return aggregates.vote(votes, "l_suppkey", "l_linenumber", "confidence", max_variants=5)


@query("SELECT p_partkey, p_name, exact FROM (SELECT p_partkey, p_name, lower(p_name) = 'lavender 3' OR lower(p_type) = 'small' AS exact, p_type FROM part WHERE contains(lower(p_name), 'small') OR contains(lower(p_type), 'small') ORDER BY exact DESC, p_type, p_partkey LIMIT 200)")
def search_exact_then_partial(spark, sf_dir):
    """T3"""
    return sets.search(table(spark, sf_dir, "part"), " SMALL ", ["p_name", "p_type"], ["p_type", "p_partkey"]).select("p_partkey", "p_name", "exact")


@query("SELECT * FROM (SELECT doc_id, n_chars, 'largest' AS side FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10) UNION ALL SELECT * FROM (SELECT doc_id, n_chars, 'smallest' FROM documents ORDER BY n_chars, doc_id LIMIT 10)")
def length_extremes(spark, sf_dir):
    """T4"""
    return sets.extremes(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 10)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY coalesce(try_cast(l_returnflag AS INT), 0), l_shipdate, l_orderkey, l_linenumber) AS rank FROM lineitem")
def ordered_rank(spark, sf_dir):
    """A multi-key order over all rows, ranked without a single task."""
    from tessella.operators.windows import global_rank

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    return global_rank(li, [F.expr("coalesce(try_cast(l_returnflag AS int), 0)"), F.col("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_orderkey", "l_linenumber", "rank")


@query("SELECT doc_id, text AS note FROM documents UNION ALL SELECT vec_id, NULL FROM embeddings")
def union_reports(spark, sf_dir):
    """U1, U2"""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("note"))
    return sets.union_all(d, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")))


@query("SELECT lang, list_sort(list_distinct(list(source))) AS sources FROM documents GROUP BY lang")
def merged_sets(spark, sf_dir):
    """U3"""
    return sets.merged_sets(table(spark, sf_dir, "documents").select("lang", F.array("source").alias("sources")), "lang", ["sources"])


@query("SELECT a.o_custkey, len(list_intersect(a.s, b.s)) > 0 AS overlaps, len(list_intersect(a.s, b.s)) = len(a.s) AND len(a.s) < len(b.s) AS strict FROM (SELECT o_custkey, list_distinct(list(o_orderstatus)) AS s FROM orders GROUP BY ALL) a, (SELECT list_distinct(list(o_orderstatus)) AS s FROM orders) b")
def set_predicates(spark, sf_dir):
    """Each customer's states against all states."""
    o = table(spark, sf_dir, "orders")
    whole = o.agg(F.collect_set("o_orderstatus").alias("whole"))  # one row
    own = o.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s")).join(F.broadcast(whole), F.lit(True))
    whole = F.col("whole")
    return own.select("o_custkey", sets.intersects(F.col("s"), whole).alias("overlaps"), sets.strict_subset(F.col("s"), whole).alias("strict"))


@query("SELECT c_custkey AS key, c_nationkey AS shape FROM customer JOIN supplier ON c_custkey = s_suppkey AND c_nationkey = s_nationkey")
def common_keys(spark, sf_dir):
    """U8"""
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("shape"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("shape"))
    return sets.common_keys(a, b, "key", "shape")


@query("""
WITH w AS (SELECT doc_id, list_concat(string_split(text, ' '), ['The', 'of', 'OF']) AS w FROM documents),
e AS (SELECT doc_id, i, w[i] AS x FROM w, unnest(range(1, len(w) + 1)) AS u(i)),
f AS (SELECT doc_id, min(i) AS i, arg_min(x, i) AS x FROM e GROUP BY doc_id, lower(x))
SELECT doc_id, list(x ORDER BY i) AS merged FROM f GROUP BY doc_id""")
def merge_ci(spark, sf_dir):
    """U6"""
    return table(spark, sf_dir, "documents").select("doc_id", text.merge_ci(F.split("text", " "), F.array(F.lit("The"), F.lit("of"), F.lit("OF"))).alias("merged"))


@query()
def quoted_vocabulary(spark, sf_dir):
    """Written lists of a document's lines, and what its text has between quotes, as one list; held against Python's own reading in the tests."""
    source = F.replace(F.replace(text.nonnull(F.col("text")), F.lit(" the "), F.lit(' "Silver, tin (of a kind)!" ')), F.lit(" of "), F.lit(' "it\'s" '))
    lines = text.written_list(F.split(source, "\n"))
    made = table(spark, sf_dir, "documents", heavy=True).select("doc_id", text.with_quoted(lines, source).alias("made"))
    return made.select("doc_id", F.md5("made").alias("digest"), F.length("made").cast("long").alias("n"))


def _names(spark, sf_dir):
    """Names to look for, of any number of words: each benchmark item as a whole, its words but for single letters, its runs of two and of eight words.
    An item is an entry; the second half of them are an onomasticon's."""
    w = words_ws(text.nonnull(F.col("text")))
    runs = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entry"), w.alias("w"))
    every = items.select("entry", F.explode(F.array_distinct(F.concat(F.col("w"), runs(2), runs(8), F.array(F.array_join("w", " "))))).alias("name"))
    return every.filter(F.length("name") > 1).withColumn("loose", F.col("entry") % 2 == 1)


@query()
def name_mentions(spark, sf_dir):
    """J12, A15"""
    return entities.mention_frequency(table(spark, sf_dir, "documents", heavy=True), _names(spark, sf_dir), "doc_id", "text", "entry", "name")


@query()
def surface_mentions(spark, sf_dir):
    """A16"""
    return entities.surface_frequency(table(spark, sf_dir, "documents", heavy=True), _names(spark, sf_dir), "doc_id", "text", "entry", "name")


@query()
def missing_mentions(spark, sf_dir):
    """Mentions in a turn none of whose entry's names stands in the next turn, exactly or, for every second entry, but for accents."""
    from tessella.plans.corpus import pairs

    p = pairs(spark, sf_dir).withColumn("k", F.concat_ws(":", "conv_id", "turn"))
    names = _names(spark, sf_dir)
    found = mentions.mentions(p, names, "k", "source", "entry", "name")
    return mentions.missing_matches(found, p, names.withColumnRenamed("name", "spelling"), "k", "entry", "target", "spelling", "loose").select("k", "entry", "name")


@query()
def merged_entities(spark, sf_dir):
    """Parts merged in order where they share a name, by the first such part: their names are the words of their own name, and size with brand."""
    words = F.split("p_name", " ")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("display"), F.array_append(words, F.concat_ws(" ", "p_brand", "p_size")).alias("names"), F.array("p_brand").alias("spellings"), F.array(F.col("p_type")).alias("sources"))
    return entities.merge_entities(p, "p_partkey")


@query()
def name_swap(spark, sf_dir):
    """G1: words of benchmark items as names."""
    from tessella.plans.corpus import pairs

    p = pairs(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("oare_id"), F.col("source").alias("transliteration"), F.col("source").alias("translation"))
    w = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(words_ws(text.nonnull(F.col("text")))).alias("i", "form"))
    lex = w.select("form", F.col("form").alias("norm"), F.col("form").alias("lexeme"), F.when(F.col("item_id") % 2 == 0, "PN").otherwise("GN").alias("type"), F.struct("item_id", "i").alias("_ord"))
    return augment.swap_names(p, lex)


@query()
def segments_to_rows(spark, sf_dir):
    """Conversations as nested segments, then as numbered rows."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda s: F.struct(s["role"].alias("transliteration"), s["text"].alias("translation"))).alias("segments"))
    return augment.segment_rows(nested, "conv_id")


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def regrouped_parts(spark, sf_dir):
    """G4"""
    return augment.regroup(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
