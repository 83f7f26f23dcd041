"""Queries on sources, sinks, page layout, augmentation and choices."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.functions.regex import words_ws
from tessella.operators import aggregates, augment, entities, filters, joins, layout, scoring, windows
from tessella.plans.registry import query, table
from tessella.session import passing, settle
from tessella.sources import paged, readers, writers


# --- sources and sinks ------------------------------------------------------------------------------------
@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS \"_ord\", CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text FROM documents")
def csv_round_trip(spark, sf_dir):
    """Whole texts, line breaks and quotes in them, out to one file and back in order."""

    def build() -> DataFrame:
        path = passing(spark, "csv")
        writers.csv(table(spark, sf_dir, "documents").orderBy("doc_id").select("doc_id", "text"), path)
        return readers.csv(spark, path, ["doc_id", "text"])

    return settle(spark, build, "csv-back")


_MISSING = ("", "NA", "null", "None", "nan", "N/A", "#N/A", "-NaN", "na", " NA", "none")


@query(f"""
WITH c AS (SELECT conv_id || ':' || turn AS k, CASE WHEN turn % 2 = 0 THEN coalesce(text, '') ELSE [{', '.join(f"'{x}'" for x in _MISSING)}][(conv_id + turn) % {len(_MISSING)} + 1] END AS v FROM conversations)
SELECT k, md5(v) AS literal, CASE WHEN v IN ('', {', '.join(f"'{x}'" for x in ("NA", "null", "nan", "N/A", "None", "NULL", "NaN", "n/a", "<NA>", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN"))}) THEN NULL ELSE md5(v) END AS read FROM c""")
def csv_missing_values(spark, sf_dir):
    """Turns, every second one a spelling of a missing value or close to one, written and read literally and with missing values."""

    def build() -> DataFrame:
        path = passing(spark, "csv-na")
        odd = F.get(F.array(*map(F.lit, _MISSING)), ((F.col("conv_id") + F.col("turn")) % len(_MISSING)).cast("int"))
        rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), F.when(F.col("turn") % 2 == 0, text.nonnull(F.col("text"))).otherwise(odd).alias("v"))
        writers.csv(rows, path)
        plain = readers.csv(spark, path, ["k", "v"], order=False).select("k", F.md5("v").alias("literal"))
        return plain.join(readers.csv(spark, path, ["k", "v"], na="pandas", order=False).select("k", F.md5("v").alias("read")), "k")

    return settle(spark, build, "csv-na-back")


_PAIR = "SELECT conv_id, turn, trim(coalesce(text, '')) AS source, trim(coalesce(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')) AS target FROM conversations"


def _sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    nexts = F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("transliteration"), nexts.alias("translation"))


@query(f"SELECT conv_id, turn, source AS transliteration, target AS translation FROM ({_PAIR}) WHERE source <> '' AND target <> ''")
def train_rows(spark, sf_dir):
    """S3"""
    return readers.train(_sides(spark, sf_dir))


@query("SELECT doc_id AS id, trim(coalesce(text, '')) AS transliteration FROM documents")
def test_rows(spark, sf_dir):
    """S4"""
    return readers.test(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("transliteration")))


@query(f"SELECT conv_id || ':' || turn AS oare_id, source AS transliteration, target AS translation FROM ({_PAIR}) WHERE source <> ''")
def flexible_rows(spark, sf_dir):
    """S5"""
    return readers.flexible(_sides(spark, sf_dir).withColumn("id", F.concat_ws(":", "conv_id", "turn")))


@query("SELECT conv_id, turn, role, length(text) AS size FROM conversations")
def token_glosses(spark, sf_dir):
    """Nested rows out as objects a line, read back, and flattened."""

    def build() -> DataFrame:
        path = passing(spark, "glosses")
        nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.length("text").cast("long").alias("size"))).alias("token_glosses"))
        writers.json_lines(nested, path)
        back = readers.records(spark, path, "conv_id long, token_glosses array<struct<turn: long, role: string, size: long>>")
        return readers.glosses(back, "conv_id")

    return settle(spark, build, "glosses-back")


@query("SELECT doc_id, lang AS label, '' AS vec FROM documents UNION ALL SELECT vec_id, '', CAST(label AS VARCHAR) FROM embeddings")
def extended_rows(spark, sf_dir):
    """K2: rows of both tables, what one lacks is blank."""
    base = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("label"))
    return writers.extended(base, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("vec")))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def replaced_table(spark, sf_dir):
    """K4: a table replaced twice, the version that its pointer names."""

    def build() -> DataFrame:
        path, orders = passing(spark, "replaced"), table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
        writers.replace_atomically(orders.filter("o_orderkey < 0"), path)
        writers.replace_atomically(orders, path)
        return spark.read.parquet(writers.current(spark, path))

    return settle(spark, build, "replaced-back")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def appended_log(spark, sf_dir):
    """K5, K7: a log that grows by parts."""

    def build() -> DataFrame:
        path, events = passing(spark, "log"), table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
        for k in range(2):
            writers.append(events.filter(F.pmod(F.col("event_id"), F.lit(2)) == k), path)
        return spark.read.parquet(path).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))

    return settle(spark, build, "log-back")


@query("SELECT l_orderkey, l_linenumber, printf('%.3f', l_extendedprice) AS price, CASE WHEN l_discount = 0 THEN '' ELSE printf('%.2f', l_discount) END AS discount FROM lineitem")
def formatted_numbers(spark, sf_dir):
    """K8"""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", writers.formatted(F.col("l_extendedprice")).alias("price"), writers.formatted(F.nullif(F.col("l_discount"), F.lit(0.0)), 2).alias("discount"))


# --- pages --------------------------------------------------------------------------------------------------
#: Turns as printed lines: a page a conversation, words 25 wide in two columns, a row each 12 points with words up to 2 points lower.
_WORDS_SQL = """
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS w FROM conversations),
p AS (SELECT conv_id AS page, w[i] AS text, ((i - 1) % 18) * 25.0 AS x0, ((i - 1) % 18) * 25.0 + 20 AS x1, turn * 1000 + ((i - 1) // 18) * 12.0 + (i % 3) AS top, turn * 1000 + ((i - 1) // 18) * 12.0 + (i % 3) + 8 AS bottom FROM w, unnest(range(1, len(w) + 1)) AS u(i))
"""


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page"), "turn", F.posexplode(words_ws(text.nonnull(F.col("text")))).alias("i", "text"))
    x0 = (F.col("i") % 18) * 25.0
    top = F.col("turn") * 1000 + F.floor(F.col("i") / 18) * 12.0 + (F.col("i") + 1) % 3
    return w.select("page", "text", x0.alias("x0"), (x0 + 20).alias("x1"), top.cast("double").alias("top"), (top + 8).cast("double").alias("bottom"))


@query(_WORDS_SQL + "SELECT page, text, x0, top FROM p WHERE top BETWEEN 500 AND 20000")
def words_on_pages(spark, sf_dir):
    """A table of words, those between two heights."""
    return readers.words(_printed(spark, sf_dir), 500, 20000).select("page", "text", "x0", "top")


@query(
    _WORDS_SQL
    + """, r AS (SELECT *, floor(top / 12 + 0.0) AS k, top - (top - floor(top / 1000) * 1000) % 12 AS base FROM p),
g AS (SELECT page, base, min(top) AS top, max(bottom) AS bottom, coalesce(string_agg(text, ' ' ORDER BY x0, top) FILTER (x0 < 230), '') AS left_text, coalesce(string_agg(text, ' ' ORDER BY x0, top) FILTER (x0 >= 230 AND x0 < 290), '') AS marker_text, coalesce(string_agg(text, ' ' ORDER BY x0, top) FILTER (x0 >= 290), '') AS right_text, max(x1) FILTER (x0 < 230) AS left_x1, min(x0) FILTER (x0 >= 290) AS right_x0 FROM r GROUP BY page, base)
SELECT page, top, bottom, left_text, marker_text, right_text, left_x1, right_x0 FROM g"""
)
def printed_rows(spark, sf_dir):
    """W14, W15"""
    return layout.cluster_rows(_printed(spark, sf_dir)).select("page", "top", "bottom", "left_text", "marker_text", "right_text", "left_x1", "right_x0")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as rows of a table in two columns: a user's left, an assistant's right, system turns as titles; ten rows a page."""
    t = text.nonnull(F.col("text"))
    role = lambda r, x: F.when(F.col("role") == r, x).otherwise("")
    return table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") % 20).cast("string").alias("doc"), F.col("conv_id").alias("page"), (F.col("turn") * 10.0).alias("top"),
        F.when(F.col("role") == "system", F.concat(F.lit("kt "), t)).otherwise(role("user", F.concat(F.lit("a-na "), t))).alias("left_text"), F.lit("").alias("marker_text"), role("assistant", t).alias("right_text"),
    )


@query()
def table_mode(spark, sf_dir):
    """Held against a row by row state machine in the tests."""
    return layout.table_rows(_ledger(spark, sf_dir), 2, 1).select("doc", "page", "top", F.md5("doc_label").alias("label"))


@query()
def page_segments(spark, sf_dir):
    """As table_mode."""
    out = layout.segments(_ledger(spark, sf_dir))
    return out.select("doc", "segment_index", "page_start", "page_end", "y_top", "y_bottom", F.md5("source").alias("source"), F.md5("target").alias("target"), "n_rows")


@query(_WORDS_SQL + ", t AS (SELECT page, string_agg(text, ' ' ORDER BY top, text) AS title FROM p WHERE top <= 90 GROUP BY page) SELECT page, count(*) AS n, any_value(CASE WHEN regexp_matches(title, '[A-Z]') THEN title END) AS title FROM p LEFT JOIN t USING (page) GROUP BY page")
def page_titles(spark, sf_dir):
    """The words at the top of a page on all its rows, if there is a capital among them."""
    out = aggregates.page_titles(_printed(spark, sf_dir), "page", "top", "text", pattern="[A-Z]")
    return out.groupBy("page").agg(F.count("*").alias("n"), F.min("title").alias("title"))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id BETWEEN 3 AND 40")
def page_range(spark, sf_dir):
    """S11"""
    return readers.page_range(table(spark, sf_dir, "conversations").select("conv_id", "turn"), 3, 40, column="conv_id")


@query("SELECT conv_id, turn, text FROM conversations WHERE conv_id = 7")
def one_page(spark, sf_dir):
    """F11, F15"""
    return filters.page(filters.require_columns(table(spark, sf_dir, "conversations"), "conv_id", "turn"), 7, "conv_id").select("conv_id", "turn", "text")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (1, 5, 8, 100000000) UNION ALL SELECT * FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 7)")
def picked_rows(spark, sf_dir):
    """Rows by id from a table kept for reuse, and the first ones in order."""
    d = readers.cached(table(spark, sf_dir, "documents").select("doc_id", "lang"))
    return filters.pick_rows(d, [1, 5, 8, 100000000], id_col="doc_id").unionAll(filters.pick_rows(d, first=7, order="doc_id"))


@query("SELECT conv_id, n FROM (SELECT conv_id, count(*) FILTER (rtrim(text) LIKE '%.') AS n FROM conversations GROUP BY conv_id) WHERE n > 0")
def finished_segments(spark, sf_dir):
    """F5"""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.col("text").alias("translation"))).alias("segments"))
    return filters.keep_terminal_segments(nested).select("conv_id", F.size("segments").cast("long").alias("n"))


@query("SELECT row_number() OVER (ORDER BY p, new, o) AS n, p, o FROM (SELECT conv_id AS p, 0 AS new, turn AS o FROM conversations WHERE conv_id <> 4 UNION ALL SELECT 4, 1, n_nationkey FROM nation)")
def spliced_page(spark, sf_dir):
    """The rows of a page replaced, all numbered anew."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("p"), F.col("turn").alias("o"))
    new = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("o"))
    return windows.splice(c, new, "p", 4, "o").select("n", "p", "o")


# --- names and items ------------------------------------------------------------------------------------------
_NAMES_SQL = """
WITH l AS (SELECT c_custkey AS ord, CASE c_nationkey % 3 WHEN 0 THEN 'PN' WHEN 1 THEN 'GN' ELSE 'word' END AS type, lower(regexp_replace(c_name, '#0*', ' ')) AS form, 'Name ' || (c_custkey % 97) AS lexeme FROM customer),
s AS (SELECT s_suppkey AS ord, i, lower(trim(regexp_replace(x, '#0*', ' '))) AS form, 'Sup ' || s_suppkey AS name FROM supplier, unnest([1, 2]) AS u(i), LATERAL (SELECT CASE i WHEN 1 THEN s_name ELSE 'Customer ' || (s_suppkey * 3) END AS x))
"""


def _lexicon(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as a lexicon, suppliers as names with two spellings each."""
    kind = F.when(F.col("c_nationkey") % 3 == 0, "PN").when(F.col("c_nationkey") % 3 == 1, "GN").otherwise("word")
    lex = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_ord"), kind.alias("type"), F.regexp_replace("c_name", "#0*", " ").alias("form"), F.concat(F.lit("Name "), F.col("c_custkey") % 97).alias("lexeme"), F.lit("").alias("norm"))
    spelled = F.concat(F.regexp_replace("s_name", "#0*", " "), F.lit("; Customer "), (F.col("s_suppkey") * 3).cast("string"))
    return lex, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("_ord"), spelled.alias("spellings"), F.concat(F.lit("Sup "), F.col("s_suppkey")).alias("name"))


@query(_NAMES_SQL + """, r AS (SELECT 0 AS f, ord, 0 AS i, form, type AS kind, lexeme AS hint FROM l WHERE type IN ('PN', 'GN') UNION ALL SELECT 1, ord, i, form, 'ONOMASTICON', name FROM s)
SELECT replace(form, ' ', chr(1)) AS form, row_number() OVER (PARTITION BY form ORDER BY f, ord, i) AS place, kind, hint FROM r""")
def entity_index(spark, sf_dir):
    """J24"""
    lex, more = _lexicon(spark, sf_dir)
    return joins.entity_index(lex, more, F.lower, lambda c: F.trim(c))


@query(_NAMES_SQL + """, t AS (SELECT form, list_sort(list_distinct(list(type))) AS types FROM l GROUP BY form),
r AS (SELECT 0 AS f, ord, 0 AS i, form, type AS kind, lexeme AS name FROM l WHERE type IN ('PN', 'GN') UNION ALL SELECT 1, ord, i, form, 'PN', name FROM s),
k AS (SELECT r.*, row_number() OVER (PARTITION BY r.form ORDER BY f, ord, i) AS n FROM r LEFT JOIN t USING (form) WHERE types IS NULL OR types = [kind])
SELECT replace(form, ' ', chr(1)) AS form, name, kind FROM k WHERE n = 1""")
def proper_names(spark, sf_dir):
    """J26"""
    lex, more = _lexicon(spark, sf_dir)
    return joins.proper_names(lex, more, F.lower)


def _aliased(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(words_ws(text.nonnull(F.col("text")))).alias("form"))
    lex = w.groupBy("form").agg(F.min("item_id").alias("i")).select("form", F.upper("form").alias("name"), F.when(F.col("i") % 2 == 0, "PN").otherwise("GN").alias("kind"))
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    pools = {"PN": [(f"Anna{c}", f"Anne{c}") for c in "abcd"], "GN": [(f"Ur{c}", f"Uru{c}") for c in "abcd"]}
    return joins.alias_names(docs, "k", "text", lex, "form", "name", "kind", pools)


@query()
def aliased_names(spark, sf_dir):
    """Names of the benchmark aliased in turns; held against its rules in the tests."""
    return _aliased(spark, sf_dir).select("k", F.md5("aliased").alias("aliased"), F.to_json("pairs").alias("pairs"))


@query()
def restored_names(spark, sf_dir):
    """In the aliased turns, aliases back to names, the longest first."""
    return joins.restore_names(_aliased(spark, sf_dir)).select("k", F.md5("restored").alias("restored"), F.size("pairs").cast("long").alias("n_pairs"))


@query()
def item_swap(spark, sf_dir):
    """Items of a group for one another on both sides."""
    lex = spark.createDataFrame([("kaspum", "kaspum", "word", "silver", 1), ("KÙ.GI", "KÙ.GI", "word", "x", 2), ("annukum", "annukum", "word", "tin", 3), ("kutānum", "ku-ta-nu", "word", "textile", 4), ("nahlaptum", None, "word", "garment", 5)], "form string, form_original string, type string, gloss string, _ord long")
    c = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("oare_id"), text.nonnull(F.col("text")).alias("t"))
    pairs = c.select("oare_id", F.replace(F.replace("t", F.lit(" the "), F.lit(" kaspum ")), F.lit(" of "), F.lit(" ku-ta-nu ")).alias("transliteration"), F.replace(F.replace("t", F.lit(" the "), F.lit(" silver ")), F.lit(" of "), F.lit(" textiles ")).alias("translation"))
    return augment.swap_items(pairs, lex, F.col("gloss")).select("oare_id", F.md5("transliteration").alias("transliteration"), F.md5("translation").alias("translation"), "replaced_source_form", "replacement_form", "replaced_source_name", "replacement_name")


@query("SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, trim(role) AS source, trim(coalesce(text, '')) AS target FROM conversations WHERE turn % 3 <> 1")
def rows_of_lists(spark, sf_dir):
    """G5"""
    item = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(item.alias("x"))
    lists = lists.select(F.transform("x", lambda s: F.concat(F.col("conv_id").cast("string"), F.lit("-"), s["turn"])).alias("ids"), F.col("x.role").alias("sources"), F.col("x.text").alias("targets"), F.transform("x", lambda s: s["turn"] % 3 == 1).alias("deleted"))
    return augment.rows_of_lists(lists, "ids", "sources", "targets", "deleted").select("id", "source", "target")


@query()
def folded_names(spark, sf_dir):
    """The match key and the folded form of each part's name."""
    marked = F.replace("p_name", F.lit("a"), F.lit("ā"))
    return table(spark, sf_dir, "part").select("p_partkey", text.match_key(marked).alias("key"), entities.folded(marked).alias("folded"))


@query("SELECT p_partkey, p_name, list(i - 1 ORDER BY i) AS starts FROM (SELECT p_partkey, p_name, lower(p_name) AS l, lower(string_split(p_name, ' ')[1]) AS w FROM part) , unnest(range(1, 60)) AS u(i) WHERE i + length(w) - 1 <= length(l) AND substr(l, i, length(w)) = w GROUP BY ALL")
def folded_places(spark, sf_dir):
    """Where a part's first word stands in its name, whatever its accents."""
    accented = F.replace(F.upper("p_name"), F.lit("A"), F.lit("Á"))
    p = table(spark, sf_dir, "part").withColumns({"t": accented, "w": F.split("p_name", " ")[0]})
    return p.select("p_partkey", "p_name", F.transform(entities.find_folded("t", "w"), lambda x: x["start"].cast("long")).alias("starts"))


# --- choices ----------------------------------------------------------------------------------------------------
_CANDIDATES = "WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, ''))::DOUBLE AS n FROM conversations) "


@query(_CANDIDATES + ", m AS (SELECT *, quantile_cont(n, 0.5) OVER (PARTITION BY conv_id) AS med FROM c) SELECT conv_id, turn, round(100 * exp(-0.5 * pow((n - med) / greatest(0.4 * med, 5.0), 2)), 6) AS bonus FROM m")
def length_bonus(spark, sf_dir):
    """M6"""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length(text.nonnull(F.col("text"))).cast("double"))
    return c.select("conv_id", "turn", F.round(scoring.length_bonus(c, "conv_id", F.col("n")), 6).alias("bonus"))


@query(_CANDIDATES + "SELECT conv_id, turn, round(CASE WHEN max(n) OVER w > min(n) OVER w THEN 100 * (n - min(n) OVER w) / (max(n) OVER w - min(n) OVER w) ELSE 0 END, 6) AS bonus FROM c WINDOW w AS (PARTITION BY conv_id)")
def scaled_bonus(spark, sf_dir):
    """M7"""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.length(text.nonnull(F.col("text"))).cast("double"))
    return c.select("conv_id", "turn", F.round(scoring.scaled(F.col("n"), "conv_id"), 6).alias("bonus"))


@query()
def rewards(spark, sf_dir):
    """A turn's reward against the next one."""
    from tessella.plans.corpus import pairs

    return pairs(spark, sf_dir).select("conv_id", "turn", F.round(scoring.reward(scoring.sentence_bleu(F.col("source"), F.col("target")), scoring.sentence_chrf(F.col("source"), F.col("target"))), 6).alias("reward"))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY CASE WHEN p_type LIKE 'S%' THEN 0 ELSE 1 END, length(p_name), p_name, p_partkey) AS k FROM part) WHERE k <= 4")
def ranked_candidates(spark, sf_dir):
    """T5: by priority, then length, then name."""
    order = [F.when(F.startswith("p_type", F.lit("S")), 0).otherwise(1), F.length("p_name"), F.col("p_name"), F.col("p_partkey")]
    return aggregates.top_k(table(spark, sf_dir, "part"), ["p_brand"], order, 4).select("p_brand", "p_partkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k = 1")
def best_candidate(spark, sf_dir):
    """The first of the greatest."""
    return aggregates.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 1).select("o_custkey", "o_orderkey")


@query()
def kinds_of_text(spark, sf_dir):
    """what each turn's text looks like; cases worked by hand are in the tests."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", filters.source_like(t).alias("source"), filters.target_like(t).alias("target"), filters.title_like(t).alias("title"), filters.note_like(t).alias("note"), filters.marker_like(t).alias("marker"))


@query()
def guarded_candidates(spark, sf_dir):
    """each conversation's turns that pass, or all where fewer than two do."""
    pool = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("t"))
    return pool.select("conv_id", F.transform(filters.guarded_filter(F.col("t")), lambda x: F.md5(x)).alias("kept"))


def _paged(spark: SparkSession, sf_dir: str, build, name: str) -> DataFrame:
    """What build makes of all web pages as files of pages: their sources in text layout under a line with the page's id, and an index."""

    def written() -> DataFrame:
        path = passing(spark, "text-pages")
        source = table(spark, sf_dir, "pages").select(F.concat_ws("\n", F.col("page_id").cast("string"), F.coalesce("html", F.lit(""))).alias("text"))
        paged.write(source, path)
        return build(path, paged.index(spark, path, passing(spark, "page-index")))

    return settle(spark, written, name)


@query()
def page_image_urls(spark, sf_dir):
    """A rough image of each page's source as a data URL."""
    images = lambda path, index: paged.images(spark, path, index).select("width", "height", F.md5("url").alias("digest"))
    return _paged(spark, sf_dir, images, "page-images")


@query(r"""
WITH l AS (SELECT page_id, u.i AS line, ls[u.i] AS t FROM (SELECT page_id, string_split(replace(coalesce(html, ''), chr(12), ' '), chr(10)) AS ls FROM pages), unnest(range(1, len(ls) + 1)) AS u(i)),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l)
SELECT page_id, CAST(line AS BIGINT) AS line, CAST(len(ws) AS BIGINT) AS n_words, 6.0::DOUBLE * (length(t) - length(regexp_replace(t, '^[\x20\x09-\x0D]+', ''))) AS x0, 6.0::DOUBLE * length(regexp_replace(t, '[\x20\x09-\x0D]+$', '')) AS x1, md5(array_to_string(ws, ' ')) AS words FROM w WHERE len(ws) > 0
""")
def text_page_lines(spark, sf_dir):
    """The words of each line of all pages' sources, from files of pages by page ranges."""

    def lines(path: str, index: str) -> DataFrame:
        pages = paged.pages(spark, path, index).withColumn("page_id", F.col("lines")[0]["words"][0]["text"].cast("long"))
        each = pages.select("page_id", F.explode("lines").alias("l")).filter("l.top > 0")
        ends = [F.get("l.words", F.lit(0))["x0"].alias("x0"), F.element_at("l.words", -1)["x1"].alias("x1")]
        return each.select("page_id", (F.col("l.top") / paged.LINE).cast("long").alias("line"), F.size("l.words").cast("long").alias("n_words"), *ends, F.md5(F.array_join("l.words.text", " ")).alias("words"))

    return _paged(spark, sf_dir, lines, "page-lines")
