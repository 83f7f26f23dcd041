"""The queries of this subpackage over a folder of tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import chat_format, erasure, exact_dedup, html_extract, language_id, license_scan, line_dedup, media, minhash_dedup, mixing, packing, quality_rules, whitening
from tessella.session import scratch, settle, spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A whole table, on all cores however few splits its file has."""
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weights(_read(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path())


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


#: A conversation that every run formats besides the table's, with control strings in its texts.
ODD_CONVERSATION = ((-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT " + "explode(array(" + ", ".join(f"named_struct('conv_id', {c}L, 'turn', {t}L, 'role', '{r}', 'text', r'{x}')" for c, t, r, x in ODD_CONVERSATION) + ")) AS x").select("x.*")
    return settle(spark, lambda: _chat_digest(turns.unionByName(odd)), "chat")


def _chat_digest(turns: DataFrame) -> DataFrame:
    back = chat_format.read_back(chat_format.windows(turns))
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("targets").cast("long").alias("loss_chars"),
        F.sha2(F.col("targets").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.encode(_read(spark, sf_dir, "documents"))


def op11_erasure_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return erasure.erase_shop({t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in erasure.MONEY}, scratch(spark, "erased"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(_read(spark, sf_dir, "embeddings"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "c")
    return rows.select("vec_id", "n", "deviation", "identity_error", each).select("vec_id", (F.col("place") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_read(spark, sf_dir, "documents"), largest=True)


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_language_id": op5_language_id,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_html_extract": op7_html_extract,
    "op8_chat_format": op8_chat_format,
    "op9_license_scan": op9_license_scan,
    "op10_media_columns": op10_media_columns,
    "op11_erasure_rewrite": op11_erasure_rewrite,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_exact_dedup": op13_exact_dedup,
}

_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _licenses_sql() -> str:
    """Dice over multisets of bigrams by joins: the templates as rows of constants."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    grams = license_scan.template_bigrams()
    rows = ", ".join(f"({quote(n)}, {quote(g)}, {gs.count(g)}, {len(gs)})" for n, gs in grams.items() for g in sorted(set(gs)))
    # Units of more words share too little with the longest template.
    most = int(max(map(len, grams.values())) * (2 - license_scan.THRESHOLD) / license_scan.THRESHOLD) + 2
    return f"""
WITH template(name, gram, c, size) AS (VALUES {rows}),
parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
units AS (
  SELECT doc_id, i AS unit, string_split(trim(regexp_replace(lower(ls[i]), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM parts, unnest(range(1, len(ls) + 1)) AS u(i)
  UNION ALL
  SELECT doc_id, 0, string_split(trim(regexp_replace(lower(array_to_string(ls, chr(10))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') FROM parts WHERE len(ls) > 1
),
sized AS (SELECT doc_id, unit, w, len(w) - 1 AS a FROM units WHERE len(w) > 1 AND len(w) <= {most}),
grams AS (SELECT doc_id, unit, a, w[i] || ' ' || w[i + 1] AS gram FROM sized, unnest(range(1, len(w))) AS u(i)),
counted AS (SELECT doc_id, unit, a, gram, count(*) AS c FROM grams GROUP BY ALL),
scored AS (
  SELECT doc_id, unit, name, 2.0::DOUBLE * sum(least(g.c, t.c))::DOUBLE / (any_value(a) + any_value(size)) AS dice
  FROM counted g JOIN template t USING (gram) GROUP BY doc_id, unit, name
),
best AS (SELECT doc_id, unit, max(dice) AS dice, min_by(name, (-dice, name)) AS name FROM scored WHERE dice >= {license_scan.THRESHOLD} GROUP BY doc_id, unit),
per AS (SELECT doc_id, count(*) AS n_matches, max(dice) AS dice, min_by(name, (-dice, name)) AS license, list_sort(list(DISTINCT name)) AS licenses FROM best GROUP BY doc_id),
runs AS (SELECT doc_id, j AS run, list_filter(regexp_split_to_array(regexp_extract(rs[j], '{license_scan.SPDX_RUN}'), '[ \\t()]+'), lambda t: t <> '') AS ts FROM (SELECT doc_id, string_split(text, '{license_scan.SPDX_TAG}') AS rs FROM documents), unnest(range(2, len(rs) + 1)) AS u(j)),
tokens AS (SELECT doc_id, run, i, ts[i] AS t, i > 1 AND ts[i - 1] = 'WITH' AS exception FROM runs, unnest(range(1, len(ts) + 1)) AS u(i)),
ends AS (SELECT doc_id, run, min(i) FILTER (i % 2 = 0 AND t NOT IN ('AND', 'OR', 'WITH')) AS stop FROM tokens GROUP BY doc_id, run),
named AS (SELECT doc_id, list_sort(list(DISTINCT regexp_replace(t, '[.-]+$', ''))) AS spdx FROM tokens JOIN ends USING (doc_id, run) WHERE i % 2 = 1 AND i < coalesce(stop, i + 1) AND NOT exception AND regexp_replace(t, '[.-]+$', '') <> '' GROUP BY doc_id)
SELECT p.doc_id, len(ls) AS n_lines, coalesce(n_matches, 0) AS n_matches, license, dice, coalesce(licenses, []) AS licenses, coalesce(spdx, []) AS spdx
FROM parts p LEFT JOIN per USING (doc_id) LEFT JOIN named USING (doc_id)"""


def _chat_sql() -> str:
    def escaped(column: str, n: int) -> str:
        for char, letter in chat_format.CONTROLS[:n]:
            column = f"replace({column}, '{char}', '\\{letter}')"
        return column

    odd = " UNION ALL ".join(f"SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in ODD_CONVERSATION)
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {odd}),
heads AS (SELECT *, '### ' || {escaped("role", 4)} || ': ' AS head, {escaped("text", 3)} AS body FROM turns),
sized AS (
  SELECT *, length(head) + length(body) + 8 AS chars, ceil((length(head) + length(body) + 8) / 4.0)::BIGINT AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, head, body) AS pos FROM heads
),
named AS (SELECT * EXCLUDE (size), size, role = 'system' AND sum(size) OVER (PARTITION BY conv_id, role = 'system' ORDER BY pos DESC) <= {chat_format.BUDGET * chat_format.SYSTEM[0] // chat_format.SYSTEM[1]} AS fixed FROM sized),
kept AS (SELECT conv_id, coalesce(sum(size) FILTER (fixed), 0) AS fixed_size FROM named GROUP BY conv_id),
rooms AS (
  SELECT conv_id, fixed_size, least({chat_format.HISTORY}, greatest({chat_format.BUDGET} - fixed_size, 1) // 4) AS past,
    greatest(greatest({chat_format.BUDGET} - fixed_size, 1) - least({chat_format.HISTORY}, greatest({chat_format.BUDGET} - fixed_size, 1) // 4), 1) AS room FROM kept
),
kinds AS (SELECT s.*, fixed_size, past, room, CASE WHEN NOT fixed AND 2 * size > room THEN 1 ELSE 0 END AS alone FROM named s JOIN rooms USING (conv_id)),
running AS (
  SELECT *, coalesce(sum(CASE WHEN fixed OR alone = 1 THEN 0 ELSE size END) OVER o, 0) AS before, coalesce(sum(alone) OVER o, 0) AS larger
  FROM kinds WINDOW o AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
windowed AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY 2 * larger + alone, 2 * before // room) AS win FROM running),
spans AS (SELECT conv_id, win, coalesce(sum(size) FILTER (NOT fixed), 0) AS own, any_value(fixed_size) AS fixed_size, any_value(past) AS past FROM windowed GROUP BY conv_id, win),
many AS (SELECT conv_id, max(win) AS n FROM spans GROUP BY conv_id),
tails AS (SELECT *, sum(CASE WHEN fixed THEN 0 ELSE size END) OVER (PARTITION BY conv_id, win ORDER BY pos DESC) AS tail FROM windowed),
copies AS (
  SELECT t.*, CASE WHEN t.fixed THEN n WHEN tail <= greatest(least(s.past, {chat_format.BUDGET} - s.fixed_size - s.own), 0) THEN 2 ELSE 1 END AS times
  FROM tails t JOIN many USING (conv_id) LEFT JOIN spans s ON s.conv_id = t.conv_id AND s.win = t.win + 1
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars * times)::BIGINT AS formatted_chars
FROM copies GROUP BY conv_id"""


SQL = {
    "op8_chat_format": _chat_sql(),
    "op3_line_dedup": f"""
WITH parts AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT doc_id, unnest(range(len(parts))) AS i, unnest(parts) AS line FROM parts
), keyed AS (
  SELECT doc_id, i, line, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), seen AS (
  SELECT key, max(doc_id) AS max_doc FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id < s.max_doc, false) AS gone FROM keyed k LEFT JOIN seen s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_license_scan": _licenses_sql(),
    "op13_exact_dedup": """
WITH flat AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM flat GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM flat JOIN groups USING (t)""",
}
