"""Queries of single steps: each over whole texts of documents, in which common words are first made into what the step looks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import numbers, text
from tessella.operators import filters
from tessella.plans.registry import query, table

#: What stands for a common word in a step's input, by the step's name.
Marks = tuple[tuple[str, str], ...]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _chain(x: str, rules: Marks) -> str:
    for a, b in rules:
        x = f"replace({x}, {_quoted(a)}, {_quoted(b)})"
    return x


def _regex(x: str, *rules: tuple[str, str]) -> str:
    for a, b in rules:
        x = f"regexp_replace({x}, {_quoted(a)}, {_quoted(b)}, 'g')"
    return x


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def step(name: str, does: str, marks: Marks, change: Callable[[Column], Column], sql: str | None) -> None:
    """Registers a query of one step: the digest and length of what it makes of each marked text. sql: the same of the column t."""

    def run(spark, sf_dir):
        marked = F.coalesce("text", F.lit(""))
        for a, b in marks:
            marked = F.replace(marked, F.lit(a), F.lit(b))
        made = table(spark, sf_dir, "documents", heavy=True).select("doc_id", change(marked).alias("made"))
        return made.select("doc_id", F.md5("made").alias("digest"), F.length("made").cast("long").alias("n"))

    run.__doc__, run.__name__ = does, name
    input_ = f"(SELECT doc_id, {_chain("coalesce(text, '')", marks)} AS t FROM documents)"
    query(sql and f"SELECT doc_id, md5(made) AS digest, length(made) AS n FROM (SELECT doc_id, {sql} AS made FROM {input_})", name)(run)


step(
    "angles_stripped", "N9", ((" the ", " <gap> "), (" of ", " <b>x</b> "), (" and ", " <big_gap> ")), text.strip_angles,
    "replace(translate(replace(replace(t, '<big_gap>', chr(1)), '<gap>', chr(1)), '<>', ''), chr(1), '<gap>')",
)
step("gaps_hyphenated", "N10", ((" the ", "x<gap>y "), (" of ", " <gap> ")), text.hyphenate_gaps, _regex("t", (r"([^\s-])<gap>", r"\1-<gap>"), (r"<gap>([^\s-])", r"<gap>-\1")))
step(
    "line_numbers_dropped", "N12", ((" the ", "\n12' - 14 a"), (" of ", "\n5 b"), (" and ", " c\\nd ")), text.drop_line_numbers,
    _regex("t", (r"(?:\\r\\n|\\n|\\r|[\r\n])+\s*\d+'?\s*-\s*\d+'?\s*", " "), (r"(^|[^\p{L}\p{N}_])\d+'?\s*-\s*\d+'?\s*", r"\1 "), (r"(?:\\r\\n|\\n|\\r|[\r\n])+\s*\d+'?\s*", " "), (r"(?:\\r\\n|\\n|\\r|[\r\n])+", " ")),
)
_UP, _LOW = "A-ZŠṬṢḪÀ-ÖØ-ÞŠḀ-ỿ", "a-zšṭṣḫà-öø-ÿšḁ-ỿ"
step(
    "determinatives", "N13", ((" the ", " (TUG)x "), (" of ", "（ki）x "), (" and ", " (d) (ABCDEFGH) ")), text.determinatives,
    _regex("t", (rf"\(([{_UP}0-9]{{1,6}})\)", r"\1"), (rf"\(([{_LOW}]{{1,4}})\)", r"{\1}"), (rf"（([{_UP}0-9]{{1,6}})）", r"\1"), (rf"（([{_LOW}]{{1,4}})）", r"{\1}")),
)
step("gap_clusters", "N15", ((" the ", "-<gap> - <gap>-x "), (" of ", " <gap> <gap> <gap> ")), text.collapse_gaps, _regex("t", (r"-?\s*<gap>(?:(?:\s*-\s*|\s+)+<gap>)+\s*-?", " <gap> ")))
step("hyphens_closed", "N16", ((" the ", "x- y"), (" of ", " - ")), text.hyphen_spacing, _regex("t", (r"(\S)-\s+(\S)", r"\1-\2"), (r"(^|\s)-(\s|$)", r"\1\2")))
step("commodities", "N24", ((" the ", " -gold "), (" of ", " x-tax -textiles ")), text.commodities, _regex("t", (r"(\s)-gold($|[^\p{L}\p{N}_])", r"\1pašallum gold\2"), (r"(\s)-tax($|[^\p{L}\p{N}_])", r"\1šadduātum tax\2"), (r"(\s)-textiles($|[^\p{L}\p{N}_])", r"\1kutānum textiles\2")))
step(
    "shekels", "N25", ((" the ", " 5 11 / 12 shekels "), (" of ", " 5 / 12 Shekel 7/12 shekel "), (" and ", " 1 / 12 (shekel) 1/12 ")), text.shekels,
    _regex("t", (r"(?i)5\s+11\s*/\s*12\s+shekels?", "6 shekels less 15 grains"), (r"(?i)5\s*/\s*12\s+shekels?", "⅓ shekel 15 grains"), (r"(?i)7\s*/\s*12\s+shekels?", "½ shekel 15 grains"), (r"(?i)1\s*/\s*12\s*(?:\(shekel\)|\bshekel)?", "15 grains")),
)
step("months", "N28", ((" the ", " Month XII, "), (" of ", " month iv x "), (" and ", " Month IX Month I ")), text.roman_months, _regex("t", *((rf"(?i)(^|[^\p{{L}}\p{{N}}_])Month\s+{r}($|[^\p{{L}}\p{{N}}_])", rf"\1Month {n}\2") for r, n in (("XII", 12), ("XI", 11), ("X", 10), ("IX", 9), ("VIII", 8), ("VII", 7), ("VI", 6), ("V", 5), ("IV", 4), ("III", 3), ("II", 2), ("I", 1)))))
step("punctuation", "N30", ((" the ", " , x "), (" of ", ",, "), (" and ", " ... ")), text.punctuation, _regex("t", (r"\s+([.,:])", r"\1"), (r"\.\.+", "."), (",,+", ",")))
step("plus_signs", "N32", ((" the ", " 1 + 2 "), (" of ", "a+b "), (" and ", " -+ c+- ")), text.plus_usage, None)
_ALLOWED = """!"'()+,-.0123456789:;<>?ABCDEFGHIJKLMNOPQRSTUWYZ[]_abcdefghijklmnopqrstuvwxyz¼½àâāēğīışŠšūṢṣṬṭ–—‘’“”⅓⅔⅙⅚ """
step(
    "alphabet", "N33", ((" the ", " VXÁ¾ "), (" of ", " \u1e2bs{}| ")), text.allowed_alphabet,
    _regex(_chain("translate(t, 'VXÁÀÂĀĒĞĪİŞŪ', 'vxáàâāēğīişū')", (("¾", "0.75"), ("⅝", "0.625"), ("⅜", "0.375"), ("⅞", "0.875"), ("⅛", "0.125"))), ("[^" + "".join("\\" + c if c in "\\]-[^" else c for c in _ALLOWED) + "]", "")),
)
step(
    "spellings", "N34", ((" the ", " [x] "), (" of ", " a/b/c "), (" and ", " <gap> ⌈x⌉ ...")), text.normalize_spelling, _squeezed(_regex("translate(" + _regex(_regex("trim(t)", (r"(?i)<\s*big_gap\s*>", "<gap>"), (r"(?i)\[\s*x\s*\]", "<gap>"), (r"(?i)⌈\s*x\s*⌉", "<gap>"), (r"\.{3,}|…+", "<gap>"), (r"(?i)<\s*gap\s*>", "\x01")), ("<[^>]*>", ""), ("\x01", "<gap>"), (r"([^/\s;]+?)(?:/[^/\s;]+)+", r"\1")) + ", '[]⌈⌉()', '')", (r"(?i)(?:<gap>\s*){2,}", "<gap> "))),
)
step("apostrophes", "N41", ((" the ", " Puzur-x' "), (" of ", " APuzur-y’ ")), text.fix_apostrophes, _regex("translate(t, '''’', '')", (r"(^|[^\p{L}\p{N}_])Puzur-", r"\1Puzur4-")))
step("glyphs", "N42", ((" the ", " {na "), (" of ", " !Star "), ("The ", "1-")), text.repair_glyphs, _regex(_chain("t", (("{", "i"), ("!Star", "IStar"))), ("^1-", "I-")))
_BLANKED = "list_transform(string_split(t, chr(10)), lambda x: CASE WHEN regexp_matches(trim(x), '(?i)^\\(?\\s*[\\divxlc]+\\.?\\s*\\)?$') THEN '' ELSE x END)"
step(
    "markers_blanked", "N43: each line of a text as a field", ((" the ", "\n(iv.)\n"), (" of ", "\n12\n"), (" and ", "\nCX )\n")),
    lambda t: F.array_join(F.transform(F.split(t, "\n"), lambda x: text.blank_markers(x)), "\n"), f"array_to_string({_BLANKED}, chr(10))",
)
_SENSE = _regex("trim(" + _regex("trim(" + _regex("trim(trim(lower(x)), chr(34) || chr(39) || '“”')", (r"[,;/()].*$", "")) + ")", ("^a ", ""), ("^an ", ""), ("^the ", "")) + ")", ("s$", ""))
step(
    "first_senses", "N44: each sentence of a text as a definition", (("The ", "the "), (" of ", "; "), (" and ", " (")), lambda t: F.array_join(F.transform(F.split(t, r"[.\n]"), lambda x: text.plural(text.singular(x))), "|"),
    f"array_to_string(list_transform(regexp_split_to_array(t, '[.\\n]'), lambda x: CASE WHEN {_SENSE} LIKE '%s' THEN {_SENSE} ELSE {_SENSE} || 's' END), '|')",
)
step(
    "sense_suffixes", "N45: each word of a text, marked with a number", (), lambda t: F.array_join(F.transform(F.split(t, " "), lambda x: text.strip_sense(F.concat(x, F.lit("  XIV ")))), " "),
    "array_to_string(list_transform(string_split(t, ' '), lambda x: " + _regex("trim(x || '  XIV ')", (r"\s+[IVXLCDM]+$", "")) + "), ' ')",
)
step("hint_texts", "N46", ((" the ", ' "x" '), (" of ", "; ")), text.hint_text, "array_to_string(list_filter(regexp_split_to_array(trim(string_split(string_split(" + _squeezed("translate(t, chr(160) || '\"', ' ')") + ", ';')[1], '(')[1]), '\\s+'), lambda x: x <> '')[1:4], ' ')")
_LINES = "list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
step(
    "fragments", "N48", ((" the ", "-\n"), (" of ", "\n")), lambda t: text.join_fragments(F.split(t, "\n")),
    f"coalesce(array_to_string(list_transform({_LINES}[1:len({_LINES}) - 1], lambda x: CASE WHEN x LIKE '%-' THEN x[1:length(x) - 1] ELSE x || ' ' END), ''), '') || coalesce({_LINES}[len({_LINES})], '')",
)
step("byte_model_source", "N39", ((" the ", " [x] "), (" of ", " [...] "), (" and ", " ⌈a⌉/b:c₂ ")), text.source_for_model, _squeezed("translate(translate(" + _regex("translate(translate(t, 'ḫḪ', 'hH'), '₀₁₂₃₄₅₆₇₈₉ₓ', '0123456789x')", (r"\[\s*x\s*\]", "<gap>"), (r"\[?\s*(?:…|\.\.\.)+\s*\]?", "<big_gap>"), (r"\[([^\]]*)\]", r"\1")) + ", '!?⌈⌉˹˺', ''), '/:', '  ')"))
step("stray_marks", "N27", ((" the ", " <<x>> "), (" of ", " <b> <gap> "), (" and ", " ‘a’ / b ")), text.stray_marks, "translate(" + _regex("t", ("<gap>", "\x01"), ("<big_gap>", "\x02"), (r"<<[^>]*>>|<[^>]*>", ""), ("\x01", "<gap>"), ("\x02", "<big_gap>"), (r"(^|[^\p{L}\p{N}_])(?:\.\.+|xx+)($|[^\p{L}\p{N}_])", r"\1\2"), (r"(^|[^0-9/\s])\s+/\s+[^0-9\s]\S*", r"\1")) + ", '“”‘’', '\"\"' || chr(39) || chr(39))")
step("grammar_notes", "N26", ((" the ", " (fem. plur.) "), (" of ", " sing. x "), (" and ", " (?) ")), text.grammar_notes, "replace(" + _regex("t", (r"(?i)\(\s*(?:fem|plur|pl|sing|singular|plural|\?|\!)(?:\.\s*(?:plur|plural|sing|singular))?\.?\s*[^)]*\)", " "), (r"(?i)(^|[^\p{L}\p{N}_])(?:fem|sing|pl|plural)\.?(?:\s+|$)", r"\1 "), (r"(?i)(^|[^\p{L}\p{N}_])(?:fem|sing|pl|plural)\.?([^\p{L}\p{N}_\s])", r"\1 \2")) + ", '(?)', '')")
step("canonical_decimals", "N19", ((" the ", " 0.33333 "), (" of ", " 1.16667x 2.6666 "), (" and ", " 0.1234567 ")), numbers.canonical_decimals, None)
step("canonical_sums", "N20", ((" the ", " 3 + 0.3333 "), (" of ", " 2+0.12345 ")), numbers.canonical_sums, None)
step("literal_fixes", "N21, N53: the fixed literals of both sides", ((" the ", " KÙ.B. lá+lá "), (" of ", " ofדsilver myself() "), (" and ", " <lil> PN ")), lambda t: F.replace(text.literals(F.replace(t, F.lit("KÙ.B."), F.lit("KÙ.BABBAR")), text.R.TARGET_FIXES), F.lit("lá+lá"), F.lit("lá-lá")),
     "replace(" + _chain("replace(t, 'KÙ.B.', 'KÙ.BABBAR')", (("ofדsilver", "of silver"), ("myself()", "myself"), ("<lil>", "-lil"), ("<of firewood>", "of firewood"), ("andĀl-ṭāb", "and Āl-ṭāb"))) + ", 'lá+lá', 'lá-lá')")
step("literal_chain", "N3: ordered replacements, each on what those before it left", ((" the ", " ab "), (" of ", " bc ")), lambda t: text.literals(t, (("ab", "b"), ("bb", "c"), ("bc", "ab"), ("", "z"))), _chain("t", (("ab", "b"), ("bb", "c"), ("bc", "ab"))))
step("pattern_chain", "N4: ordered patterns", ((" the ", " 12 ab "),), lambda t: text.subs(t, ((r"(\d+)\s+(\w)", "$2$1"), (r"[aeiou]{2,}", "+"))), _regex("t", (r"(\d+)\s+([\p{L}\p{N}_])", r"\2\1"), ("[aeiou]{2,}", "+")))
step("words_mapped", "N5: whole tokens, with their punctuation put back", ((" the ", " x, "), (" of ", " VII. ")), lambda t: text.map_words(t, text.R.V1_TARGET_WORDS), None)


_SPLIT = "list_filter(list_transform(string_split(t, ';'), lambda x: trim(x)), lambda x: x <> '')"


def _fields_sql() -> str:
    t = _chain("coalesce(text, '')", ((" the ", "; "), (" of ", ";x;x; ")))
    return f"""
WITH e AS (SELECT doc_id, {_SPLIT.replace('string_split(t', 'string_split(' + t)} AS p FROM documents),
f AS (SELECT doc_id, x, min(i) AS i FROM (SELECT doc_id, i, p[i] AS x FROM e, unnest(range(1, len(p) + 1)) AS u(i)) GROUP BY doc_id, x),
m AS (SELECT doc_id, string_agg(x, '; ' ORDER BY i) AS made FROM f GROUP BY doc_id)
SELECT doc_id, md5(coalesce(made, '')) AS digest, length(coalesce(made, '')) AS n FROM e LEFT JOIN m USING (doc_id)"""


@query(_fields_sql())
def fields(spark, sf_dir):
    """Values between semicolons, each once."""
    marked = F.replace(F.replace(text.nonnull(F.col("text")), F.lit(" the "), F.lit("; ")), F.lit(" of "), F.lit(";x;x; "))
    made = table(spark, sf_dir, "documents").select("doc_id", text.normalize_field(marked, lambda x: F.trim(x)).alias("made"))
    return made.select("doc_id", F.md5("made").alias("digest"), F.length("made").cast("long").alias("n"))


@query("SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n|;|\\|'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: length(x) > 1) AS names FROM documents")
def name_variants(spark, sf_dir):
    """N51"""
    return table(spark, sf_dir, "documents").select("doc_id", text.name_variants(F.col("text")).alias("names"))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Translate:' || chr(10) || coalesce(text, '') ELSE 'Translate:' || chr(10) || 'Hints: ' || role || ' = ' || turn || chr(10) || coalesce(text, '') END AS prompt FROM conversations")
def prompts(spark, sf_dir):
    """N50"""
    hint = F.array(F.struct(F.col("role").alias("form"), F.col("turn").cast("string").alias("hint")))
    none = F.filter(hint, lambda h: F.lit(False))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.prompt(text.nonnull(F.col("text")), F.when(F.col("turn") % 2 == 0, none).otherwise(hint)).alias("prompt"))


@query()
def quality_scores(spark, sf_dir):
    """the score of each turn, and whether it would be kept."""
    q = filters.quality_score(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(q, 6).alias("quality")).withColumn("good", F.col("quality") >= 0.42)
