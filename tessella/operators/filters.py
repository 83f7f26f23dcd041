"""Row filters and predicates. Each takes and gives a DataFrame or Column; column names are parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import rules as R
from tessella.functions.regex import let, squeeze, words_ws
from tessella.functions.text import nonnull


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """fails at plan building when a column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return df


def exclude(df: DataFrame, column: str, values: tuple[str, ...] = (), patterns: tuple[str, ...] = ()) -> DataFrame:
    """without rows whose trimmed value is listed or matches a pattern."""
    value = F.trim(F.coalesce(F.col(column), F.lit("")))
    hit = value.isin(*values) if values else F.lit(False)
    for p in patterns:
        hit = hit | F.regexp_like(value, F.lit(p))
    return df.filter(~hit)


def min_words(df: DataFrame, *columns: str, more_than: int = 5) -> DataFrame:
    """all columns have more words than that."""
    for c in columns:
        df = df.filter(F.size(words_ws(F.coalesce(F.col(c), F.lit("")))) > more_than)
    return df


def short_rows(df: DataFrame, column: str, limit: int) -> DataFrame:
    """rows of limit words at most."""
    return df.filter(F.size(words_ws(F.coalesce(F.col(column), F.lit("")))) <= limit)


def detect(df: DataFrame, rules: list[tuple[str, str, str, bool]]) -> DataFrame:
    """a row for each rule (label, column, pattern, is a regular expression) that a row fulfils."""
    hits = [F.when(F.regexp_like(F.col(c), F.lit(p)) if rx else F.contains(F.col(c), F.lit(p)), F.lit(label)) for label, c, p, rx in rules]
    return df.withColumn("label", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())))


def is_terminal(text: Column) -> Column:
    """ends a sentence, and not by an ellipsis."""
    text = F.trim(text)
    return F.regexp_like(text, F.lit(r"""[.!?]["'”’)\]]*$""")) & ~F.regexp_like(text, F.lit(r"""(?:\.{3,}|…)["'”’)\]]*$"""))


def keep_terminal_segments(df: DataFrame, segments: str = "segments", field: str = "translation") -> DataFrame:
    """segments that end in a full stop; rows left without any go."""
    return df.withColumn(segments, F.filter(segments, lambda s: F.endswith(F.rtrim(s[field]), F.lit(".")))).filter(F.size(segments) > 0)


def is_indexable(token: Column) -> Column:
    """not empty, no gap mark, with a letter."""
    return (token != "") & (token != "<gap>") & F.regexp_like(token, F.lit(r"\p{L}"))


def content_words(text: Column, stopwords: tuple[str, ...] = R.STOPWORDS) -> Column:
    """F8: the lower-case words of plain letters, with one hyphen or apostrophe inside, that are no stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"({R.CONTENT_TOKEN})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stopwords))


def unbalanced(df: DataFrame, *columns: str, opening: str = "<", closing: str = ">") -> DataFrame:
    """(row, field, opened, closed) where a field has not as many of one as of the other."""
    count = lambda c, x: (F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))).cast("long")
    fields = F.array(*(F.struct(F.lit(c).alias("field"), count(F.col(c), opening).alias("opened"), count(F.col(c), closing).alias("closed")) for c in columns))
    return df.withColumn("f", F.explode(fields)).select(*df.columns, "f.*").filter("opened <> closed")


def pick_rows(df: DataFrame, ids: list | None = None, first: int | None = None, id_col: str = "id", order: str = "_ord") -> DataFrame:
    """rows by id, or the first n in order, or all."""
    df = df.filter(F.col(id_col).isin(ids)) if ids is not None else df
    return df.orderBy(order).limit(first) if first is not None else df


def page(df: DataFrame, number: int, column: str = "pdf_page") -> DataFrame:
    """F11"""
    return df.filter(F.col(column) == number)


def _stopword_hits(text: Column) -> Column:
    return F.size(F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1)), lambda w: w.isin(*R.TABLE_STOPWORDS)))


def source_like(text: Column) -> Column:
    """looks like a transliteration: signs and hyphenated syllables count two, function words and editorial marks one,
    hyphens one each up to two, and each English stopword takes one away; two make one."""

    def score(t: Column) -> Column:
        found = lambda pattern, points: F.when(F.regexp_like(t, F.lit("(?U)" + pattern)), points).otherwise(0)
        hyphens = F.length(t) - F.length(F.replace(t, F.lit("-"), F.lit("")))
        marks = F.when(F.regexp_like(t, F.lit(r"[\[\]{}!/]")), 1).otherwise(0)
        return found(R.SOURCE_SIGN, 2) + found(R.SOURCE_SYLLABLE, 2) + found(R.SOURCE_FUNCTION, 1) + marks + F.least(hyphens, F.lit(2)) - _stopword_hits(t)

    return let(squeeze(nonnull(text)), lambda t: (t != "") & (score(t) >= 2))


def target_like(text: Column) -> Column:
    """looks like an English sentence: a stopword or three words of plain letters, and no publication named."""
    words = lambda t: F.regexp_count(t, F.lit("[A-Za-z]{2,}"))
    return let(squeeze(nonnull(text)), lambda t: (t != "") & ~F.regexp_like(t, F.lit(R.TITLE_SOURCE)) & ((_stopword_hits(t) >= 1) | (words(t) >= 3)))


def title_like(text: Column) -> Column:
    """names a publication, by number or by its letters."""
    return let(nonnull(text), lambda t: F.regexp_like(t, F.lit(R.TITLE_SOURCE)) & (F.regexp_like(t, F.lit(R.TITLE_NUMBER)) | F.contains(F.lower(t), F.lit("kt "))))


def note_like(*parts: Column) -> Column:
    """any part begins a note or comment."""
    return reduce(lambda a, b: a | b, (F.regexp_like(nonnull(c), F.lit(R.NOTE_START)) for c in parts))


def marker_like(text: Column) -> Column:
    """a line number."""
    return F.regexp_like(nonnull(text), F.lit(R.MARKER))


def quality_score(text: Column) -> Column:
    """from 0 to 1: penalties for few letters, many digits, capitals, marks or words of one character, a very long word, no
    common English word, and a gap."""

    def of(t: Column) -> Column:
        size = F.greatest(F.length(t), F.lit(1))
        words = words_ws(t)
        share = lambda pattern, whole: F.regexp_count(t, F.lit(pattern)) / whole
        letters = F.regexp_count(t, F.lit(r"\p{L}"))
        marks = F.length(t) - F.length(F.translate(t, R.QUALITY_PUNCTUATION, ""))
        common = F.regexp_like(t, F.lit(rf"(?Ui)\b(?:{'|'.join(R.QUALITY_WORDS)})\b"))
        penalties = (
            (letters / size < 0.45, 0.35), (share(r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]", size) > 0.20, 0.20), (share(r"\p{Lu}", F.greatest(letters, F.lit(1))) > 0.30, 0.20), (marks / size > 0.35, 0.25),
            (F.size(F.filter(words, lambda w: F.length(w) == 1)) / F.size(words) > 0.35, 0.20), (F.array_max(F.transform(words, F.length)) > 22, 0.20), (~common, 0.20), (F.contains(t, F.lit("<gap>")), 0.10),
        )
        left = reduce(lambda s, p: s - F.when(p[0], p[1]).otherwise(0.0), penalties, F.lit(1.0))
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), left))

    return let(F.trim(nonnull(text)), of)


def guarded_filter(candidates: Column, keep=lambda c: quality_score(c) >= R.QUALITY_LEAST, at_least: int = 2) -> Column:
    """the candidates that pass, unless fewer than at_least do; then all."""
    good = F.filter(candidates, keep)
    return F.when(F.size(good) >= at_least, good).otherwise(candidates)


def disallowed_characters(text: Column, alphabet: str) -> Column:
    """the sorted distinct characters that are neither white space nor in the alphabet."""
    allowed = F.lit(alphabet)
    return F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), ""), lambda c: (c != "") & ~F.regexp_like(c, F.lit(r"(?U)\s")) & (F.instr(allowed, c) == 0))))
