"""Fixed values of the normalisation profiles: they decide results and so are kept as they are, in order."""

from __future__ import annotations

SUBSCRIPTS = ("₀₁₂₃₄₅₆₇₈₉", "0123456789")
VOWELS = ("aeiuAEIU", "áéíúÁÉÍÚ", "àèìùÀÈÌÙ")
SIBILANTS = (("sz", "š"), ("SZ", "Š"), ("s,", "ṣ"), ("S,", "Ṣ"), ("t,", "ṭ"), ("T,", "Ṭ"))

# --- Fixed values: first profile ("v1") -----------------------------------------------------------------
V1_NUMBERS = (("II", "2"), ("III", "3"), ("IV", "4"), ("V", "5"), ("VI", "6"), ("VII", "7"), ("VIII", "8"), ("IX", "9"), ("X", "10"), ("XI", "11"), ("XII", "12"))
V1_GAP_WORDS = (("x", "<gap>"), ("<gap>+", "<gap>"), ("<gap>-", "<gap>"), ("-", ""))
V1_SOURCE_WORDS = (("-gold", "pašallum gold"), ("-tax", "šadduātum tax"), ("-textiles", "kutānum textiles"), *V1_GAP_WORDS, *V1_NUMBERS)
V1_TARGET_WORDS = (*V1_GAP_WORDS, *V1_NUMBERS)
V1_DIGITS = tuple(zip(*SUBSCRIPTS, strict=True))
V1_SOURCE_LITERALS = (
    *V1_DIGITS, ("x", ""), ("ₓ", ""), ("ʾ", "'"),
    ("a2", "á"), ("a3", "à"), ("e2", "é"), ("e3", "è"), ("i2", "í"), ("i3", "ì"), ("u2", "ú"), ("u3", "ù"),
    ("sz", "š"), ("SZ", "Š"), ("s,", "Ṣ"), ("S,", "ṣ"), ("t,", "ṭ"), ("T,", "Ṭ"), ("Ḫ", "H"), ("ḫ", "h"),
    ("(d)", "{d}"), ("{tug2}", "TÚG"), ("{tug₂}", "TÚG"), ("(ki)", "{ki}"), ("(TÚG)", "TÚG"),
    (".3333300000000001", ".3333"), (".6666600000000003", ".6666"), ("KÙ.B.", "KÙ.BABBAR"), ("+", "-"),
    ("-x", "-<gap>"), ("+x", "-<gap>"), ("<gap>+", "<gap>-"), ("(large break)", "<gap>"), ("<gap> <gap>", "<gap>"),
)
V1_TARGET_LITERALS = (
    *V1_DIGITS, ("ₓ", "x"), ("ʾ", "'"), ("ofדsilver", "of silver"), ("myself()", "myself"), ("<lil>", "-lil"),
    ("<of firewood>", "of firewood"), (".3333300000000001", ".3333"), (".6666600000000003", ".6666"), ("+", "-"),
    ("[x]", "<gap>"), ("(large break)", "<gap>"), ("ê", "e"), ("ì", "ī"), ("û", "u"), ("Ā", "A"), ("Ē", "E"),
    ("Ī", "I"), ("ạ", "a"), ("andĀl-ṭāb", "and Āl-ṭāb"),
)
V1_SOURCE_REMOVED = ("!", "?", "(", ")", "⌈", "⌉", "[", "]", '"', "'", "ʾ")
V1_TARGET_REMOVED = ("!", "?", "(", ")", "fem.", "plur.", "pl.", "sing.", "plural", '"', "'", "—", "–", "⌈", "⌉", "[", "]", "ʾ", ":", ";", ".", ",", "/", "{", "}")
BROKEN_LINES = r"\([(\d)? ]*broken line[s]*\)"
V1_TARGET_PATTERNS = ((r"<[\s]*big[\s_\-]*gap[\s]*>", "<gap>"), (BROKEN_LINES, "<gap>"), (r"\[[\[\s]*…]+[\s]*\]", "<gap>"), (r"<gap>[\[\s]*<gap>]+", "<gap>"))

# --- Fixed values: second profile ("v2") and the inference profiles ---------------------------------------
LINE_BREAK = r"(?:\\r\\n|\\n|\\r|[\r\n])+"
UPPER = r"A-ZŠṬṢḪÀ-ÖØ-ÞŠḀ-ỿ"
LOWER = r"a-zšṭṣḫà-öø-ÿšḁ-ỿ"
FRACTION_SIGNS = (("0.8333", "⅚"), ("0.6666", "⅔"), ("0.3333", "⅓"), ("0.1666", "⅙"), ("0.625", "⅝"), ("0.75", "¾"), ("0.25", "¼"), ("0.5", "½"))
FRACTIONS_4 = ((1 / 6, "0.1666"), (1 / 4, "0.25"), (1 / 3, "0.3333"), (1 / 2, "0.5"), (2 / 3, "0.6666"), (3 / 4, "0.75"), (5 / 6, "0.8333"))
FRACTIONS_5 = ((1 / 6, "0.16666"), (1 / 4, "0.25"), (1 / 3, "0.33333"), (1 / 2, "0.5"), (2 / 3, "0.66666"), (3 / 4, "0.75"), (5 / 6, "0.83333"))
FRACTION_TOLERANCE = 2e-3
CHARACTERS = ("ḫḪ₀₁₂₃₄₅₆₇₈₉—–ʾ", "hH0123456789--")
V2_SOURCE_REMOVED = ("!", "?", "(", ")", "（", "）", "⌈", "⌉", "[", "]", '"', "'", "ʾ", "˹", "˺")
SEPARATORS = ("/", ":")
V2_FORBIDDEN = "——<>⌈⌋⌊[]+ʾ;()（）"
INFER_FORBIDDEN = "——<>⌈⌋⌊[]+ʾ;"
BEST_FORBIDDEN = "——<>⌈⌋⌊[]ʾ;"
COMMODITIES = (("gold", "pašallum gold"), ("tax", "šadduātum tax"), ("textiles", "kutānum textiles"))
SHEKELS = (
    (r"5\s+11\s*/\s*12\s+shekels?", "6 shekels less 15 grains"),
    (r"5\s*/\s*12\s+shekels?", "⅓ shekel 15 grains"),
    (r"7\s*/\s*12\s+shekels?", "½ shekel 15 grains"),
    (r"1\s*/\s*12\s*(?:\(shekel\)|(?<![\p{L}\p{N}_𒀀])shekel)?", "15 grains"),
)
#: Ways to write a gap; the sign in what must not stand in front is a letter like the others (regex.PAIR); that of a broken line is left out by the inference profiles.
GAPS = (
    r"<\s*big[\s_\-]*gap\s*>", r"<\s*gap\s*>", r"(?<![\p{L}\p{N}_𒀀])big[\s_\-]*gap(?![\p{L}\p{N}_])", r"(?<![\p{L}\p{N}_𒀀])x(?:\s+x)+(?![\p{L}\p{N}_])", r"\.{3,}|…+|\[\.+\]",
    r"\[\s*x\s*\]|\(\s*x\s*\)", r"(?<![\p{L}\p{N}_𒀀])x{2,}(?![\p{L}\p{N}_])", r"(?<![\p{L}\p{N}_𒀀])x(?![\p{L}\p{N}_])", r"\(\s*large\s+break\s*\)", r"\(\s*break\s*\)", r"\(\s*\d+\s+broken\s+lines?\s*\)",
)
GAP_BROKEN_LINE = r"\(\s*broken\s+line\s*\)"
GRAMMAR_NOTES = r"\(\s*(?:fem|plur|pl|sing|singular|plural|\?|\!)(?:\.\s*(?:plur|plural|sing|singular))?\.?\s*[^)]*\)"
GRAMMAR_WORDS = r"(?:fem|sing|pl|plural)\.?"
SIMPLE_FORBIDDEN = "⌈⌋⌊ʾ"
SIMPLE_ALPHABET = """!"'()+,-.0123456789:;<>?ABCDEFGHIJKLMNOPQRSTUWYZ[]_abcdefghijklmnopqrstuvwxyz¼½àâāēğīışŠšūṢṣṬṭ–—‘’“”⅓⅔⅙⅚ """
SIMPLE_FALLBACK = (
    ("V", "v"), ("X", "x"), ("Á", "á"), ("À", "à"), ("Â", "â"), ("Ā", "ā"), ("Ē", "ē"), ("Ğ", "ğ"), ("Ī", "ī"), ("İ", "i"), ("Ş", "ş"), ("Ū", "ū"),
    ("¾", "0.75"), ("⅝", "0.625"), ("⅜", "0.375"), ("⅞", "0.875"), ("⅛", "0.125"),
)
ROMAN = (("XII", 12), ("XI", 11), ("X", 10), ("IX", 9), ("VIII", 8), ("VII", 7), ("VI", 6), ("V", 5), ("IV", 4), ("III", 3), ("II", 2), ("I", 1))
TARGET_FIXES = (("ofדsilver", "of silver"), ("myself()", "myself"), ("<lil>", "-lil"), ("<of firewood>", "of firewood"), ("andĀl-ṭāb", "and Āl-ṭāb"))

# --- Fixed values: row filters, tokens, lookups ----------------------------------------------------------
OUTER_STRIP, INNER_STRIP = "[](){}<>⸢⸣⌈⌉⌊⌋⟦⟧", ".,;:!?+-*'\""
NUMERIC_PLUS = "0-9¼½¾⅓⅔⅙⅚⅝"
NAME_BOUNDARY = "A-Za-zÀ-ÖØ-öø-ÿĀ-žḀ-ỿ-"
PANDAS_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
CONTENT_TOKEN = r"[A-Za-z]+(?:[-'][A-Za-z]+)?"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "her", "him", "his", "i", "in", "into", "is", "it", "its", "me", "my", "of", "on", "or", "our",
    "she", "that", "the", "their", "them", "they", "this", "to", "us", "was", "we", "were", "with", "you", "your",
)

# --- Fixed values: candidate quality -----------------------------------------------------------------------
QUALITY_PUNCTUATION = "!\"'()+,-.0123456789:;<>?[]_–—"
QUALITY_WORDS = (
    "the", "and", "of", "to", "in", "is", "for", "with", "from", "you", "he", "she", "they", "we", "it",
    "silver", "textile", "textiles", "mina", "minas", "shekel", "shekels", "gold", "month", "owed", "received", "sent", "pay", "paid", "tablet", "brother", "son",
)
QUALITY_LEAST = 0.42

# --- Fixed values: rows of printed tables -------------------------------------------------------------------
TITLE_SOURCE = r"(?i)\b(?:kt|kts|tc|tcl|cct|ick|poat|ktm)\b"
TITLE_NUMBER = r"(?i)^\d+[a-z]?\.$"
NOTE_START = r"(?i)^(?:note|notes|comment)\s*:"
MARKER = r"(?i)^(?:\d+[a-z]?|e)\.?$"
TERMINAL = r"(?:\.\.\.|[.!?;:])[\]\"')]*$"
SOURCE_SIGN = r"\b(?:DUMU|IGI|KI|URUDU|GIN|KU|KÙ|SES|ITI|LUGAL|TUG|TA)\b"
SOURCE_SYLLABLE = r"\b[\w!\[\]{}'/]+-[\w!\[\]{}'/]+\b"
SOURCE_FUNCTION = r"(?i)\b(?:a-na|i-na|ma-na|sa|ina|ana)\b"
TABLE_STOPWORDS = (
    "a", "again", "and", "at", "be", "by", "comment", "context", "date", "fact", "for", "from", "in", "is", "line", "meaning", "note", "of", "or", "reason", "reading",
    "son", "silver", "text", "that", "the", "this", "to", "was", "with", "word", "owed", "witnessed",
)
TITLE_TOP, ROW_TOLERANCE, STREAK_LIMIT, PAGE_CANDIDATES, SEGMENT_GAP = 90.0, 3.0, 2, 8, 24.0
