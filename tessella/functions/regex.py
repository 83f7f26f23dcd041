"""Regular expressions with Unicode meaning on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a word character is: letters, numbers of any kind and the underscore.
W = r"\p{L}\p{N}_"
#: A letter beyond 16 bits. Java looks back by characters only for a class that names one, else by halves of such letters.
PAIR = "\U00012000"
#: Word bounds on either side, for use around a token.
LEFT, RIGHT = rf"(?<![{W}{PAIR}])", rf"(?![{W}])"
#: Characters of patterns one by one: Java looks such a class up, but tries ranges one after the other.
LETTERS = "".join(chr(i) for i in range(128) if chr(i).isalpha())
BREAKS = "".join(rf"\x{i:02x}" for i in range(128) if not (chr(i).isalnum() or chr(i) == "_"))
NO_DIGITS = "".join(rf"\x{i:02x}" for i in range(128) if not chr(i).isdigit())
#: A character past ASCII of a class: [[^\x00-\x7F]&&[class]]. Plain letters are told apart first.
PAST_ASCII = r"[^\x00-\x7F]"


def sub(text: Column, pattern: str, to: str = "", ignore_case: bool = False) -> Column:
    """Replace all matches; \\s, \\d and case follow Unicode. `to` may use $1."""
    return F.regexp_replace(text, F.lit(f"(?U{'i' if ignore_case else ''})" + pattern), F.lit(to))


def subs(text: Column, rules: list[tuple[str, str]] | tuple[tuple[str, str], ...], ignore_case: bool = False) -> Column:
    return reduce(lambda c, r: sub(c, r[0], r[1], ignore_case), rules, text)


def literals(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Ordered literal replacements; an empty text to look for changes nothing."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])) if r[0] else c, rules, text)


def removed(text: Column, tokens: tuple[str, ...]) -> Column:
    return literals(text, tuple((t, "") for t in tokens))


def squeeze(text: Column) -> Column:
    """White space runs of any kind as one blank, none at the ends. Line feeds become blanks without a pattern; single blanks, which most then are, are left as they are."""
    runs = lambda t: F.contains(t, F.lit("  ")) | F.regexp_like(t, F.lit(r"(?U)[\s&&[^ ]]"))
    return F.trim(guarded(F.replace(text, F.lit("\n"), F.lit(" ")), runs, lambda t: sub(t, r"(?: \s|[^\S ])\s*+", " ")))


def past_ascii(text: Column) -> Column:
    """Whether there is any character past ASCII."""
    return F.octet_length(text) > F.length(text)


def contains_any(text: Column, *parts: str) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def one_of(characters: str) -> str:
    """A class of these characters, for a pattern."""
    return "[" + "".join(rf"\x{{{ord(c):x}}}" for c in characters) + "]"


def holds(text: Column, characters: str) -> Column:
    """Whether any of the characters is in the text."""
    plain, rest = [c for c in characters if ord(c) < 128], "".join(c for c in characters if ord(c) > 127)
    looks = [F.contains(text, F.lit(c)) for c in plain]
    if rest:
        looks.append(past_ascii(text) & F.regexp_like(text, F.lit(f"[{PAST_ASCII}&&{one_of(rest)}]")))
    return reduce(lambda a, b: a | b, looks)


def dropped(text: Column, characters: str) -> Column:
    """Without any of these characters."""
    plain, rest = "".join(c for c in characters if ord(c) < 128), "".join(c for c in characters if ord(c) > 127)
    text = F.regexp_replace(text, one_of(plain), "") if plain else text
    return guarded(text, past_ascii, lambda t: F.regexp_replace(t, f"[{PAST_ASCII}&&{one_of(rest)}]", "")) if rest else text


def translated(text: Column, characters: str, to: str) -> Column:
    """F.translate, which goes character by character, only for texts that hold any of the characters."""
    return guarded(text, lambda t: holds(t, characters), lambda t: F.translate(t, characters, to))


def words_ws(text: Column) -> Column:
    """Tokens between white space of any kind."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def words_space(text: Column) -> Column:
    """Tokens between blanks alone."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def let(value: Column, body) -> Column:
    """body(value), with the value worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def guarded(text: Column, test, change) -> Column:
    """change(text) where test(text) holds: a cheap look spares most texts a chain of patterns."""
    return let(text, lambda t: F.when(test(t), change(t)).otherwise(t))


def map_matches(text: Column, pattern: str, change, groups: tuple[int, ...] = (0,), look: str = "") -> Column:
    """Each match of pattern replaced by change(its groups), in one pass from left to right. look: a cheaper pattern, found in all texts that have a match.

    The text between matches comes from a split by the same pattern, so lookarounds see the whole text."""
    rx = F.lit("(?U)" + pattern)

    def replaced(t: Column) -> Column:
        found = [F.regexp_extract_all(t, rx, F.lit(g)) for g in groups]
        new = F.transform(F.arrays_zip(*(f.alias(f"g{g}") for f, g in zip(found, groups, strict=True))), lambda m: change(*(m[f"g{g}"] for g in groups)))
        # A split drops nothing with limit -1: there is one part more than there are matches.
        return F.array_join(F.zip_with(F.split(t, "(?U)" + pattern, -1), F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    some = lambda t: F.regexp_like(t, F.lit("(?U)" + look)) & F.regexp_like(t, rx) if look else F.regexp_like(t, rx)
    return let(text, lambda t: F.when(some(t), replaced(t)).otherwise(t))
