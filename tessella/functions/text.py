"""Text normalisation as column expressions: one step a function, profiles compose them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import numbers
from tessella.functions import rules as R
from tessella.functions.regex import BREAKS, LEFT, LETTERS, NO_DIGITS, PAIR, PAST_ASCII, RIGHT, W, contains_any, dropped, guarded, holds, let, literals, one_of, past_ascii, removed, squeeze, sub, subs, translated, words_ws

_MARK = "\x00GAP\x00"


def nonnull(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


# --- shared steps -----------------------------------------------------------------------------------------
def strip_angles(text: Column, keep_big: bool = False) -> Column:
    """Without < and > but in gap tokens; a big gap becomes a gap unless kept."""
    text = F.replace(text, F.lit("<big_gap>"), F.lit("\x00BIG\x00" if keep_big else _MARK))
    text = F.replace(text, F.lit("<gap>"), F.lit(_MARK))
    text = removed(text, ("<", ">"))
    text = F.replace(text, F.lit(_MARK), F.lit("<gap>"))
    return F.replace(text, F.lit("\x00BIG\x00"), F.lit("<big_gap>")) if keep_big else text


def hyphenate_gaps(text: Column) -> Column:
    return subs(text, ((r"(?<=[^\s-])<gap>", "-<gap>"), (r"<gap>(?=[^\s-])", "<gap>-")))


def _some_accents(text: Column) -> Column:
    return contains_any(text, *"2₂3₃") & F.regexp_like(text, F.lit(f"[{R.VOWELS[0]}][2₂3₃]"))


def diacritics(text: Column, drop_question: bool = False) -> Column:
    """sz, s, and t, as š, ṣ, ṭ; a vowel before 2 or 3 with its accent."""
    text = literals(text, R.SIBILANTS)
    text = F.replace(text, F.lit("?"), F.lit("")) if drop_question else text
    rules = tuple((f"{v}[{digit}]", a) for digit, accented in (("2₂", R.VOWELS[1]), ("3₃", R.VOWELS[2])) for v, a in zip(R.VOWELS[0], accented, strict=True))
    return guarded(text, _some_accents, lambda t: subs(t, rules))


def drop_line_numbers(text: Column) -> Column:
    n = r"\d+'?"
    # What a match begins with is looked for before what must not stand in front of it.
    at = r"(?=[\\\r\n])"
    text = sub(text, rf"{at}{R.LINE_BREAK}\s*{n}\s*-\s*{n}\s*", " ")
    text = guarded(text, lambda t: F.regexp_like(t, F.lit(r"(?U)-(?=\s*\d)")), lambda t: sub(t, rf"(?=\d){LEFT}{n}\s*-\s*{n}\s*", " "))
    return subs(text, ((rf"{at}{R.LINE_BREAK}\s*{n}\s*", " "), (at + R.LINE_BREAK, " ")))


def determinatives(text: Column, full_width: bool = True) -> Column:
    """Up to six capitals in parentheses stand bare, up to four small letters in braces."""
    for a, b in ("()", "（）") if full_width else ("()",):
        rules = ((rf"\{a}([{R.UPPER}0-9]{{1,6}})\{b}", "$1"), (rf"\{a}([{R.LOWER}]{{1,4}})\{b}", "{$1}"))
        text = guarded(text, lambda t, a=a: F.contains(t, F.lit(a)), lambda t, rules=rules: subs(t, rules))
    return text


def _but(most: str) -> str:
    """The plain letters without some."""
    return "".join(c for c in LETTERS if c not in most)


#: Looks for what steps begin with, behind a character that stands alone as it is rare: an x for a sign or big, a word of grammar, a month, and a decimal.
_NO_LETTER = rf"(?<![{LETTERS}].)"
_SIGN = rf"(?![{_but('xXbBiI')}]|[iI][{_but('gG')}])"
_GRAMMAR = rf"(?Ui:em|ing|l(?:ural)?)\.?(?![{LETTERS}])"
_DECIMAL = rf"[^{NO_DIGITS}]{{4}}"
_GAP_MARKS = ("<", "[", "(", "…", "...")


def unify_gaps(text: Column, broken_line: bool = True) -> Column:
    ways = "|".join((*R.GAPS, R.GAP_BROKEN_LINE) if broken_line else R.GAPS)
    # Each way begins with one of these; an x that stands for a sign, and big, with no word in front.
    some = lambda t: contains_any(t, *_GAP_MARKS) | F.regexp_like(t, F.lit(rf"[xXbB]{_NO_LETTER}{_SIGN}"))
    pattern = rf"(?-i:(?=[<.…\[(]|[xX](?![a-wyzA-WYZ])|[bB](?![a-hj-zA-HJ-Z]))(?<![a-zA-Z](?=[xXbB])))(?:{ways})"
    return guarded(text, some, lambda t: sub(t, pattern, "<gap>", ignore_case=True))


def collapse_gaps(text: Column) -> Column:
    """A cluster of gaps, hyphens around it included, as one gap between blanks."""
    return guarded(text, lambda t: F.regexp_like(t, F.lit(r"(?U)<gap>[\s-]++<gap>")), lambda t: sub(t, r"-?\s*<gap>(?:[\s-]++<gap>)+\s*-?", " <gap> "))


def collapse_gaps_simple(text: Column) -> Column:
    return guarded(text, lambda t: F.contains(t, F.lit("<gap>")), lambda t: sub(t, r"(?:<gap>\s*){2,}", "<gap>"))


def hyphen_spacing(text: Column) -> Column:
    return guarded(text, lambda t: F.contains(t, F.lit("-")), lambda t: subs(t, ((r"-(?<=\S-)\s+(?=\S)", "-"), (r"(^|\s)-(?=\s|$)", "$1"))))


def characters(text: Column) -> Column:
    return translated(text, R.CHARACTERS[0], R.CHARACTERS[1])


def fraction_signs(text: Column, skip: tuple[str, ...] = ()) -> Column:
    return guarded(text, lambda t: F.contains(t, F.lit("0.")), lambda t: literals(t, tuple(r for r in R.FRACTION_SIGNS if r[0] not in skip)))


def commodities(text: Column) -> Column:
    some = lambda t: reduce(lambda a, b: a | b, (F.contains(t, F.lit(f"-{k}")) for k, _ in R.COMMODITIES))
    return guarded(text, some, lambda t: subs(t, tuple((rf"(?<=\s)-{k}{RIGHT}", v) for k, v in R.COMMODITIES)))


def shekels(text: Column) -> Column:
    return guarded(text, lambda t: F.contains(t, F.lit("/")) & F.regexp_like(t, F.lit(r"(?U)/\s*12")), lambda t: subs(t, R.SHEKELS, True))


def grammar_notes(text: Column) -> Column:
    text = guarded(text, lambda t: F.contains(t, F.lit("(")), lambda t: sub(t, R.GRAMMAR_NOTES, " ", True))
    text = guarded(text, lambda t: F.regexp_like(t, F.lit(rf"[fFpPsSſ]{_NO_LETTER}{_GRAMMAR}")), lambda t: sub(t, rf"(?=[fpsſ]){LEFT}{R.GRAMMAR_WORDS}{RIGHT}\s*", " ", True))
    return F.replace(text, F.lit("(?)"), F.lit(""))


def stray_marks(text: Column, big_gap: bool = True) -> Column:
    keep = rf"(?!/?(?:big_gap|gap){RIGHT})" if big_gap else rf"(?!gap{RIGHT})"
    text = guarded(text, lambda t: F.contains(t, F.lit("<")), lambda t: sub(t, rf"<<[^>]*>>|<{keep}[^>]*>"))
    text = guarded(text, lambda t: contains_any(t, "..", "xx"), lambda t: sub(t, rf"(?=\.\.|xx){LEFT}(?:\.\.+|xx+){RIGHT}"))
    text = guarded(text, lambda t: F.contains(t, F.lit("/")), lambda t: sub(t, r"(?<![0-9/])\s+/\s+(?![0-9])\S+"))
    return translated(text, "“”‘’", "\"\"''")


def roman_months(text: Column) -> Column:
    return guarded(text, lambda t: F.regexp_like(t, F.lit("[mM][oO][nN][tT][hH]")), lambda t: subs(t, tuple((rf"{LEFT}Month\s+{r}{RIGHT}", f"Month {n}") for r, n in R.ROMAN), True))


def _repeats(text: Column, word: str, apart: str, blank: str) -> Column:
    """Repeats of a word, then of four, three and two words, once, by the classes of characters in words, in none, and between them. The text begins with a blank."""
    # A word gives nothing back: what follows its parts is a letter, never a blank.
    w, s, end = f"{word}++", f"{blank}++", f"(?!{word})"
    once = lambda t, run: F.regexp_replace(t, rf"(?<={apart})({run})(?:{s}\1{end})++", "$1")
    # Of a repeat of two to four words the first two stand again, two to four words on.
    again = rf"\1{s}\2{end}"
    some = f"{apart}({w}){s}({w}){s}(?:{again}|{w}{s}(?:{again}|{w}{s}{again}))"
    return guarded(once(text, w), lambda t: F.regexp_like(t, F.lit(some)), lambda t: reduce(lambda c, n: once(c, f"{(w + s) * (n - 1)}{w}"), (4, 3, 2), t))


def repeated_words(text: Column) -> Column:
    """Repeats of a word, then of four, three and two words, once."""
    plain = lambda t: ~past_ascii(t) | ~F.regexp_like(t, F.lit(rf"[{PAST_ASCII}&&[^\p{{L}}\p{{N}}]]"))
    # Where all characters past ASCII are letters or numbers, a word is what ASCII's other characters leave.
    either = lambda t: F.when(plain(t), _repeats(t, f"[^{BREAKS}]", f"[{BREAKS}]", r"[ \t\n\x0b\f\r]")).otherwise(_repeats(t, f"[{W}]", f"[^{W}{PAIR}]", r"\p{IsWhite_Space}"))
    return F.substr(let(F.concat(F.lit(" "), text), either), F.lit(2))


def punctuation(text: Column) -> Column:
    some = lambda t: F.regexp_like(t, F.lit(r"(?U)[.,:](?<=[\s.,].)"))
    return guarded(text, some, lambda t: subs(t, ((r"\s+([.,:])", "$1"), (r"([.,])\1++", "$1"))))


def plus_usage(text: Column) -> Column:
    """Blanks around a numeric + go; other + become a hyphen between characters or go."""
    n = R.NUMERIC_PLUS
    token = rf"[{n}]+(?:\.[0-9]+)?"
    rules = ((rf"({token})\s*\+\s*({token})", "$1+$2"), (r"-\s*\++", "-"), (r"\++\s*-", "-"), (rf"(?<=[^\s{n}])\+(?=[^\s{n}])", "-"), (rf"(?<![{n}])\+|\+(?![{n}])", ""))
    return guarded(text, lambda t: F.contains(t, F.lit("+")), lambda t: subs(t, rules))


# --- profiles ---------------------------------------------------------------------------------------------
@dataclass(frozen=True)
class Profile:
    """What differs between the second profile and those of inference."""

    line_numbers: bool = True
    drop_question: bool = True
    full_width: bool = True
    broken_line: bool = True
    fractions: tuple = R.FRACTIONS_4
    floor_slack: float = 1e-12
    sums: bool = True
    cluster: bool = True
    big_gap: bool = True
    forbidden: str = R.V2_FORBIDDEN
    skip_signs: tuple[str, ...] = ()
    drop_comma: bool = False
    plus_policy: bool = False
    removals: bool = True
    alphabet: str = ""
    fallback: tuple = ()


V2 = Profile()
INFER = Profile(line_numbers=False, drop_question=False, full_width=False, broken_line=False, fractions=R.FRACTIONS_5, sums=False, cluster=False, big_gap=False, forbidden=R.INFER_FORBIDDEN, removals=False)
SIMPLE = Profile(**{**INFER.__dict__, "skip_signs": ("0.625", "0.75"), "forbidden": R.SIMPLE_FORBIDDEN, "alphabet": R.SIMPLE_ALPHABET, "fallback": R.SIMPLE_FALLBACK})
BEST = Profile(**{**INFER.__dict__, "forbidden": R.BEST_FORBIDDEN, "drop_comma": True, "plus_policy": True})
PROFILES = {"v2": V2, "infer": INFER, "simple": SIMPLE, "best": BEST}


def _numbers(text: Column, p: Profile) -> Column:
    text = fraction_signs(text, p.skip_signs)
    text = numbers.canonical_decimals(text, p.fractions, p.floor_slack)
    if p.sums:
        text = F.replace(numbers.canonical_sums(text, p.fractions), F.lit("lá+lá"), F.lit("lá-lá"))
    return text


def _source_head(text: Column, p: Profile) -> Column:
    """The steps up to the numbers."""
    text = drop_line_numbers(text) if p.line_numbers else text
    text = determinatives(diacritics(text, p.drop_question), p.full_width)
    text = F.replace(characters(unify_gaps(text, p.broken_line)), F.lit("ₓ"), F.lit(""))
    return F.replace(text, F.lit("KÙ.B."), F.lit("KÙ.BABBAR"))


def _source_tail(text: Column, p: Profile) -> Column:
    """The steps behind the numbers."""
    text = F.replace(text, F.lit(","), F.lit("")) if p.drop_comma else text
    text = plus_usage(text) if p.plus_policy else text
    if p.removals:
        text = collapse_gaps(strip_angles(removed(text, R.V2_SOURCE_REMOVED)))
        text = hyphen_spacing(collapse_gaps(literals(text, tuple((s, " ") for s in R.SEPARATORS))))
    return squeeze(text)


def normalize_source(text: Column, profile: Profile | str = V2) -> Column:
    p = PROFILES[profile] if isinstance(profile, str) else profile
    return _source_tail(_numbers(_source_head(nonnull(text), p), p), p)


def _target_head(text: Column, p: Profile) -> Column:
    """The steps up to the numbers."""
    text = literals(drop_line_numbers(text), R.TARGET_FIXES) if p.line_numbers else text
    text = guarded(unify_gaps(text, p.broken_line), lambda t: F.contains(t, F.lit("PN")), lambda t: sub(t, rf"PN(?<![{W}{PAIR}]PN){RIGHT}", "<gap>"))
    return shekels(commodities(text))


def _target_notes(text: Column, p: Profile) -> Column:
    """The steps from the numbers to the forbidden characters; gaps are marks then."""
    text = roman_months(stray_marks(grammar_notes(text), p.big_gap))
    text = collapse_gaps(text) if p.cluster else collapse_gaps_simple(text)
    return F.replace(text, F.lit("<gap>"), F.lit(_MARK))


def _target_words(text: Column, p: Profile) -> Column:
    """The forbidden characters and the steps behind them, up to repeated words."""
    text = dropped(text, "".join(dict.fromkeys(p.forbidden)))
    text = guarded(F.replace(text, F.lit(_MARK), F.lit(" <gap> ")), past_ascii, lambda t: literals(t, (("ḫ", "h"), ("Ḫ", "H"))))
    text = allowed_alphabet(text, p.alphabet, p.fallback) if p.alphabet else text
    return repeated_words(text)


def _target_tail(text: Column, p: Profile) -> Column:
    """The steps behind repeated words."""
    text = punctuation(text)
    if p.removals:
        text = hyphen_spacing(collapse_gaps(strip_angles(text)))
    return squeeze(text)


def normalize_target(text: Column, profile: Profile | str = V2) -> Column:
    p = PROFILES[profile] if isinstance(profile, str) else profile
    return _target_tail(_target_words(_target_notes(_numbers(_target_head(nonnull(text), p), p), p), p), p)


def _target_some(text: Column) -> Column:
    """Whether any step of inference up to the forbidden characters finds something in a target: all their looks in few."""
    own = rf"(?<=[xXbB]){_SIGN}|(?<=[fFpPsS]){_GRAMMAR}|(?<=[mM])[oO][nN][tT][hH]"
    look = F.regexp_like(text, F.lit(rf"[.xXbBfFpPsSmM<\[(/](?:{_NO_LETTER}(?:{own})|(?<=\.){_DECIMAL}|(?<=[<\[(/]))"))
    return contains_any(text, "..", "xx", "PN", "0.", *(f"-{k}" for k, _ in R.COMMODITIES)) | holds(text, "…“”‘’ſ") | look


def _source_some(text: Column, target: Column) -> Column:
    """Whether any step of inference up to the numbers finds something in a source, sibilants apart; target: whether one does in a target. Gaps and numbers are
    looked for there too, and a sibilant, a letter for a letter and what follows, makes none of what is looked for."""
    return target | F.contains(text, F.lit("KÙ.B.")) | _some_accents(text) | holds(text, R.CHARACTERS[0] + "ₓ")


def _plain_lines(text: Column) -> Column:
    """Whether line feeds, each behind a mark, are all that the alphabet takes from a text that no profile changes else. No repeat goes over a mark, so they may go before or behind repeats."""
    kept = [c for c in SIMPLE.alphabet if ord(c) < 128 and c not in BEST.forbidden]
    marks = one_of("".join(c for c in kept if not (c.isalnum() or c in "_ ")))
    return ~past_ascii(text) & ~F.regexp_like(text, F.lit(f"[^{one_of(''.join(kept))[1:-1]}](?<!{marks}\n)"))


def inference(text: Column) -> Column:
    """struct of source and target in the three profiles of inference, as `normalize_source` and `normalize_target` give them. What the profiles share is done
    once: their steps are the same up to the numbers, where one leaves two signs as decimals, and behind them but for what is said below. A text in which no step
    finds anything goes past them."""

    def forms(head: Column, behind) -> Column:
        """A text behind the numbers: as two of the profiles have it, and as the third."""
        first = behind(_numbers(head, INFER), INFER)
        return let(first, lambda n: F.struct(n.alias("n"), F.when(contains_any(head, *SIMPLE.skip_signs), behind(_numbers(head, SIMPLE), SIMPLE)).otherwise(n).alias("simple")))

    def sources(f: Column) -> Column:
        simple = lambda infer: F.when(f["simple"] == f["n"], infer).otherwise(_source_tail(f["simple"], SIMPLE))
        # Without a plus, the third takes commas only, so that there are blanks alone to squeeze again.
        best = lambda infer: F.when(F.contains(f["n"], F.lit("+")), _source_tail(f["n"], BEST)).otherwise(F.trim(blanks(F.replace(infer, F.lit(","), F.lit("")))))
        blanks = lambda text: guarded(text, lambda t: F.contains(t, F.lit("  ")), lambda t: F.regexp_replace(t, "  ++", " "))
        tail = lambda infer: F.struct(infer.alias("infer"), simple(infer).alias("simple"), best(infer).alias("best"))
        return let(_source_tail(f["n"], INFER), tail)

    def targets(f: Column) -> Column:
        # Two profiles differ by characters that one of them forbids, the third by its alphabet.
        more = "".join(set(INFER.forbidden) ^ set(BEST.forbidden))
        whole = lambda n, p: _target_tail(_target_words(n, p), p)
        lines = lambda words: F.when(_plain_lines(f["n"]) & (f["n"] == f["simple"]), _target_tail(F.replace(words, F.lit("\n"), F.lit("")), SIMPLE)).otherwise(whole(f["simple"], SIMPLE))
        tail = lambda words, best: F.struct(F.when(holds(f["n"], more), whole(f["n"], INFER)).otherwise(best).alias("infer"), lines(words).alias("simple"), best.alias("best"))
        return let(_target_words(f["n"], BEST), lambda words: let(_target_tail(words, BEST), lambda best: tail(words, best)))

    as_it_is = lambda t: F.struct(t.alias("n"), t.alias("simple"))
    source = lambda t, some: F.when(_source_some(t, some), let(_source_head(t, INFER), lambda h: forms(h, lambda n, _: n))).otherwise(let(literals(t, R.SIBILANTS), as_it_is))
    target = lambda t, some: F.when(some, let(_target_head(t, INFER), lambda h: forms(h, _target_notes))).otherwise(as_it_is(t))
    both = lambda t, some: F.struct(let(source(t, some), sources).alias("source"), let(target(t, some), targets).alias("target"))
    sides = let(nonnull(text), lambda t: let(_target_some(t), lambda some: both(t, some)))
    return let(sides, lambda s: F.struct(*(s[side][p].alias(f"{side}_{p}") for p in ("infer", "simple", "best") for side in ("source", "target"))))


def allowed_alphabet(text: Column, alphabet: str = R.SIMPLE_ALPHABET, fallback: tuple[tuple[str, str], ...] = R.SIMPLE_FALLBACK) -> Column:
    """Fallback spellings first, then everything outside the alphabet goes."""
    one = [r for r in fallback if len(r[1]) == 1]
    spelled = lambda t: literals(F.translate(t, "".join(a for a, _ in one), "".join(b for _, b in one)) if one else t, tuple(r for r in fallback if len(r[1]) != 1))
    text = guarded(text, lambda t: holds(t, "".join(a[0] for a, _ in fallback)), spelled) if fallback else text
    plain = "".join(chr(i) for i in range(128) if chr(i) not in alphabet)
    rest = "".join(rf"\x{{{ord(c):x}}}" for c in alphabet if ord(c) > 127)
    text = dropped(text, plain) if plain else text
    return guarded(text, past_ascii, lambda t: F.regexp_replace(t, f"[{PAST_ASCII}&&[^\\x00{rest}]]", ""))


_PUNCT = ",:.?!"


def map_words(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Whole tokens replaced; punctuation at a token's ends is peeled off and put back behind what comes before it."""
    table = F.create_map(*(F.lit(x) for pair in dict(rules).items() for x in pair))
    marks = F.lit(_PUNCT)

    # Punctuation joins the part before it, whatever part that is; a core is a part of its own. A token of punctuation alone has no core.
    def piece(x: Column, i: Column) -> Column:
        lead = F.substr(x["t"], F.lit(1), F.length(x["t"]) - F.length(F.ltrim(x["t"], marks)))
        trail = F.substr(x["t"], F.length(F.rtrim(x["t"], marks)) + 1)
        core = F.coalesce(F.try_element_at(table, x["core"]), x["core"])
        plain = F.when(i > 0, F.concat(F.lit(" "), core)).otherwise(core)
        marked = F.concat(lead, F.when((i > 0) | (lead != ""), F.lit(" ")).otherwise(F.lit("")), core, trail)
        return F.when(x["core"] == x["t"], plain).when(x["core"] == "", x["t"]).otherwise(marked)

    return F.array_join(F.transform(F.transform(words_ws(text), lambda t: F.struct(t.alias("t"), F.btrim(t, marks).alias("core"))), piece), "")


def _clean_v1(text: Column, patterns: tuple, words: tuple, replaced: tuple, gone: tuple) -> Column:
    text = numbers.fold_additions(numbers.fractions_to_decimals(squeeze(nonnull(text))))
    text = literals(map_words(subs(text, patterns), words), replaced)
    return squeeze(hyphenate_gaps(removed(strip_angles(text, keep_big=True), gone)))


def clean_source_v1(text: Column) -> Column:
    return _clean_v1(text, ((R.BROKEN_LINES, "<gap>"),), R.V1_SOURCE_WORDS, R.V1_SOURCE_LITERALS, R.V1_SOURCE_REMOVED)


def clean_target_v1(text: Column) -> Column:
    return _clean_v1(text, R.V1_TARGET_PATTERNS, R.V1_TARGET_WORDS, R.V1_TARGET_LITERALS, R.V1_TARGET_REMOVED)


# --- spellings and names ----------------------------------------------------------------------------------
def normalize_spelling(text: Column) -> Column:
    """Gap forms as <gap>, other tags gone, the left of slash alternatives, no brackets."""
    text = F.trim(nonnull(text))
    text = subs(text, ((r"<\s*big_gap\s*>", "<gap>"), (r"\[\s*x\s*\]", "<gap>"), (r"⌈\s*x\s*⌉", "<gap>"), (r"(?:\.{3,}|…+)", "<gap>"), (r"<(?!\s*gap\s*>)[^>]*>", "")), True)
    text = sub(text, r"([^/\s;]+?)(?:/[^/\s;]+)+", "$1")
    return squeeze(sub(F.translate(text, "[]⌈⌉()", ""), r"(?:<gap>\s*){2,}", "<gap> ", True))


def normalize_field(text: Column, each=normalize_spelling, sep: str = ";") -> Column:
    """Each of the values between separators normalised, blanks and later repeats gone."""
    return F.array_join(F.array_distinct(F.filter(F.transform(F.split(nonnull(text), sep), each), lambda x: x != "")), "; ")


def match_key(text: Column) -> Column:
    """The form in which spellings are compared."""
    text = determinatives(diacritics(normalize_spelling(text)), full_width=False)
    text = F.replace(characters(text), F.lit("ₓ"), F.lit(""))
    text = fraction_signs(F.replace(text, F.lit("KÙ.B."), F.lit("KÙ.BABBAR")))
    text = numbers.canonical_decimals(text, R.FRACTIONS_5, 0.0)
    return F.lower(squeeze(plus_usage(F.replace(text, F.lit(","), F.lit("")))))


def folds_equal(a: Column, b: Column) -> Column:
    """Equal but for case and accents."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")


def folds_contain(a: Column, b: Column) -> Column:
    return F.contains(F.collate(a, "UNICODE_CI_AI"), F.collate(b, "UNICODE_CI_AI"))


def name_variants(text: Column) -> Column:
    """Names between newlines, ; and |, of two characters or more."""
    return F.filter(F.transform(F.split(nonnull(text), r"\n|;|\|"), squeeze), lambda x: F.length(x) > 1)


def source_for_model(text: Column, merge_h: bool = True, subscripts: bool = True, breaks: bool = True, editorial: bool = True, dividers: bool = True) -> Column:
    """Switches of the byte model's source side."""
    text = nonnull(text)
    text = F.translate(text, "ḫḪ", "hH") if merge_h else text
    text = F.translate(text, R.SUBSCRIPTS[0] + "ₓ", R.SUBSCRIPTS[1] + "x") if subscripts else text
    text = subs(text, ((r"\[\s*x\s*\]", "<gap>"), (r"\[?\s*(?:…|\.\.\.)+\s*\]?", "<big_gap>"), (r"\[([^\]]*)\]", "$1"))) if breaks else text
    text = F.translate(text, "!?⌈⌉˹˺", "") if editorial else text
    text = F.translate(text, "/:", "  ") if dividers else text
    return squeeze(F.replace(text, F.lit(" "), F.lit(" ")))


# --- small steps ------------------------------------------------------------------------------------------
def clean_segment(text: Column) -> Column:
    """No backslash or double quote; ending ! and ? as a full stop, others gone."""
    text = F.trim(F.translate(nonnull(text), '\\"', ""))
    return F.translate(F.regexp_replace(text, r"[!?]+$", "."), "!?", "")


def repair_glyphs(text: Column) -> Column:
    return F.regexp_replace(literals(nonnull(text), (("{", "i"), ("!Star", "IStar"))), r"^1-", "I-")


def fix_apostrophes(text: Column) -> Column:
    return sub(F.translate(nonnull(text), "'’", ""), rf"{LEFT}Puzur-", "Puzur4-")


def blank_markers(text: Column, marker: str = r"^\(?\s*[\divxlc]+\.?\s*\)?$") -> Column:
    return F.when(F.regexp_like(F.trim(nonnull(text)), F.lit("(?i)" + marker)), "").otherwise(text)


def singular(definition: Column) -> Column:
    """The first sense of a definition, without article and plural s."""
    text = F.trim(F.btrim(F.lower(nonnull(definition)), F.lit("\"'“”")))
    text = F.trim(F.regexp_replace(text, r"[,;/()].*$", ""))
    text = reduce(lambda c, a: F.regexp_replace(c, f"^{a} ", ""), ("a", "an", "the"), text)
    return F.regexp_replace(F.trim(text), "s$", "")


def plural(word: Column) -> Column:
    return F.when(F.endswith(word, F.lit("s")), word).otherwise(F.concat(word, F.lit("s")))


def strip_sense(word: Column) -> Column:
    return F.regexp_replace(F.trim(nonnull(word)), r"\s+[IVXLCDM]+$", "")


def hint_text(text: Column, words: int = 4) -> Column:
    """The first words before any ; or (."""
    text = squeeze(F.translate(nonnull(text), " \"", " "))
    text = F.trim(F.substring_index(F.substring_index(text, ";", 1), "(", 1))
    return F.array_join(F.slice(words_ws(text), 1, words), " ")


def clip(text: Column, limit: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.left(text, F.lit(limit - len(mark)))), F.lit(mark))).otherwise(text)


def join_fragments(parts: Column) -> Column:
    """Fragments of a line joined by blanks; a fragment ending in a hyphen takes the next one without."""
    return F.aggregate(
        F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""),
        F.lit(""),
        lambda acc, p: F.when(acc == "", p).when(F.endswith(acc, F.lit("-")), F.concat(F.substr(acc, F.lit(1), F.length(acc) - 1), p)).otherwise(F.concat(acc, F.lit(" "), p)),
    )


def uuid5_url(seed: Column) -> Column:
    """The name-based UUID of a text in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(seed, "UTF-8")))
    variant = F.substr(F.lit("89ab"), (F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4) + 1, F.lit(1))
    cut = lambda a, n: F.substr(h, F.lit(a), F.lit(n))
    return F.concat_ws("-", cut(1, 8), cut(9, 4), F.concat(F.lit("5"), cut(14, 3)), F.concat(variant, cut(18, 3)), cut(21, 12))


def md5_index(seed: Column, n: Column) -> Column:
    """The 128-bit md5 of a text modulo n, by a fold over its hex digits."""
    digits = F.transform(F.split(F.md5(seed), ""), lambda d: F.conv(d, 16, 10).cast("long"))
    return F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0).cast("long"), lambda acc, d: (acc * 16 + d) % n.cast("long"))


def marker_counts(text: Column) -> Column:
    """struct(words, x, ellipsis): tokens after stripping brackets and punctuation, and how many of them mark gaps."""

    def kind(t: Column) -> Column:
        """0: nothing left, 1: a word, 2: dots, 3: x. The pattern is tried where dots begin."""
        marks, inner = F.btrim(t, F.lit("*'\"")), F.btrim(t, F.lit(R.INNER_STRIP))
        dots = (F.startswith(marks, F.lit("...")) | F.startswith(marks, F.lit("…"))) & F.regexp_like(marks, F.lit(r"^(?:\.{3,}|…+)$"))
        return F.when(dots, 2).when((marks == "") | (inner == ""), 0).when(inner == "x", 3).otherwise(1)

    # Two plain letters or digits side by side outlast all stripping: most tokens are words at a look.
    kinds = F.transform(words_ws(nonnull(text)), lambda t: F.when(F.regexp_like(t, F.lit("[A-Za-z0-9]{2}")), 1).otherwise(let(F.btrim(t, F.lit(R.OUTER_STRIP)), kind)))
    count = lambda k, test: F.size(F.filter(k, test))
    return let(kinds, lambda k: F.struct(count(k, lambda x: x > 0).alias("words"), count(k, lambda x: x == 3).alias("x"), count(k, lambda x: x == 2).alias("ellipsis")))


def extract_quoted(text: Column) -> Column:
    """The parts between double quotes, split at commas, without parentheses and ! or ?, each once."""
    found = F.flatten(F.transform(F.regexp_extract_all(nonnull(text), F.lit('"([^"]+)"'), F.lit(1)), lambda q: F.split(q, ",")))
    return F.array_distinct(F.filter(F.transform(found, lambda x: squeeze(F.translate(F.regexp_replace(x, r"\([^()]*\)", " "), "!?", "  "))), lambda x: x != ""))


def merge_ci(a: Column, b: Column) -> Column:
    """Both arrays in order, later repeats but for case left out."""
    ranked = F.array_sort(F.transform(F.concat(a, b), lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = let(ranked, lambda s: F.filter(s, lambda h, j: h["k"].isNull() | (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(h["k"])))
    return F.transform(F.array_sort(F.transform(first, lambda h: F.struct(h["i"].alias("i"), h["x"].alias("x")))), lambda h: h["x"])


_ITEM = r"""(?:'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|-?(?:0|[1-9][0-9]*+))"""
#: What stands for a backslash while the other escapes are read.
_HELD = "\x00"


def _literal(item: Column) -> Column:
    """A quoted string or whole number of a literal as its value."""
    inner = F.replace(F.substr(item, F.lit(2), F.length(item) - 2), F.lit("\\\\"), F.lit(_HELD))
    for written, value in (("\\'", "'"), ('\\"', '"'), ("\\n", "\n"), ("\\t", "\t"), (_HELD, "\\")):
        inner = F.replace(inner, F.lit(written), F.lit(value))
    return F.when(F.regexp_like(item, F.lit("^['\"]")), inner).otherwise(item)


def list_literal(text: Column) -> Column:
    """The values of a list written as ['a', "it's", 3], or of one such value, without those that are blank; quotes of the other kind, commas, brackets and
    escapes inside quotes are text. What is no such literal is one value as it stands; blank text is none. Lists of lists and other values count as text."""
    whole = rf"^(?s)(?:\[\s*+(?:{_ITEM}(?:\s*+,\s*+{_ITEM})*+\s*+,?\s*+)?\]|{_ITEM})$"

    def read(t: Column) -> Column:
        values = F.transform(F.regexp_extract_all(t, F.lit(f"({_ITEM})"), F.lit(1)), lambda x: squeeze_ends(_literal(x)))
        return F.when(t == "", F.array().cast("array<string>")).when(F.regexp_like(t, F.lit(whole)), F.filter(values, lambda x: x != "")).otherwise(F.array(t))

    return let(squeeze_ends(nonnull(text)), read)


def squeeze_ends(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def written_list(values: Column) -> Column:
    """The literal that `list_literal` reads, in single quotes."""
    quoted = F.transform(values, lambda x: F.concat(F.lit("'"), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def with_quoted(existing: Column, source: Column) -> Column:
    """A written list with the quoted words of a source behind its own values, later repeats but for case left out (U6), written again."""
    return written_list(merge_ci(list_literal(existing), extract_quoted(source)))


def prompt(source: Column, hints: Column, task: str = "Translate:", label: str = "Hints") -> Column:
    """The model's input: task, hints if any, source."""
    listed = F.array_join(F.transform(hints, lambda h: F.concat(h["form"], F.lit(" = "), h["hint"])), "; ")
    return F.when(F.size(hints) > 0, F.concat(F.lit(f"{task}\n{label}: "), listed, F.lit("\n"), source)).otherwise(F.concat(F.lit(f"{task}\n"), source))


