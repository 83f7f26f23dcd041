"""Numbers inside strings, on the JVM. Rounding is half up on the decimal form, where Python rounds the binary value half to even."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.regex import NO_DIGITS, PAIR, W, let, map_matches, past_ascii
from tessella.functions.rules import FRACTION_TOLERANCE, FRACTIONS_4


#: Decimal digits of all scripts but ASCII's, with their values.
_DIGITS = [(chr(i), str(unicodedata.decimal(chr(i)))) for i in range(128, sys.maxunicode + 1) if unicodedata.decimal(chr(i), None) is not None]


def _value(digits: Column) -> Column:
    """A number in digits of any script."""
    plain = F.translate(digits, "".join(d for d, _ in _DIGITS), "".join(v for _, v in _DIGITS))
    return F.when(past_ascii(digits), plain).otherwise(digits).cast("double")


def _trimmed(text: Column) -> Column:
    """Without trailing zeros of a decimal and then its point."""
    return F.when(F.contains(text, F.lit(".")), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def general(x: Column) -> Column:
    """Like %g: six significant digits, no trailing zeros, exponents from 1e6."""
    return let(x, _general)


def _general(x: Column) -> Column:
    size = F.abs(x)
    whole = F.length(F.floor(size).cast("string"))
    fixed = F.coalesce(*(F.when(whole == k, F.format_string(f"%.{6 - k}f", F.round(x, 6 - k))) for k in range(1, 7)))
    power = F.format_string("%.5e", x)
    exponent = F.concat(_trimmed(F.substring_index(power, "e", 1)), F.lit("e"), F.substring_index(power, "e", -1))
    return F.when(x == 0, F.lit("0")).when(size < 1e6, _trimmed(fixed)).otherwise(exponent)


def fractions_to_decimals(text: Column) -> Column:
    """`3 / 4` becomes 0.75, four decimals at most; a denominator of 0 leaves the text."""

    def change(whole: Column, n: Column, d: Column) -> Column:
        num, den = _value(n), _value(d)
        return F.when(den == 0, whole).otherwise(general(F.round(num / F.when(den == 0, 1.0).otherwise(den), 4)))

    return map_matches(text, r"(\d+)\s?/\s?(\d+)", change, (0, 1, 2), "/")


def fold_additions(text: Column) -> Column:
    """`a + b` becomes the sum, four decimals at most, from left to right without overlap."""
    number = r"(\d+(?:\.\d+)?)"
    return map_matches(text, rf"{number}\s*\+\s*{number}", lambda a, b: general(F.round(_value(a) + _value(b), 4)), (1, 2), r"\+")


def _near(whole: Column, part: Column, value: Column, table: tuple) -> Column:
    """The whole number with the decimal of the nearest known fraction, if that is near enough; else five decimals."""
    options = F.array(*(F.struct(F.abs(part - F.lit(v)).alias("d"), F.lit(i).alias("i"), F.lit(t).alias("t")) for i, (v, t) in enumerate(table)))

    def spell(best: Column) -> Column:
        joined = F.when(whole == 0, best["t"]).otherwise(F.concat(whole.cast("string"), F.substr(best["t"], F.lit(2))))
        return F.when(best["d"] <= FRACTION_TOLERANCE, joined).otherwise(_trimmed(F.format_string("%.5f", value)))

    return let(F.array_min(options), spell)


def canonical_decimals(text: Column, table: tuple = FRACTIONS_4, floor_slack: float = 1e-12) -> Column:
    """Decimals of four places or more in the spelling of the nearest known fraction."""

    def change(m: Column) -> Column:
        x = _value(m)
        whole = F.floor(x + floor_slack)
        return _near(whole, x - whole, x, table)

    return map_matches(text, rf"(?<![{W}{PAIR}/])(\d+\.\d{{4,}})(?![{W}/])", change, (1,), rf"\.[^{NO_DIGITS}]{{4}}")


def canonical_sums(text: Column, table: tuple = FRACTIONS_4) -> Column:
    """`3 + 0.3333` as 3.3333."""

    def change(a: Column, b: Column) -> Column:
        whole, part = _value(a), _value(b)
        return _near(F.floor(whole), part, whole + part, table)

    return map_matches(text, rf"(?<![{W}{PAIR}/])(\d+)\s*\+\s*(0\.\d{{4,}})(?![{W}/])", change, (1, 2), r"\+\s*0\.")
