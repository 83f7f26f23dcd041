"""Folded text: one form for all spellings that differ in accents, dashes, blanks and case."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


_FOREIGN = re.compile(r"[^\x00-\x7F]+")


def fold(text: str) -> str:
    """N37 as a key: compatibility decomposition without combining marks, plain dashes, one blank, lower case."""
    flat = text or ""
    if not flat.isascii():  # no mark or dash is ASCII
        flat = _FOREIGN.sub(lambda m: "".join(c for c in m[0] if not unicodedata.combining(c)), unicodedata.normalize("NFKD", flat)).replace("—", "-").replace("–", "-")
    return " ".join(flat.split()).lower()


@F.pandas_udf(T.StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: fold(t or ""))
