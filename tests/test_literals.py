"""Written lists against Python's own reading of them."""

import ast
import hashlib
import re

from pyspark.sql import functions as F

from tessella.functions import text
from tessella.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def read(value):
    value = (value or "").strip()
    if not value:
        return []
    try:
        parsed = ast.literal_eval(value)
    except Exception:
        return [value]
    return [str(x).strip() for x in (parsed if isinstance(parsed, list) else [parsed]) if str(x).strip()]


def test_list_literals(spark):
    cases = ["", None, "  ", "[]", "['a', 'b']", """["it's", 'say "x"', 'a, b', '[c]']""", r"['it\'s', 'back\\slash', 'a\\', 'n\nl']", "['a' , 3, -7,]", "'one'", "plain words", "['open", "['a' 'b", "[a, b]", "['', ' x ']", "5", "['" + "z" * 200_000 + "', 'y']", "[" + ", ".join(f"'v{i}'" for i in range(3000)) + "]"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string").repartition(1)
    got = {r.i: r.v for r in df.select("i", text.list_literal(F.col("t")).alias("v")).collect()}
    assert got == {i: read(c) for i, c in enumerate(cases)}


def test_quoted_vocabulary(spark):
    def quoted(t):
        out = {}
        for q in re.findall(r'"([^"]+)"', t):
            for c in q.split(","):
                c = " ".join(re.sub(r"[!?]", " ", re.sub(r"\([^)]*\)", " ", c)).split())
                if c:
                    out.setdefault(c)
        return list(out)

    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        t = (r.text or "").replace(" the ", ' "Silver, tin (of a kind)!" ').replace(" of ", ' "it\'s" ')
        merged = {}
        for v in [x.strip() for x in t.split("\n") if x.strip()] + quoted(t):
            merged.setdefault(v.lower(), v)
        want[r.doc_id] = hashlib.md5(("[" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in merged.values()) + "]").encode()).hexdigest()
    assert {r.doc_id: r.digest for r in QUERIES["quoted_vocabulary"](spark, SMALL).collect()} == want
