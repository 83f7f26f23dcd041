"""Mentions, missing spellings and merged entities against plain Python over regular expressions."""

import random
import re
import unicodedata

import pytest

from tessella.functions.rules import NAME_BOUNDARY
from tessella.operators import entities, mentions
from tessella.operators.folding import fold

SF = "/root/testdata/sf0.01"


def expected(texts, names):
    """(key, entry, surface): folded names by one regular expression, then an own spelling in the text. names: (entry, name)."""
    names = [(e, " ".join(n.split())) for e, n in names if n and n.strip()]
    owner = {}
    for e, n in sorted(names, key=lambda x: x[0]):
        owner[fold(n)] = e
    spellings = {}
    for e, n in names:
        spellings.setdefault(e, set()).add(n)
    keys = sorted(filter(None, owner), key=lambda k: (-len(re.escape(k)), k))
    pattern = re.compile(rf"(?<![{NAME_BOUNDARY}])(?:{'|'.join(map(re.escape, keys))})(?![{NAME_BOUNDARY}])")
    own = {n: re.compile(rf"(?<![{NAME_BOUNDARY}]){re.escape(n)}(?![{NAME_BOUNDARY}])") for _, n in names}
    out = set()
    for k, t in texts:
        if t is None:
            continue
        for e in {owner[m.group(0)] for m in pattern.finditer(f" {fold(t)} ")}:
            found = [n for n in spellings[e] if own[n].search(f" {t} ")]
            if found:
                out.add((k, str(e), max(found, key=lambda n: (len(n), n))))
    return out


HAND = [
    (1, "Aa son of Bb son of Cc paid"), (2, "he paid one mina"), (3, "he paid one Mina"), (4, "Su-Kubum and Šu-Kūbum"), (5, "MINA-x, Mina"), (6, None), (7, ""),
    (8, "aa Bb  Cc"), (9, "Bb — Cc; 3.5 ša.[x]"), (10, "Aa-Bb Bb-"), (11, "x" * 50_000 + " Mina"),
]
NAMES = [(1, "Aa son of Bb son of Cc"), (1, "Aa"), (2, "Mina"), (3, "Šu-Kūbum"), (4, "Su-Kubum"), (5, "Bb"), (6, "Bb - Cc"), (6, "Bb — Cc"), (7, "ša.[x]"), (8, "Bb"), (9, ""), (9, None), (9, "  ")]


@pytest.mark.parametrize("block", [200_000, 3])
def test_mentions_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(mentions, "BLOCK", block)
    docs, names = spark.createDataFrame(HAND, "d long, t string"), spark.createDataFrame(NAMES, "e long, n string")
    got = {(r.d, r.e, r.n) for r in mentions.mentions(docs, names, "d", "t", "e", "n").collect()}
    assert got == expected(HAND, NAMES)
    assert {(1, "1", "Aa son of Bb son of Cc"), (3, "2", "Mina"), (11, "2", "Mina")} <= got and not {r for r in got if r[0] == 2}


def test_mentions_of_any_length_in_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    rng = random.Random(4)
    words = [(t or "").split() for _, t in texts]
    names = []
    for i in range(400):
        w = rng.choice([w for w in words if len(w) > 10])
        n = i % 8 + 1
        at = rng.randrange(len(w) - 8)
        name = " ".join(w[at : at + n])
        names += [(i, name), (i, (name.lower, name.upper, name.title)[i % 3]())]
    got = {(r.doc_id, r.e, r.n) for r in mentions.mentions(docs, spark.createDataFrame(names, "e long, n string"), "doc_id", "text", "e", "n").collect()}
    want = expected(texts, names)
    assert got == want and len(want) > 400


def test_missing_spellings(spark):
    docs = [(1, "Mina came", "mi-na i-li-kam"), (2, "Mina came", "mi-ná"), (3, "Ali came", "a-lá-hi"), (4, "Ali came", "x"), (5, "Ali", None), (6, "Mina Ali", "a-la-hi (mi-na)")]
    names = [("p", "Mina"), ("q", "Ali")]
    spelled = [("p", "mi-na", False), ("q", "a-la-hi", True), ("q", "", True)]
    d = spark.createDataFrame(docs, "k long, t string, s string")
    found = mentions.mentions(d, spark.createDataFrame(names, "e string, n string"), "k", "t", "e", "n")
    got = mentions.missing_matches(found, d, spark.createDataFrame(spelled, "e string, s string, loose boolean"), "k", "e", "s", "s", "loose")
    assert sorted((r.k, r.e) for r in got.collect()) == [(2, "p"), (4, "q"), (5, "q")]


def slow_merge(rows):
    """Each entry joins the first merged one whose folded names meet its own."""
    merged = []
    for display, names, spellings, sources in rows:
        keys = {fold(n) for n in names} - {""}
        at = next((m for m in merged if m[4] & keys), None)
        if at is None:
            merged.append([display, set(names), set(spellings), set(sources), keys])
        else:
            for i, x in ((1, names), (2, spellings), (3, sources), (4, keys)):
                at[i] |= set(x)
    return sorted((m[0], sorted(m[1]), sorted(m[2]), sorted(m[3])) for m in {fold(m[0]): m for m in merged}.values())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merge_of_components_is_the_ordered_one(spark, seed):
    rng = random.Random(seed)
    pool = [f"{c}{v}" for c in "bdgkš" for v in ("a", "ā", "A", "i", "u", "el", "or")] + ["", " "]
    rows = [(rng.choice(pool[:-2]), rng.sample(pool, rng.randrange(0, 3)), [f"s{i % 9}"], [rng.choice(["x", "y"])]) for i in range(120)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "o long, display string, names array<string>, spellings array<string>, sources array<string>")
    got = entities.merge_entities(df, "o").collect()
    assert sorted((r.display, list(r.names), list(r.spellings), list(r.sources)) for r in got) == slow_merge(rows)
    assert sorted((m["display"], sorted(m["names"]), sorted(m["spellings"]), sorted(m["sources"])) for m in entities.merge_ordered([dict(zip(("display", "names", "spellings", "sources"), r, strict=True)) for r in rows])) == slow_merge(rows)


def test_merged_query(spark):
    from tessella.plans import QUERIES

    small = SF.replace("0.01", "0.001")
    parts = sorted(spark.read.parquet(f"{small}/part.parquet").collect(), key=lambda r: r.p_partkey)
    rows = [(r.p_name, [*r.p_name.split(" "), f"{r.p_brand} {r.p_size}"], [r.p_brand], [r.p_type]) for r in parts]
    got = QUERIES["merged_entities"](spark, small).collect()
    assert sorted((r.display, list(r.names), list(r.spellings), list(r.sources)) for r in got) == slow_merge(rows)


def test_a_name_counts_once_a_text():
    """An entry's names are compared once for each name that stands in a text, not for each place; folding gives what its definition does."""

    compared = []

    class Entries(tuple):
        def __iter__(self):
            compared.append(1)
            return super().__iter__()

    found = mentions._surfaces("the cat, the cat and the dog", mentions._automaton({"the": Entries(("a", "b")), "the cat": Entries(("b",))}), "A-Za-z")
    assert found == {"a": (3, "the"), "b": (7, "the cat")} and len(compared) == 2

    def plain(t):
        flat = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        return " ".join(flat.replace("—", "-").replace("–", "-").split()).lower()

    for t in ("", "A  b\tC\x1fd", "É–x—ﬁ ½ Ａ　ö", "ẹ́ İ ẞ", "́", "한글 Ⅷ"):
        assert fold(t) == plain(t)
