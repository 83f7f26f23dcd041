"""Counts that are cut before they move, against plain counting."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import aggregates
from tessella.session import temporary


@pytest.mark.parametrize("hot", [1 / 100, 1 / 5])
def test_translations_against_plain_python(spark, monkeypatch, hot):
    """Ties at the last place, tokens of few common words, tokens in nearly all rows."""
    monkeypatch.setattr(aggregates, "HOT_SHARE", hot)
    rng = random.Random(5)
    turns = [(i, [f"t{min(rng.randrange(40), rng.randrange(40))}" for _ in range(6)] + ["every"], [f"w{rng.randrange(3 if i % 2 else 300)}" for _ in range(rng.randrange(5))]) for i in range(200)]
    rows, total, words = defaultdict(set), Counter(), defaultdict(Counter)
    for i, t, w in turns:
        total.update(t)
        for x in set(t):
            rows[x].add(i)
            words[x].update(w)
    expected = {x: (len(r), total[x], sorted(r)[:3], [w for w, _ in sorted(words[x].items(), key=lambda c: (-c[1], c[0]))[:5]]) for x, r in rows.items() if len(r) >= 2}
    df = spark.createDataFrame(turns, "k long, t array<string>, w array<string>")
    with temporary(spark):
        got = aggregates.token_dictionary(df, "k", F.col("t"), F.col("w")).collect()
    assert {r["token"]: (r["n_rows"], r["n_occurrences"], r["examples"], r["top_words"] or []) for r in got} == expected


def test_report_moves_no_texts(spark):
    """Rows with the phrase keep their columns: two rows of one key are not crossed, and words are never joined back to their row."""
    df = spark.createDataFrame([(1, "of the sea of the", "en"), (1, "sun of the", "en"), (2, "of a", "fr")], "k long, s string, l string")
    words = F.split("s", " ")
    report = aggregates.phrase_report(df, "k", "k", words, "l", words, ["of", "the"])
    assert {(r["kind"], r["n"]) for r in report.collect() if r["kind"] in ("rows", "occurrences")} == {("rows", 2), ("occurrences", 3)}
    assert "Join" not in report._jdf.queryExecution().optimizedPlan().toString()


def _terms(rows):
    """{(kind, term): (n, rows)} by a loop."""
    n, keys = Counter(), defaultdict(set)
    for k, w in rows:
        for x in [("word", x) for x in w or []] + [("bigram", f"{a} {b}") for a, b in zip(w or [], (w or [])[1:])]:
            n[x] += 1
            keys[x].update([k] if k is not None else [])
    return {x: (n[x], len(keys[x])) for x in n}


def _texts(seed):
    """Some words common, most rare; keys of several rows, no key, no words."""
    rng = random.Random(seed)
    word = lambda: f"w{int(60 * rng.random() ** 3)}"
    rows = [(i // 2 if i % 5 == 0 else 1000 + i, [word() for _ in range(rng.randrange(30))]) for i in range(80)] + [(7, ["a", "b", "a", "b"])] * 3
    return [*rows, (None, ["w0", "w1", "w0"]), (5, None), (6, [])]


def test_cooccurrence_against_plain_python(spark):
    """Rows are distinct keys that are not null, as in SQL."""
    rows = _texts(1)
    with temporary(spark):
        got = aggregates.cooccurrence(spark.createDataFrame(rows, "k long, w array<string>"), "k", F.col("w")).collect()
    assert {(r["kind"], r["term"]): (r["n"], r["rows"]) for r in got} == _terms(rows) and len(got) == len(_terms(rows))


@pytest.mark.parametrize("paired, most", [(1, 5_000), (1, 2), (20, 5_000)])
def test_top_cooccurrence_counts_all_pairs(spark, monkeypatch, paired, most):
    """The first words are enough, more are looked at, all pairs are: the same rows, ties by term."""
    monkeypatch.setattr(aggregates, "PAIRED", paired)
    monkeypatch.setattr(aggregates, "SET_WORDS", most)
    for rows in (_texts(2), [(i, [f"u{i}", f"v{i}", f"u{i}", f"v{i}"]) for i in range(9)], [(1, ["a"]), (2, None)]):
        terms = [(kind, term, *c) for (kind, term), c in _terms(rows).items() if c[0] >= 2]
        expected = [x for kind in ("word", "bigram") for x in sorted((t for t in terms if t[0] == kind), key=lambda t: (-t[2], t[1]))[:4]]
        with temporary(spark):
            got = aggregates.top_cooccurrence(spark.createDataFrame(rows, "k long, w array<string>"), "k", F.col("w"), 4, least=2).collect()
        assert sorted(map(tuple, got)) == sorted(expected)


def test_cooccurrence_moves_terms_once(spark):
    """Where each key has one row, a term meets its equals in one shuffle, not by key before."""
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a"])], "k long, w array<string>")
    assert aggregates.cooccurrence(df, "k", F.col("w"))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
