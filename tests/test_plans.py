"""Queries over whole tables against plain Python."""

import hashlib
import re

from tessella.plans import QUERIES

SMALL = "/root/testdata/sf0.001"


def written(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def plain_gaps(t):
    kinds = (
        r"<\s*big[\s_\-]*gap\s*>", r"<\s*gap\s*>", r"(?<!\w)big[\s_\-]*gap(?!\w)", r"(?<!\w)x(?:\s+x)+(?!\w)", r"\.{3,}|…+|\[\.+\]",
        r"\[\s*x\s*\]|\(\s*x\s*\)", r"(?<!\w)x{2,}(?!\w)", r"(?<!\w)x(?!\w)", r"\(\s*large\s+break\s*\)", r"\(\s*break\s*\)", r"\(\s*\d+\s+broken\s+lines?\s*\)", r"\(\s*broken\s+line\s*\)",
    )
    return " ".join(re.sub("|".join(kinds), "<gap>", t or "", flags=re.I).split())


def test_gap_unify_all_texts(spark, tmp_path):
    odd = ["x", "a x x x b", "xx ša [x] ( x )", "<gap> <big gap> < GAP >", "Big_Gap of it", "a … b ... [..]", "(large break) (break)", "(3 broken lines) (broken line)", "max x2 <b> big broken break", None]
    rows = [(i, t) for i, t in enumerate(odd)] + [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: r.digest for r in QUERIES["gap_unify"](spark, written(spark, tmp_path, "documents", rows, "doc_id long, text string")).collect()}
    assert got == {i: hashlib.md5(plain_gaps(t).encode()).hexdigest() for i, t in rows}


def plain(t):
    return (t or "").lower().split()


def test_whole_items_and_texts(spark, tmp_path):
    """Phrases and words from anywhere in an item or a text, not from its first words only."""
    items = [(i, f"w{i} w{i} and then the long {i}th sentence ends with Zebra{i} zebra{i} here") for i in range(4)] + [(9, "tiny item"), (10, "solo"), (11, None)]
    docs = [(i, f"start of it the long {i}th sentence ends with Zebra{i} here and a tiny item OF of The solo", "en", "s") for i in range(6)] + [(50, "with", "en", "s"), (51, None, "en", "s"), (52, "", "en", "s")]
    written(spark, tmp_path, "benchmark", items, "item_id long, text string")
    sf = written(spark, tmp_path, "documents", docs, "doc_id long, text string, lang string, source string")
    turns = [(i, k, "user", t) for i, t, *_ in docs for k in (0, 1)]
    written(spark, tmp_path, "conversations", turns, "conv_id long, turn long, role string, text string")
    grams = {(i, tuple(w[k : k + 3])) for i, t in items for w in [plain(t)] for k in range(max(len(w) - 2, 1)) if w}
    spots = {(d, k, i) for d, t, *_ in docs for w in [plain(t)] for k in range(len(w)) for i, g in grams if tuple(w[k : k + len(g)]) == g}
    assert {tuple(r) for r in QUERIES["phrase_positions"](spark, sf).select("doc_id", "pos", "item_id").collect()} == spots
    assert {tuple(r) for r in QUERIES["phrase_contains"](spark, sf).select("doc_id", "item_id").collect()} == {(d, i) for d, _, i in spots}
    assert {(r.doc_id, r.item_id) for r in QUERIES["ngram_join"](spark, sf).collect()} == {(d, i) for d, _, i in spots}

    def merged(t):
        seen = {}
        for x in t.split(" ") + ["The", "of", "OF"]:
            seen.setdefault(x.lower(), x)
        return list(seen.values())

    assert {r.doc_id: r.merged for r in QUERIES["merge_ci"](spark, sf).collect()} == {d: None if t is None else merged(t) for d, t, *_ in docs}
    hints = {(r.conv_id, r.turn): r.hints for r in QUERIES["greedy_hints"](spark, sf).collect()}
    assert "1th\\u0001sentence" in hints[(1, 0)].replace("\x01", "\\u0001")
    surfaces = {r.surface for r in QUERIES["surface_mentions"](spark, sf).collect()}  # of an entry's names the longest, such as a run of words
    assert any("sentence ends" in x for x in surfaces) and "tiny item" in surfaces and QUERIES["name_mentions"](spark, sf).count() > 0
    assert QUERIES["name_swap"](spark, sf).count() > 0 and QUERIES["missing_mentions"](spark, sf).count() == 0


def test_all_rows(spark):
    docs, turns = (spark.read.parquet(f"{SMALL}/{x}.parquet") for x in ("documents", "conversations"))
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").count()
    assert QUERIES["union_reports"](spark, SMALL).count() == docs.count() + vectors
    got = {(r.conv_id, r.turn): r.hints for r in QUERIES["budget_trim"](spark, SMALL).collect()}
    for r in turns.collect():
        w, size, kept = (r.text or "").split(), 10, []
        for x in w:
            size += len(x) + 2
            if size > 60:
                break
            kept.append(x)
        assert got[(r.conv_id, r.turn)] == kept
    assert len(got) == turns.count()
