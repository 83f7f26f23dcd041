"""Line dedup and near-dedup against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import line_dedup, minhash_dedup, textbytes as tb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d string, t string, gone string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", "x", "x", "x") for i, t in rows], SCHEMA)


def test_line_dedup_brute_force(spark):
    r = random.Random(3)
    shared = ["A shared line that is certainly longer than forty code points, number %d" % k for k in range(6)]
    docs = [(i, "\n".join([r.choice([*shared, "short", "", "  \t" + shared[0].upper() + " "]) for _ in range(r.randint(0, 6))])) for i in range(40)]
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1]), (None, shared[0])]
    docs += [(0, docs[0][1]), (1, docs[2][1]), (103, "\n".join([*(f"line {k} of a very long text, all of them different from the others" for k in range(20_000)), shared[1]]))]
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda x: x.strip(" \t\n\v\f\r").translate(low)
    holders = defaultdict(set)
    for i, t in docs:
        if i is not None:
            for x in (t or "").split("\n"):
                holders[key(x)].add(i)
    want = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        want.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(x) for x in line_dedup.dedup_lines(frame(spark, docs), batches=3, fanout=2).collect()]
    assert Counter(got) == Counter(want)


def test_line_dedup_empty(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []


def test_repeated_rows_drop_once(spark):
    line = "x" * 45
    got = {(r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in line_dedup.dedup_lines(frame(spark, [(0, f"{line}\nown")] * 2 + [(k, line) for k in range(1, 6)])).collect()}
    assert got == {(0, 2, 1, "own"), *((k, 1, 1, "") for k in range(1, 5)), (5, 1, 0, line)}


def test_runs_merge_anti_join(spark):
    store = line_dedup.LineRuns(spark, fanout=2, buckets=3)
    batch = lambda d, names: line_dedup.hashed_lines(frame(spark, [(d, "\n".join(x * 50 for x in names))]))
    assert store.unseen(batch(1, "xy")).count() == 2
    store.add(batch(1, "xy"))
    assert store.unseen(batch(2, "yz")).count() == 1
    for d, names in ((2, "yz"), (3, "zu"), (4, "uvw")):
        store.add(batch(d, names))
    assert [len(x) for x in store.levels] == [0, 0, 1]
    assert sorted((r.n_docs, r.max_doc) for r in store.totals().collect()) == [(1, 1), (1, 4), (1, 4), (2, 2), (2, 3), (2, 4)]
    assert [x.count() for x in store._runs()] == [6]  # each key in one run, with its batch's count
    store.drop()


def test_runs_are_not_sorted_again(spark):
    """Neither an exchange nor a sort stands between the runs and their merge."""
    store = line_dedup.LineRuns(spark, fanout=4, buckets=3)
    for d in (1, 2):
        store.add(line_dedup.hashed_lines(frame(spark, [(d, f"{d}" * 50)])))
    a, b = store._runs()
    with line_dedup._sorted_scans(spark):
        plan = a.join(b.hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    store.drop()


def shingles(text):
    w = (text or "").split()
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def classes_of(docs):
    bags = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if a and b and 5 * sum((a & b).values()) >= 4 * sum((a | b).values()):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in bags}


def corpus(seed=5, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    base = [[word() for _ in range(r.randint(30, 150))] for _ in range(12)]
    docs = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice((0, 0, 1, 2, 4, 9))):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.2:
            w += base[0][:20]
        docs.append((i, " ".join(w)))
    return docs + [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "one two"), (n + 4, "one two three"), (n + 5, "a b c d e " * 40), (n + 6, "a b c d e " * 40), (n + 7, "a b c d e " * 20)]


def test_near_duplicates_brute_force(spark):
    docs = corpus()
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert got == classes_of(docs)


def test_hot_group_of_near_copies(spark):
    r = random.Random(1)
    base = ["w%d" % r.randrange(10**6) for _ in range(200)]
    docs = []
    for i in range(150):
        w = list(base)
        w[r.randrange(200)] = f"x{i}"
        docs.append((i, " ".join(w)))
    got = minhash_dedup.near_duplicates(frame(spark, docs)).collect()
    assert {x.class_id for x in got} == {0}


def test_one_id_on_two_texts(spark):
    r = random.Random(8)
    a, b = ([f"w{r.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    rows = [(5, " ".join(a)), (5, " ".join(b)), (6, " ".join([*a, "x"])), (7, " ".join([*b, "x"])), (None, " ".join(a)), (None, "only here")]
    got = Counter((x.doc_id, x.class_id) for x in minhash_dedup.near_duplicates(frame(spark, rows)).collect())
    assert got == Counter({(5, 5): 2, (6, 5): 1, (7, 5): 1, (None, 5): 1, (None, None): 1})


def test_very_long_texts(spark):
    """Texts far longer than a chunk, near copies of each other, beside short ones."""
    r = random.Random(12)
    words = [f"u{r.randrange(10**7)}" for _ in range(250_000)]
    other = list(words)
    for k in range(0, 250_000, 300):
        other[k] = f"t{k}"
    far = [w if r.random() > 0.1 else "z" for w in words]
    docs = [(3, " ".join(words)), (1, " ".join(other)), (9, " ".join(far)), (2, "short one here"), (4, " ".join(words[:100]))]
    assert len(docs[0][1]) > 2 * tb.CHUNK
    got = {x.doc_id: x.class_id for x in minhash_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert got == classes_of(docs) and got[3] == 1 and got[9] == 9


def test_first_of_class(spark):
    r = random.Random(8)
    a, b = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(5, a), (5, a), (5, b), (6, f"{a} x"), (7, f"{b} x"), (None, a), (8, ""), (8, ""), (9, None), (10, "alone here"), (10, "alone here"), (11, "alone here")]
    got = minhash_dedup.first_of_class(frame(spark, rows))
    assert got.columns == frame(spark, rows).columns
    assert Counter((x.doc_id, x.text) for x in got.collect()) == Counter([(5, a), (5, b), (None, a), (8, ""), (8, ""), (9, None), (10, "alone here")])


def hard_group(n=140, seed=2):
    """Copies of one text changed a little or a lot, copies of its changed copies, and its beginnings of many lengths."""
    r = random.Random(seed)
    word = lambda: f"v{r.randrange(10**6)}"
    base = [word() for _ in range(120)]
    second = [w if r.random() > 0.06 else word() for w in base]
    docs = []
    for i in range(n):
        w = list(r.choice((base, second)))
        for _ in range(r.choice((1, 2, 4, 5, 6, 8, 12))):
            w[r.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    docs += [(n + k, " ".join(base[: 60 + k])) for k in range(0, 60, 4)]
    return docs


@pytest.mark.parametrize(("small", "rounds"), [(64, 3), (1, 8), (1, 1)])
def test_hard_group_brute_force(spark, small, rounds):
    docs = hard_group()
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicates(frame(spark, docs), small=small, rounds=rounds).collect()}
    want = classes_of(docs)
    assert got == want and len(set(want.values())) > 10


def test_many_components_meet_by_rare_elements(spark):
    """One group of 600 members in 200 components with most of their words in common: few pairs, none lost."""
    r = random.Random(4)
    shared = " ".join(f"c{k}" for k in range(40))
    docs = []
    for c in range(200):
        own = [f"w{c}x{k}" for k in range(30)]
        for k in range(3):
            w = list(own)
            if k:
                w[r.randrange(30)] = f"n{c}x{k}"
            docs.append((3 * c + k, f"{shared} {' '.join(w)}"))
    texts = frame(spark, docs).selectExpr("doc_id AS node", "text")
    size = {i: sum(shingles(t).values()) for i, t in docs}
    members = spark.createDataFrame([("k", i, i, n) for i, n in size.items()], "key string, node long, root long, size long")
    pairs = {(x.pivot, x.node) for x in minhash_dedup._by_rare_elements(members, texts).collect()}
    bags = {i: shingles(t) for i, t in docs}
    alike = {(a, b) for a in bags for b in range(a + 1, min(a + 3, 600)) if 5 * sum((bags[a] & bags[b]).values()) >= 4 * sum((bags[a] | bags[b]).values())}
    assert alike <= pairs and len(pairs) <= 600 < 600 * 599 / 2


def test_overlaps_brute_force(spark):
    docs = corpus(seed=9, n=40)
    texts = frame(spark, docs).selectExpr("doc_id as node", "text").filter("text is not null")
    pairs = [(a, b) for a in (3, 7, 20) for b in range(40) if a != b]
    stars = minhash_dedup.overlaps(spark.createDataFrame(pairs, "pivot long, node long"), texts)
    bags = {i: shingles(t) for i, t in docs}
    size = lambda x: sum(x.values())
    assert {(x.pivot, x.node): x.shared for x in stars.collect()} == {(a, b): size(bags[a] & bags[b]) for a, b in pairs}
    # What a pivot tells of two members never understates what they share.
    sizes = spark.createDataFrame([(i, size(b)) for i, b in bags.items()], "node long, size long")
    known = {(x.pivot, x.node): x for x in minhash_dedup._measured(stars, sizes).collect()}
    close = 0
    for p in (3, 7, 20):
        for a in range(40):
            for b in range(a):
                if (p, a) in known and (p, b) in known:
                    x, y = known[(p, a)], known[(p, b)]
                    both = lambda m, n: sum((u & v & (1 << 64) - 1).bit_count() for u, v in zip(m, n, strict=True))
                    most = x.shared + y.shared - x.np + min(x.np - x.shared, y.np - y.shared, both(x.missing, y.missing) + min(x.mo, y.mo)) + min(x.size - x.shared, y.size - y.shared, both(x.extra, y.extra) + min(x.xo, y.xo))
                    assert most >= size(bags[a] & bags[b])
                    close += most <= size(bags[a] & bags[b]) + 20
    assert close > 500


def test_nothing_is_left_behind(spark):
    from pathlib import Path

    from tessella.session import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:")) / "tessella"
    before = set(folder.iterdir()) if folder.exists() else set()
    minhash_dedup.near_duplicates(frame(spark, corpus(n=20))).collect()
    assert [x.name.partition("-")[0] for x in set(folder.iterdir()) - before] == ["classes"]


def test_near_duplicates_empty(spark):
    assert minhash_dedup.near_duplicates(frame(spark, [])).collect() == []


def test_signatures_are_unbiased():
    r = np.random.default_rng(2)
    est, true = [], []
    for _ in range(40):
        e = r.integers(0, 1 << 44, 80, dtype=np.uint64)
        a, b = r.integers(1, 7, 80), r.integers(0, 7, 80)
        k = b > 0
        s = minhash_dedup.signatures(np.concatenate((np.zeros(80, int), np.ones(k.sum(), int))), np.concatenate((e, e[k])), np.concatenate((a, b[k])), 2)
        est.append((s[0] == s[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(est) - np.mean(true)) < 0.015


@pytest.mark.parametrize(("n", "block"), [(1, 500_000), (2, 3), (7, 1)])
def test_components(spark, n, block):
    edges = [(k, k + 1) for k in range(10 * n, 10 * n + 8)] + [(1000, 2000), (2000, 1500)]
    got = {r.node: r.root for r in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long"), block).collect()}
    assert all(got[k] == 10 * n for k in range(10 * n + 1, 10 * n + 9)) and got[2000] == 1000 and got[1500] == 1000


def test_components_of_random_links(spark):
    r = random.Random(3)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)]
    root = {i: i for e in edges for i in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    for block in (500_000, 20):
        got = {x.node: x.root for x in minhash_dedup.components(spark.createDataFrame(edges, "a long, b long"), block).collect()}
        assert got == {k: v for k, v in root.items() if k != v}


def test_words_and_windows():
    import pyarrow as pa

    texts = ["a  b\tc", None, "", "x y z u v w x y z u v", "é è"]
    for _, _, data, offsets in tb.chunks(pa.array(texts)):
        starts, ends, docs, _ = tb.words(data, offsets)
        assert [bytes(data[s:e]).decode() for s, e in zip(starts, ends, strict=True)] == [w for t in texts for w in (t or "").split()]
        assert docs.tolist() == [i for i, t in enumerate(texts) for _ in (t or "").split()]
