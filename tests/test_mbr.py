"""Scores of a pair counted once for both directions, and the consensus choice from them."""

import random

from pyspark.sql import functions as F

from tessella.operators import scoring

WORDS = ["silver", "of", "the", "mina", "a", "3.5", "it's", "kaspum,", "(x)", "ä"]


def texts(n, seed):
    r = random.Random(seed)
    return ["", " ", "a", "\U0001f600 b", *(" ".join(r.choice(WORDS) for _ in range(r.randrange(9))) for _ in range(n))]


def test_both_ways(spark):
    r = random.Random(2)
    own = texts(30, 1)
    rows = [(r.choice(own), r.choice(own)) for _ in range(200)] + [("", ""), ("", "a"), ("a", ""), (None, "a"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").withColumns({"c": scoring.chrf_both_ways("a", "b"), "d": scoring.bleu_both_ways("a", "b")})
    for x in df.collect():
        a, b = x.a or "", x.b or ""
        assert (x.c.ab, x.c.ba) == (scoring.chrf(scoring.chrf_statistics(a, b)), scoring.chrf(scoring.chrf_statistics(b, a)))
        assert (x.d.ab, x.d.ba) == (scoring.bleu(scoring.bleu_statistics(a, b), True), scoring.bleu(scoring.bleu_statistics(b, a), True))


def test_choice(spark):
    """The score of each pool's choice is the best of a loop over all ordered pairs; the weights of length and support are nought."""
    pools = [(k, i, t) for k in range(6) for i, t in enumerate(dict.fromkeys(" ".join(t.lower().split()) for t in texts(7, k) if t.strip()))]
    df = spark.createDataFrame(pools, "k int, pos int, t string")
    jaccard = lambda a, b: 100.0 * len(a & b) / len(a | b)

    def score(a, b):
        return 0.55 * scoring.chrf(scoring.chrf_statistics(a, b)) + 0.25 * scoring.bleu(scoring.bleu_statistics(a, b), True) + 0.2 * jaccard(set(a.split()), set(b.split()))

    best = {}
    for k, i, t in pools:
        others = [u for q, j, u in pools if q == k and j != i]
        best[k] = max(best.get(k, -1), sum(score(t, u) for u in others) / len(others))
    got = {r.k: r.score for r in scoring.mbr(df, "k", "t", "pos", w_length=0.0).select("k", F.col("score")).collect()}
    assert got.keys() == best.keys() and all(abs(got[k] - best[k]) < 1e-9 for k in best)


def test_pools_against_loop(monkeypatch):
    """Means of pools of any size, taken together or each for itself, are those of a loop over ordered pairs."""
    r = random.Random(3)
    pools = [[r.choice(texts(40, 4)) for _ in range(n)] for n in (0, 1, 2, 5, 33, 1, 9)]
    sets = lambda t: dict.fromkeys(t.lower().split())

    def score(a, b):
        x, y = set(sets(a)), set(sets(b))
        j = 100.0 * len(x & y) / len(x | y) if x | y else 100.0
        return (0.5 * scoring.chrf(scoring.chrf_statistics(a, b)) + 0.3 * scoring.bleu(scoring.bleu_statistics(a, b), True) + 0.4 * j) / 1.2

    for chunk in (400_000, 300, 1):
        monkeypatch.setattr(scoring, "CHUNK", chunk)
        got = scoring.pool_means([[(t, " ".join(sets(t))) for t in p] for p in pools], 0.5, 0.3, 0.4)
        assert [len(g) for g in got] == [len(p) for p in pools]
        for p, g in zip(pools, got, strict=True):
            for i, t in enumerate(p):
                assert abs(g[i] - sum(score(t, u) for j, u in enumerate(p) if j != i) / max(1, len(p) - 1)) < 1e-9


def test_texts_move_once(spark):
    """No text is joined with the others of its pool; rows without a pool are not compared; equal scores go to the first place."""
    df = spark.createDataFrame([(1, 0, "a b"), (1, 1, "b a"), (2, 5, None), (None, 0, "x"), (None, 1, "y z")], "k int, pos int, t string")
    out = scoring.mbr(df, "k", "t", "pos", w_length=0.0)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.k: (r.pos, r.t, r.support, r.score) for r in out.collect()}
    assert got.keys() == {1, 2, None} and got[1][0] == 0 and got[1][3] > 20 and got[2] == (5, None, 1, 0.0) and got[None] == (0, "x", 1, 0.0)
