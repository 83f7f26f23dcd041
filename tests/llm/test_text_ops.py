"""Quality rules, language ID, mixing, licences and media against brute force."""

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import language_id, license_scan, media, mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, lines string, weight string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None, "x", "x", "x") for i, t, lang, src in rows], SCHEMA)


def texts(n=60, seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé#$") for _ in range(r.randint(1, 6)))
    line = lambda: r.choice((" ", "\t", "")) + " ".join(word() for _ in range(r.randint(0, 9)))
    common = "this is a line that very many documents hold 2024"
    out = []
    for i in range(n):
        lines = [line() for _ in range(r.randint(0, 8))]
        lines += [r.choice(lines)] * r.choice((0, 0, 2)) if lines else []
        lines += [common.replace("2024", str(2000 + i))] * (r.random() < 0.6)
        out.append((i, "\n".join(lines), r.choice(("en", "fr", None)), r.choice(("s1", "s2", None))))
    return out + [(n, None, None, None), (n + 1, "", "en", "s1"), (n + 2, common, "en", "s1"), (None, common, "en", "s1"), (n + 3, "one two three four five six " * 5, "en", "s2")]


def test_quality_brute_force(spark):
    rows = texts()
    got = {(r.doc_id): r for r in quality_rules.quality_rules(frame(spark, rows), max_docs=5).collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    low = lambda w: re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), w))
    hosts = defaultdict(set)
    for i, t, _, src in rows:
        if i is not None:
            for x in (t or "").split("\n"):
                if split(x):
                    hosts[(src, tuple(map(low, split(x))))].add(i)
    for i, t, _, src in rows:
        w = split(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        lost = 0
        for x in lines:
            key = (src, tuple(map(low, split(x))))
            if i is not None and len(hosts[key]) > 5 and i != min(hosts[key]):
                lost += len(split(x))
        g = got[i]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        assert g.n_lost_words == lost and g.base_failed == failed
        assert g.kept == (not failed and not (100 * lost > 80 * len(w) or (lost and len(w) - lost < 10)))
    assert len(got) == len(rows)
    assert quality_rules.quality_rules(frame(spark, [])).collect() == []


def test_quality_one_id_on_two_texts(spark):
    line = "this line is in very many of the documents"
    own = [" ".join(f"{chr(97 + i)}{chr(97 + k)}" for k in range(20)) for i in range(12)]
    rows = [(i, f"{line}\n{own[i]}", "en", "s") for i in range(8)] + [(3, f"one two three\n{own[9]}\n{line}\n{line}", "en", "s"), (5, f"{line}\n{own[5]}", "en", "s"), (6, "three words only", "en", "s"), (None, f"{line}\n{own[3]}", "en", "s")]
    got = Counter((r.doc_id, r.n_words, r.n_lost_words, r.kept) for r in quality_rules.quality_rules(frame(spark, rows), max_docs=5).collect())
    want = Counter({(0, 29, 0, True): 1, (5, 29, 9, True): 2, (3, 41, 18, False): 1, (6, 3, 0, False): 1, (None, 29, 0, True): 1} | {(i, 29, 9, True): 1 for i in (1, 2, 3, 4, 6, 7)})
    want[(3, 41, 18, False)] = 0
    repeated = [x for x in got if x[:2] == (3, 41)]
    assert len(repeated) == 1 and repeated[0][2] == 18
    assert got - Counter(repeated) == +want
    clean = Counter((r.doc_id, r.text) for r in quality_rules.clean(frame(spark, rows), max_docs=5).collect())
    assert clean[(1, own[1])] == 1 and clean[(5, own[5])] == 2 and clean[(0, f"{line}\n{own[0]}")] == 1 and (6, "three words only") not in clean
    assert clean[(None, f"{line}\n{own[3]}")] == 1 and sum(clean.values()) == sum(r[3] * n for r, n in got.items())


def test_quality_repeats_in_long_texts(spark):
    """Counts of a long text without repeats, and of one with a single repeated window at its ends."""
    words = [f"{k:x}" for k in range(200_000)]
    rows = [(1, " ".join(words), "en", "s"), (2, " ".join([*words, *words[:5]]), "en", "s"), (3, "\n".join(words), "en", "s")]
    got = {r.doc_id: (r.n_repeat_words, r.n_dup_lines) for r in quality_rules.quality_rules(frame(spark, rows)).collect()}
    assert got == {1: (0, 0), 2: (10, 0), 3: (0, 0)}


def test_quality_short_lines(spark):
    """Short lines count in every document of a host, however they are indented."""
    rows = [(i, "Read more\n" * 9 + "own" + "abcdefgh"[i] + " words", "en", "s1") for i in range(8)] + [(20 + i, " " * 20 * (i % 2) + "短い行\none two three four five six seven eight nine ten", "en", "s2") for i in range(8)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, rows), max_docs=5).collect()}
    assert [got[i].n_lost_words for i in range(8)] == [0] + [18] * 7
    assert [got[20 + i].n_lost_words for i in range(8)] == [0] + [11] * 7 and [got[20 + i].kept for i in range(8)] == [True] + [False] * 7


def test_phrases_brute_force():
    sample = (("a", ("banana", "bandana")), ("b", ("cabcab", "bacca")))
    model = language_id.Model({k: list(v) for k, v in sample})
    words = ["banana", "nab", "zzz", "bzana", "cabba", "b"]
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.cumsum([0, *map(len, words)])
    got = model.phrases(points, at[:-1], at[1:])
    for k, (_, known) in enumerate(sample):
        parts = {w[i:j] for w in known for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        for n, w in enumerate(words):
            i = count = 0
            while i < len(w):
                j = i + 1
                while w[i:j] in parts and j < len(w) and w[i : j + 1] in parts:
                    j += 1
                i, count = j, count + 1
            assert got[k, n] == count


def test_language_held_out(spark):
    r = random.Random(4)
    parts = {"en": ["the", "ing", "er", "wh", "th"], "fr": ["eau", "oi", "que", "é", "le"], "de": ["sch", "ung", "ein", "ü", "ch"]}
    rows = []
    for i in range(240):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 4))) for _ in range(40)), lang, "s"))
    rows += [(900, None, None, "s"), (901, "12 + 3 !", "en", "s"), (902, "", "fr", "s")]
    got = {x.doc_id: x for x in language_id.identify(frame(spark, rows)).collect()}
    held = [(got[i], lang) for i, _, lang, _ in rows if i < 900 and got[i].held_out]
    assert held and all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got.values())
    assert sum(g.lang_pred == lang for g, lang in held) / len(held) > 0.97
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and all(0 <= g.score <= 1 for g in got.values())
    assert {x.lang_pred for x in language_id.identify(frame(spark, [(1, "abc", None, None)])).collect()} == {"und"}
    assert language_id.identify(frame(spark, [])).collect() == []


def test_language_sample_and_kept_columns(spark):
    rows = [(i, ("the thing " if i % 2 else "le chose ") * 3 + f"w{'abcdefghij'[i % 10] * 3} " + "x" * 100, "en" if i % 2 else "fr", "s") for i in range(60)]
    df = frame(spark, rows)
    sample = dict(language_id.training_sample(df, docs_per_lang=5, words_per_lang=4))
    used = sorted((i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1), key=lambda i: i)
    words = {lang: {w for i in used if (i % 2 == 1) == (lang == "en") for w in rows[i][1].split() if len(w) <= 64} for lang in ("en", "fr")}
    assert set(sample) == {"en", "fr"} and all(len(v) == 4 and set(v) <= words[k] for k, v in sample.items())
    odd = df.withColumnsRenamed({"host": "score", "weight": "__w", "lines": "held_out"})
    out = language_id.identify(odd, keep=True)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "__w", "held_out", "lang_pred", "score"]
    got = out.collect()
    assert all(r.lang_pred == r.lang and r.text == rows[r.doc_id][1] and r["__w"] == "x" and 0 <= r.score <= 1 for r in got) and len(got) == 60
    one = language_id.identify(frame(spark, [(1, "word " * 400_000, "en", "s"), (5, "mot", "fr", "s"), (5, "mots", "fr", "s")])).collect()
    assert len(one) == 3


def test_mixing(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(("aaaaaaaa", "bbbbbbbb", "cc")) for _ in range(r.randint(1, 40))), r.choice(("en", "en", "en", "fr", None)), r.choice(("a", "a", "b", "c"))) for i in range(400)]
    rows += [(1000, None, None, None), (None, "x y", "en", "a")]
    df = frame(spark, rows)
    one = {x.doc_id: x for x in mixing.weights(df).collect()}
    two = {x.doc_id: x for x in mixing.weights(df, local_cells=0).collect()}
    assert len(one) == len(rows)
    for k, x in one.items():
        assert abs(x.prob - two[k].prob) < 1e-4 and x.n_words == len((next(t for i, t, *_ in rows if i == k) or "").split())
    got = list(one.values())
    total = sum(x.n_words for x in got)
    assert abs(sum(x.n_words * x.prob for x in got) - 0.8 * total) < 0.01 * total
    for margin in ("source", "lang", "topic"):  # weights meet each marginal's target
        now, fit = Counter(), Counter()
        for x in got:
            now[x[margin]] += x.n_words
            fit[x[margin]] += x.n_words * x.weight
        raised = {k: v**mixing.TEMPER for k, v in now.items() if v}
        for k, v in raised.items():
            assert abs(fit[k] - total * v / sum(raised.values())) < 1e-3 * total
    assert mixing.weights(frame(spark, [])).collect() == []
    # Every row is sampled as its hash says, and sample gives just these rows.
    place = {x.doc_id: x.p for x in df.selectExpr("doc_id", "xxhash64(doc_id, 0) / double(18446744073709551616) + 0.5 as p").collect()}
    assert all(x.sampled == (k is not None and place[k] < x.prob) for k, x in one.items()) and not one[None].sampled
    kept = mixing.sample(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == sorted(k for k, x in one.items() if x.sampled)
    assert mixing.sample(frame(spark, [])).collect() == []


def test_mixing_very_long_and_repeated(spark):
    rows = [(1, "word " * 500_000, "en", "s"), (2, "some other words here", "en", "s"), (2, "some other words here", "en", "s"), (2, "and a second text of it", "fr", "t"), (3, "", None, None)]
    got = Counter((x.doc_id, x.n_words) for x in mixing.weights(frame(spark, rows)).collect())
    assert got == {(1, 500_000): 1, (2, 4): 2, (2, 6): 1, (3, 0): 1}


def test_mixing_by_own_targets_and_contradictions(spark):
    rows = [(i, "some words that are here", ("en", "fr")[i % 2], ("a", "b")[i % 2]) for i in range(40)]
    with pytest.warns(UserWarning, match="raking stopped"):
        mixing.weights(frame(spark, rows), targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "fr": 0.8}}).collect()
    rows = [(i, "some words that are here", ("en", "fr")[i % 2], ("a", "b")[i // 2 % 2]) for i in range(40)]
    got = mixing.weights(frame(spark, rows), targets={"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.2, "fr": 0.8}}).collect()
    share = lambda f: sum(x.weight * x.n_words for x in got if f(x)) / sum(x.weight * x.n_words for x in got)
    assert abs(share(lambda x: x.source == "a") - 0.9) < 1e-6 and abs(share(lambda x: x.lang == "fr") - 0.8) < 1e-6


def test_topics_are_clusters_and_not_languages(spark):
    """Texts of two languages, each about one of three things."""
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdefghijklmnop") for _ in range(6)) + k
    common = {lang: [word(lang) for _ in range(30)] for lang in ("en", "fr")}
    about = {(lang, t): [word(lang) for _ in range(25)] for lang in ("en", "fr") for t in range(3)}
    shared = {t: [word("x") for _ in range(25)] for t in range(3)}
    rows, kind = [], {}
    for i in range(300):
        lang, t = r.choice(("en", "fr")), r.randrange(3)
        kind[i] = t
        rows.append((i, " ".join(r.choice(common[lang]) if r.random() < 0.4 else r.choice(about[(lang, t)] if r.random() < 0.5 else shared[t]) for _ in range(80)), lang, "s"))
    got = {x.doc_id: x.topic for x in mixing.weights(frame(spark, rows), topics=3).collect()}
    best = defaultdict(Counter)
    for i, t in kind.items():
        best[got[i]][t] += 1
    assert sum(c.most_common(1)[0][1] for c in best.values()) > 0.9 * len(rows) and len(best) == 3


def test_licenses(spark):
    mit = license_scan.TEMPLATES["mit"]
    rows = [(1, mit, None, None), (2, "Text.\nReleased under the MIT license\nmore text", None, None), (3, None, None, None), (4, "nothing here", None, None), (5, mit.replace("copies", "copy") + "\n", None, None), (6, "", None, None), (6, "", None, None), (7, ("word " * 90_000) + "\n" + mit, None, None)]
    got = {x.doc_id: x for x in license_scan.scan(frame(spark, rows)).collect()}
    assert got[1].license == "mit" and got[1].dice == 1.0 and got[1].licenses == ["mit"]
    assert got[2].license == "mit-notice" and got[2].dice == 1.0 and got[2].n_matches == 1
    assert got[5].license == "mit" and 0.8 <= got[5].dice < 1 and got[7].license == "mit"
    assert all(got[k].license is None and got[k].n_matches == 0 for k in (3, 4, 6))
    assert license_scan.scan(frame(spark, [])).collect() == []


def test_media_round_trip(spark):
    rows = [(1, "héllo wörld " * 50, None, None), (2, None, None, None), (3, "", None, None), (4, "x" * 64, None, None), (4, "x" * 64, None, None), (5, "long " * 500_000, None, None)]
    df = frame(spark, rows)
    stored = media.store(df)
    files = {x.doc_id: bytes(x.media) for x in stored.collect()}
    digests = {x.doc_id: x for x in media.encode(df).collect()}
    for x in media.decode(stored, with_pcm=True).collect():
        raw = (next(t for i, t, *_ in rows if i == x.doc_id) or "").encode()
        want = media.payload(raw)
        assert len(want) % 64 == 0 and len(want) >= 64 and want.rstrip(b"\0") == raw.rstrip(b"\0")
        assert media.read_wav(files[x.doc_id]) == want and x.payload_sha256 == hashlib.sha256(want).hexdigest() and x.n_bytes == len(raw) and x.payload_bytes == len(want)
        assert x.tail_crc32 == zlib.crc32(want[-64:]) and x.media_sha256 == hashlib.sha256(files[x.doc_id]).hexdigest() and x.media_bytes == len(files[x.doc_id])
        # Features by their definition: sums over samples one by one for short files, in one go for long ones.
        laws = [law[np.frombuffer(want, np.uint8)].astype(float) for law in (media.mu_law(), media.a_law())]
        rms = [round(float(np.sqrt((v * v).mean()))) for v in laws]
        wide = np.zeros(2 * len(want) + 6)
        wide[3:-3:2] = laws[0]
        pcm = np.clip(np.rint(sum(c * wide[k : k + 2 * len(want)] for k, c in enumerate((-3 / 32, 0, 19 / 32, 1, 19 / 32, 0, -3 / 32)))), -32768, 32767).astype("<i2").tobytes()
        blocks = media.adpcm(np.frombuffer(want, np.uint8).reshape(-1, 64)).astype("<i2").tobytes()
        assert media.read_wav(bytes(x.pcm)) == pcm
        assert x.feature == f"mulaw8k:{len(want)}:{rms[0]}:{rms[1]}:{zlib.crc32(blocks):08x}:{zlib.crc32(pcm):08x}"
        own = digests[x.doc_id].asDict()
        assert own == {k: v for k, v in x.asDict().items() if k != "pcm"}
    assert media.encode(frame(spark, [])).collect() == [] and len(digests) == 5


def test_adpcm_and_laws():
    r = np.random.default_rng(0)
    blocks = r.integers(0, 256, (20, 64), dtype=np.uint8)
    got = media.adpcm(blocks)
    for b, out in zip(blocks, got, strict=True):  # one sample at a time
        now, index = int(np.int16(int(b[0]) | int(b[1]) << 8 if b[1] < 128 else (int(b[0]) | int(b[1]) << 8) - 65536)), min(int(b[2]), 88)
        want = [now]
        for x in b[4:]:
            for n in (int(x) & 15, int(x) >> 4):
                step = media.STEP_SIZES[index]
                move = (step >> 3) + (step if n & 4 else 0) + (step >> 1 if n & 2 else 0) + (step >> 2 if n & 1 else 0)
                now = max(-32768, min(32767, now - move if n & 8 else now + move))
                index = max(0, min(88, index + media.INDEX_MOVES[n & 7]))
                want.append(now)
        assert out.tolist() == want
    assert media.mu_law()[0xFF] == 0 and media.mu_law()[0x00] == -32124 and media.mu_law()[0x80] == 32124 and len(media.STEP_SIZES) == 89
    assert media.a_law()[0xD5] == 8 and media.a_law()[0x55] == -8 and media.a_law()[0xAA] == 32256


def test_spdx_expressions(spark):
    tag = "SPDX-License-Identifier:"
    cases = [
        (None, []), ("", []), (tag, []), (f"// {tag} BSD-3-Clause", ["BSD-3-Clause"]), (f"{tag} MIT */", ["MIT"]), (f"<!-- {tag} CC0-1.0 -->", ["CC0-1.0"]),
        (f"{tag} (MIT OR Apache-2.0) AND EPL-2.0\nx", ["Apache-2.0", "EPL-2.0", "MIT"]), (f"{tag}GPL-2.0-only WITH Classpath-exception-2.0 OR Zlib", ["GPL-2.0-only", "Zlib"]),
        (f"{tag} MIT and then words", ["MIT"]), (f"{tag} MIT ANDROID", ["MIT"]), (f"see {tag} GPL-2.0+. Then {tag} MIT.", ["GPL-2.0+", "MIT"]), (f"{tag} MIT OR", ["MIT"]),
        (f"{tag} LicenseRef-own\n{tag} MIT\n{tag}\tMIT", ["LicenseRef-own", "MIT"]), (f"{tag} -- none", []), ("SPDX MIT", []), ("word " * 50_000 + f"{tag} " + "MIT OR " * 5_000 + "ISC", ["ISC", "MIT"]),
    ]
    rows = [(i, t, None, None) for i, (t, _) in enumerate(cases)]
    got = {x.doc_id: x.spdx for x in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_further_licenses(spark):
    """Each template is found as itself, wherever it stands in a text, with a word of it changed as well."""
    t = license_scan.TEMPLATES
    names = ["0bsd", "bsl-1.0", "bsl-1.0-notice", "cc0-1.0-notice", "epl-2.0-notice", "isc", "lgpl-3-notice", "unlicense-text", "zlib"]
    rows = [(i, f"Some words before.\n{t[n]}\nand behind", None, None) for i, n in enumerate(names)] + [(100 + i, t[n].replace("software", "program", 1), None, None) for i, n in enumerate(names)]
    got = {x.doc_id: x.license for x in license_scan.scan(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(names))] == names and [got[100 + i] for i in range(len(names))] == names


def test_license_anchors():
    """No unit that reaches the threshold is without an anchor word: not even the part of a template without them."""
    anchors = set(license_scan._anchors(0.8, license_scan._least))
    for name, text in license_scan.TEMPLATES.items():
        w = license_scan._tokens(text)
        grams = list(zip(w, w[1:], strict=False))
        free = sum(not (set(g) & anchors) for g in grams)
        assert 2 * free / (free + len(grams)) < 0.8, name


def test_license_full_texts(spark):
    """Full texts with the usual layout, in documents of their own and before code."""
    code = "\n".join(f"value_{i} = compute(input_{i}, {i * 7}) + offset" for i in range(200))
    t = license_scan.TEMPLATES
    wrap = lambda x, n: "\n".join(" " * (n % 3) + y for y in textwrap.wrap(x, n))
    more = "\n".join(f"{i}. Further terms of this licence, number {i}, as they may be found in the whole text." for i in range(60))
    names = ("apache-2.0-text", "gpl-2.0-text", "gpl-3.0-text", "mpl-2.0-text", "bsd-2-clause", "bsd-3-clause", "mit", "agpl-3-notice", "lgpl-2.1-notice", "gpl-2.0-notice")
    rows = [(k, f"Copyright (c) 2020 Some One\n{wrap(t[n], 12 * 6 + k)}\n{more if n.endswith('-text') else code}", None, None) for k, n in enumerate(names)]
    got = {x.doc_id: x.license for x in license_scan.scan(frame(spark, rows)).collect()}
    assert got == dict(enumerate(names))


def test_one_id_on_two_texts_each_by_itself(spark):
    """Rows that share an id are judged each by its own text."""
    mit = license_scan.TEMPLATES["mit-notice"]
    rows = [(5, f"some more words that stand here before it\n{mit}", "en", "s"), (5, "no licence in these words", "en", "s")]
    assert sorted((x.doc_id, x.n_matches) for x in license_scan.scan(frame(spark, rows)).collect()) == [(5, 0), (5, 1)]
    assert sorted(x.n_bytes for x in media.encode(frame(spark, rows)).collect()) == sorted(len(t.encode()) for _, t, *_ in rows)
    assert len({x.payload_sha256 for x in media.encode(frame(spark, rows)).collect()}) == 2


def test_license_windows(spark):
    """Wrapped texts inside longer documents, against all windows of words."""
    wrap = lambda x, head="": "\n".join(head + y for y in textwrap.wrap(x, 70))
    t = license_scan.TEMPLATES
    code = "\n".join(f"value_{i} = compute(input_{i}, {i * 7}) + offset" for i in range(40))
    rows = [
        (1, f"{code}\n{wrap(t['mit'])}\n{code}", None, None),
        (2, f"{wrap(t['apache-2.0-header'], ' * ')}\n{code}", None, None),
        (3, f"{code}\n{wrap(t['isc'].replace('hereby', 'now hereby'))}\n{code}\n{wrap(t['mit'].replace('copies', 'copy'))}", None, None),
        (4, "Copyright 2020 Foo and Bar, all of it made in one go. All rights\nreserved by the many people who have made it so far.", None, None),
        (5, "This work is licensed under the GNU General Public License, version 2.", None, None),
        (6, f"{code}\nSPDX-License-Identifier: BSD-2-Clause", None, None),
        (7, "Licensed under CC BY-NC 4.0.", None, None),
    ]
    got = {x.doc_id: x for x in license_scan.scan(frame(spark, rows)).collect()}
    grams = {k: Counter(v) for k, v in license_scan.template_bigrams().items()}
    for i, x, *_ in rows:
        w = license_scan._tokens(x)
        own = [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
        best = 0.0
        for g in grams.values():
            b = sum(g.values())
            for a in range(len(own)):
                left, o = Counter(g), 0
                for z in range(a, min(len(own), a + int(1.5 * b))):
                    o += left[own[z]] > 0
                    left[own[z]] -= 1
                    best = max(best, 2 * o / (max(z - a + 1, b) + b))
        units = [Counter(f"{a} {b}" for a, b in zip(u, u[1:], strict=False)) for u in map(license_scan._tokens, [x, *x.split("\n")])]
        best = max(best, *(2 * sum((u & g).values()) / max(1, sum(u.values()) + sum(g.values())) for u in units for g in grams.values()))
        assert (got[i].dice or 0) == (best if best >= 0.8 else 0), i
    assert [got[i].license for i in (1, 2, 4, 5, 6, 7)] == ["mit", "apache-2.0-header", "proprietary-notice", "gpl-3-work-notice", None, "cc-by-nc-4.0-notice"]
    assert {"isc", "mit"} <= set(got[3].licenses) and got[4].n_matches == got[5].n_matches == 1


def test_sample_keeps_columns_of_any_name(spark):
    rows = [(i, "some words that are here", "en", "s", i, f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __of long, `__topic` string")
    got = mixing.sample(df, fraction=1.0).collect()
    assert sorted(tuple(x) for x in got) == rows and got[0].__fields__ == df.columns


def raked(cells, targets, rounds):
    """Plain Python: cells of (margins, mass); targets by margin."""
    fitted = {k: float(m) for k, m in cells.items()}
    for _ in range(rounds):
        for i, target in enumerate(targets):
            now = Counter()
            for k, m in fitted.items():
                now[k[i]] += m
            fitted = {k: m * target[k[i]] / now[k[i]] if now[k[i]] else m for k, m in fitted.items()}
    return fitted


@pytest.mark.parametrize("rounds", [1, 3, 200])
def test_raking_against_plain_python(spark, rounds):
    r = random.Random(5)
    cells = {(s, g, t): r.randrange(1, 500) for s in "abc" for g in ("en", "fr") for t in range(3) if r.random() < 0.8}
    total = sum(cells.values())
    own = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"en": 0.6, "fr": 0.4}, "topic": {0: 0.3, 1: 0.3, 2: 0.4}}
    want = raked(cells, [{k: v * total for k, v in t.items()} for t in own.values()], rounds)
    df = spark.createDataFrame([(*k, m) for k, m in cells.items()], "source string, lang string, topic int, mass long")
    for few in (0, 1000):
        got = {(x.source, x.lang, x.topic): x.weight for x in mixing.fit(df, own, local_cells=few, rounds=rounds).collect()}
        assert all(abs(got[k] - want[k] / m) < 1e-5 * want[k] / m for k, m in cells.items())


def test_topics_come_from_all_words_of_all_rows(spark):
    """Sums in numpy over every row, however many and long; the table doesn't depend on the rows' order or partitions."""
    r = random.Random(7)
    rows = [(("", "en", "fr")[i % 3], [r.randrange(i % 5 * 40, mixing.SLOTS) for _ in range(r.choice((0, 3, 60, 900)))]) for i in range(1500)]
    x = np.log1p(np.array([np.bincount(s, minlength=mixing.SLOTS) for _, s in rows]))
    x = np.rint(256 * x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12))
    df = spark.createDataFrame(rows, "lang string, slots array<int>")
    got = {k: v for k, v in df.repartition(3).mapInArrow(mixing._products, "k string, v array<bigint>").repartition("k").sortWithinPartitions("k").mapInArrow(mixing._added, "k string, v array<bigint>").filter("k = 'd'").collect()}
    assert got["d"] == [*(x > 0).sum(axis=0).tolist(), len(rows)]
    sums = df.repartition(4).mapInArrow(mixing._products, "k string, v array<bigint>").filter("k like 'g%'").selectExpr("k", "posexplode(v) as (i, x)").groupBy("k", "i").agg(F.sum("x").alias("x"))
    assert [y.x for y in sums.orderBy("k", "i").collect()] == (x.T @ x).astype(int).ravel().tolist()
    assert mixing.topic_table(df, 4) == mixing.topic_table(df.repartition(7), 4)
