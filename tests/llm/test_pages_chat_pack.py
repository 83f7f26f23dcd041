"""HTML extraction, chat formatting, packing and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import chat_format, html_extract, labelled_pages, packing
from tessella.llm.queries import ODD_CONVERSATION, op6_best_fit_packing, op8_chat_format, tokenizer_path


def labels_of(nodes):
    out = list(nodes.label)
    for i, p in enumerate(nodes.parent):
        if p >= 0:
            out[i] = out[p] if out[i] < 0 else out[i] & out[p]
    return out


@pytest.fixture(scope="module")
def model():
    return html_extract.trained()


def test_pages_held_out(model):
    wrong = total = 0
    for page in labelled_pages.pages(200, seed=77):
        nodes = html_extract.Nodes(labelled=True)
        html_extract.parse(page, nodes)
        kept = model.marginals(nodes) > 0.5
        for t, k, y in zip(nodes.text, kept, labels_of(nodes), strict=True):
            total += bool(t)
            wrong += bool(t) and bool(k) != bool(y)
    assert wrong < 0.01 * total


def test_messages_equal_enumeration(model):
    nodes = html_extract.Nodes()
    html_extract.parse('<div class="ad"><p>one two three</p></div><article><p>text here</p><ul><li><a href="x">y</a></li></ul></article>', nodes)
    got = model.marginals(nodes)
    n = len(got)
    size, linked = html_extract._total(nodes)
    odds = [sum(model.score.get(f, 0.0) for f in nodes.names[i] + html_extract._measures(nodes.tag[i], size[i], linked[i])) for i in range(n)]
    total, on = 0.0, np.zeros(n)
    for bits in range(1 << n):
        y = [bits >> i & 1 for i in range(n)]
        log = sum(o for o, v in zip(odds, y, strict=True) if v) + (0 if y[0] else -50.0)
        log += sum(model.moves[y[nodes.parent[i]], y[i]] for i in range(1, n))
        total += np.exp(log)
        on += np.exp(log) * np.array(y)
    assert np.allclose(got, on / total, atol=1e-9)


def test_odd_pages(model):
    cases = {
        "": "",
        "plain words only": "plain words only",
        "<article><p>A &amp; B&nbsp;&lt;c&gt;  d\n e<p>two<br>lines</article><footer>&copy; x</footer>": "A & B <c> d e\ntwo lines",
        "<nav><a href=1>m</a></nav><article><h1>T</h1><p>Some <b>bold <i>text</b> in a paragraph.</p><script>var a='<p>no</p>'</script><div class='ad'>Buy this now please.</div><p>End of it all.</p></article><section id=comments><h3>Comments</h3><div class=comment><p>I liked this very much, thank you.</p></div></section>": "T\nSome bold text in a paragraph.\nEnd of it all.",
        "<article><p>1 < 2 and a<b</p><!-- open comment <p>x</p>": "1 < 2 and a",
        "<style>p{}": "",
    }
    got = html_extract.extract_texts(list(cases), model)
    assert got[:4] == list(cases.values())[:4] and got[5] == ""
    deep = "<div>" * 3000 + "text"
    assert len(html_extract.extract_texts([deep], model)) == 1


def test_unclosed_unseen(model):
    body = "<article><h1>Title</h1><p>Some text in a paragraph that is long enough.</p><p>And more of it in another one.</p></article>"
    want = html_extract.extract_texts([body], model)[0]
    assert want.count("\n") == 2
    heads = ["<html><head><title>T</title>", "<head><meta charset=utf-8><link href=a>", "<head><!-- </head> --><script>a='<p>'</script>", "<head><title>T</title></head><body>", "<head><title>T</head><body>", "<svg width=1 />", "<math/>"]
    for tag in ("object", "iframe", "noscript", "button", "select", "map", "video", "canvas", "svg", "audio", "template"):
        heads += [f"<{tag}>", f"<{tag} a='b' />", f"<div><{tag}>unseen words</div>"]
    heads += ["<button>Menu", "<button>A</button><button>B<button>C</button>", "<object><object>x</object>y<p>fallback</p></object>"]
    for head, got in zip(heads, html_extract.extract_texts([h + body for h in heads], model), strict=True):
        assert got == want, head
    assert html_extract.extract_texts(["<script>" + body, "<head><style>" + body, "<button>Menu</button>"], model) == ["", "", ""]
    assert html_extract.extract_texts(["<p>Words that come before it all.</p>" + "<button>" * 20_000], model) == ["Words that come before it all."]


def test_labels_of_real_pages_say_nothing(model):
    body = "<article><h1>Title</h1><p>Some text in a paragraph that is long enough.</p></article>"
    want = html_extract.extract_texts([body], model)[0]
    odd = [body.replace("<article", f"<article data-y={y}") for y in ("left", "0", "", "'1 2'")]
    assert html_extract.extract_texts(odd, model) == [want] * 4


def test_odd_tags_take_linear_time(model):
    import time

    parts = ["<a ", "<a '", '<a "\'', "<div></p></span>", "<div><li></li>", "</x>", "<!-- ", "<button>", "<li><ul><div><li></li>", '<a ">', "<td><table>", "<a <b '>'", "&amp", "<title>"]
    began = time.time()
    for part in parts:
        assert len(html_extract.extract_texts([part * 20_000 + "<p>end</p>"], model)) == 1
    assert time.time() - began < 60


def test_tags_as_the_pattern_says():
    """Against the definition as one regular expression."""
    import re

    pattern = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
    r = random.Random(5)
    for _ in range(3000):
        page = "".join(r.choice(("<a", "</b", "<!--", "-->", "<!x", "<", ">", '"', "'", " ", "c", "=", "<p>")) for _ in range(r.randint(0, 24)))
        tags, at, got = html_extract.Tags(page), 0, []
        while found := tags.after(at):
            got.append(found)
            at = found[1]
        want = [(m.start(), m.end(), bool(m[1] or m[4]), (m[2] or m[5] or "").lower(), m[3] or m[6] or "") for m in pattern.finditer(page)]
        assert got == want, page


def article_of(page):
    """The text of the pages of the table, by what their author wrote: blocks of the article that are neither advert nor comment."""
    import html
    import re

    inner = page[page.index("<article") : page.index("</article>")]
    inner = re.sub(r"<!--.*?-->|<script.*?</script>|<style.*?</style>|<form.*?</form>", " ", inner, flags=re.S)
    assert not re.search(r"<(?:div|aside|nav|section)", inner), inner
    blocks = re.split(r"<(?:/?(?:article|p|h[1-6]|ul|ol|li|blockquote|pre|table|tr|td|div))\b[^>]*>", inner)
    texts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?!br)[a-z][^>]*>", "", b))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


def test_pages_of_the_table(spark, model):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html and "<article" in r.html and "</article>" in r.html]
    got = html_extract.extract_texts(pages, model)
    right = sum(a == article_of(b) for a, b in zip(got, pages, strict=True))
    assert right >= 0.98 * len(pages) and len(pages) > 100


def test_extract_frame(spark, model):
    df = spark.createDataFrame([(1, "u", "<article><p>some text that is here</p></article>", "z"), (2, None, None, "z"), (2, None, None, "z")], "page_id long, url string, html string, text string")
    rows = sorted((r.page_id, r.text, r.n_chars) for r in html_extract.extract(df, model).collect())
    assert rows == [(1, "some text that is here", 22), (2, "", 0), (2, "", 0)]
    assert html_extract.extract(df.limit(0), model).collect() == []


def conversations(seed=3):
    r = random.Random(seed)
    odd = ["\\", "#", "<", ":", "### Assistant: ", "</turn>", "\n", "\\h", "é", " "]
    rows = [(c, t, role, x) for c, t, role, x in ODD_CONVERSATION]
    for c in range(25):
        if r.random() < 0.5:
            rows.append((c, 0, "system", "be " * r.randint(1, 90)))
        for t in range(1, r.randint(2, 40)):
            text = "".join(r.choice(odd) for _ in range(r.randint(0, 30))) + "word " * r.choice((0, 5, 60, 400))
            rows.append((c, t, r.choice(("user", "assistant", "assistant", "odd:role", None)), r.choice((text, text, text, None))))
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(0, 6000, 3)] + [(501, 0, "system", "s " * 600), (501, 1, "user", "u"), (501, 2, "assistant", "v")]
    rows += [(502, 0, "user", "u"), (502, 1, "assistant", "long " * 100_000), (502, 2, "user", "w")]
    return rows + [(None, 1, "user", "no id"), (None, 2, "assistant", "yes"), (77, 1, "assistant", "same"), (77, 1, "assistant", "same")]


def test_chat_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame([(*x, "k", "w") for x in rows], "conv_id long, turn long, role string, text string, kind string, window string")
    made = chat_format.windows(df, budget=200, history=60)
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    escape = lambda x: (x or "").replace("\\", "\\b").replace("#", "\\h").replace("<", "\\l")
    turns_of = {c: sorted((t, "### " + escape(role).replace(":", "\\c") + ": ", escape(x), role or "", x or "") for i, t, role, x in rows if i == c) for c in {x[0] for x in rows}}
    for c, own in turns_of.items():
        assert [(t.role, t.text) for t in back[c].turns] == [(x[3], x[4]) for x in own]
        assert back[c].targets == "".join(x[4] for x in own if x[3] == "assistant")
    per = Counter()
    for w in made.collect():
        per[w.conv_id] += len(w.text)
        turns = w.text.split("</turn>\n")[:-1]
        sizes = [-(-(len(t) + 8) // 4) for t in turns]
        fixed = sum(-(-(len(h) + len(b) + 8) // 4) for _, h, b, role, _ in turns_of[w.conv_id] if role == "system")
        own = [n for t, n in zip(turns, sizes, strict=True) if not t.startswith("### system: ")][-(len(turns) - w.n_repeated) :]
        assert sum(sizes) <= 200 or fixed + max(own, default=0) > 200
        assert sum(n for t, n in zip(turns[: w.n_repeated], sizes, strict=False) if not t.startswith("### system: ")) <= 60
        for s in w.loss:
            assert w.text[: s.start].rpartition("### ")[2] == "assistant: " and w.text[s.end :].startswith("</turn>\n")
    assert all(back[c].formatted_chars == per[c] for c in back)
    assert chat_format.read_back(chat_format.windows(df.limit(0))).collect() == []


def test_packing(spark):
    r = random.Random(6)
    texts = [(i, " ".join(r.choice(("alpha", "beta's", "12", "…", "x\n\ny")) for _ in range(r.choice((1, 9, 80, 300, 1500))))) for i in range(150)]
    texts += [(1000, None), (1001, ""), (1001, ""), (1002, "word " * 6000), (1003, "a <|endoftext|> b"), (1004, "<|endoftext|>" * 700 + " x"), (1005, "<|endoftext")]
    df = spark.createDataFrame([(i, t, 1, "z") for i, t in texts], "doc_id long, text string, length long, shard string")
    got = packing.pack(df, tokenizer_path(), capacity=512, shard=60).collect()
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        n = -(-len(ids) // 512)
        for k in range(n):
            a, b = max(0, len(ids) - (n - k) * 512), len(ids) - (n - k - 1) * 512
            want[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in got) == want
    rows: dict[int, list] = {}
    for x in got:
        rows.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in rows.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    total = sum(x.length for x in got)
    assert 50256 in tok.encode("a <|endoftext|> b", add_special_tokens=False).ids
    shards = -(-len(got) // 60)
    assert len(rows) <= -(-total // 512) + shards
    assert packing.pack(df.limit(0), tokenizer_path()).collect() == []


def best_fit(lengths, capacity):
    """Sequences that plain best fit needs, the longest first."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= x), default=None)
        if fit is None:
            rooms.append(capacity - x)
        else:
            rooms.remove(fit)
            rooms.append(fit - x)
    return len(rooms)


@pytest.mark.parametrize(("low", "high", "n"), [(100, 2049, 3000), (1, 300, 3000), (600, 700, 1500), (700, 1400, 2000), (1, 2049, 200)])
def test_plan_needs_no_more_than_best_fit(low, high, n):
    pieces = np.random.default_rng(n).integers(low, high, n)
    lengths, counts = np.unique(pieces, return_counts=True)
    plan = packing.configurations(lengths, counts)
    assert all((sum(c * t for c, t in plan) <= counts).tolist()) if plan else True
    sequence, _ = packing.pack_lengths(pieces, lengths, plan)
    assert sequence.min() >= 0 and np.bincount(sequence, pieces).max() <= 2048
    assert sequence.max() + 1 <= best_fit(pieces.tolist(), 2048)


def test_plan_beats_best_fit():
    """Lengths whose best configurations best fit doesn't find."""
    pieces = np.repeat([1024, 700, 680, 668, 345, 341, 338], [10, 300, 300, 300, 200, 200, 200])
    lengths, counts = np.unique(pieces, return_counts=True)
    sequence, _ = packing.pack_lengths(pieces, lengths, packing.configurations(lengths, counts))
    assert sequence.max() + 1 < best_fit(pieces.tolist(), 2048)


def test_knapsack_brute_force():
    from itertools import product

    r = np.random.default_rng(1)
    for _ in range(30):
        lengths = np.sort(r.choice(np.arange(2, 20), 4, replace=False))
        counts, price = r.integers(0, 5, 4), r.random(4)
        got = packing.knapsack(price, lengths, counts, 40)
        best = max(price @ np.array(c) for c in product(*(range(n + 1) for n in counts)) if lengths @ np.array(c) <= 40)
        assert (got <= counts).all() and lengths @ got <= 40 and abs(price @ got - best) < 1e-9


@pytest.mark.parametrize(("sf", "most"), [("sf0.01", 481), ("sf0.1", 4936)])
def test_packing_the_documents(spark, sf, most):
    got = op6_best_fit_packing(spark, f"/root/testdata/{sf}").selectExpr("count(distinct sequence_id) as n", "sum(length) as total").first()
    assert got.n <= most and got.n >= -(-got.total // 2048)


def test_chat_sql_on_small_budgets(spark):
    import duckdb

    from tessella.llm.queries import SQL

    got = op8_chat_format(spark, "/root/testdata/sf0.001").toPandas()
    db = duckdb.connect()
    db.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.001/conversations.parquet'")
    want = db.execute(SQL["op8_chat_format"]).df()
    keys = list(got.columns)
    assert sorted(map(tuple, got[keys].to_numpy().tolist())) == sorted(map(tuple, want[keys].to_numpy().tolist()))


def test_chat_query_has_the_odd_conversation(spark):
    rows = op8_chat_format(spark, "/root/testdata/sf0.001").filter("conv_id = -7").collect()
    assert len(rows) == 1 and rows[0].n_turns == 2 and rows[0].loss_chars == len(ODD_CONVERSATION[1][3])


def lines_kept(docs):
    """Line dedup by brute force, the texts that are left."""
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    key = lambda x: x.strip(" \t\n\v\f\r").translate(low)
    holders: dict[str, set] = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 40 or len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        if len(kept) == len(lines) or "\n".join(kept).strip(" "):
            out[i] = "\n".join(kept)
    return out


def test_pipeline(spark):
    """Each stage on its predecessor's result against brute force, then run() against the stages."""
    import corpus_pipeline as p
    from test_dedup import classes_of

    where = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{where}/documents.parquet")
    seen = [docs]
    for name, stage in p.STAGES:
        out = stage(spark, seen[-1], where)
        if name != "packing":
            assert out.columns == docs.columns
        seen.append(out.cache())
    named, lines, deduped, mixed, packed = seen[1:]
    has_letter = lambda t: any(c.isalpha() for c in t or "")
    assert {r.doc_id: r.text for r in named.collect()} == {r.doc_id: r.text for r in docs.collect() if has_letter(r.text)}
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert texts == lines_kept([(r.doc_id, r.text) for r in named.collect()]) and len(texts) >= 0.9 * named.count()
    classes = classes_of(list(texts.items()))
    assert {r.doc_id: r.text for r in deduped.collect()} == {i: t for i, t in texts.items() if classes[i] == i}
    kept = {r.doc_id for r in mixed.collect()}
    from tessella.llm import mixing

    odds = {r.doc_id: r for r in mixing.weights(deduped).collect()}
    assert kept == {i for i, r in odds.items() if r.sampled}
    rows = packed.collect()
    assert {r.doc_id for r in rows} == kept
    assert sum(r.length for r in rows if r.piece == 0 or r.start) == sum(r.length for r in rows)
    content = lambda rows: Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert content(p.run(spark, where).collect()) == content(rows)


def test_stages_on_odd_rows(spark):
    import corpus_pipeline as p

    odd = spark.createDataFrame([(None, None, None, None, None, "e"), (5, "", None, None, 0, "e"), (6, "words of a text that is kept here", None, None, None, "e"), (6, "words of a text that is kept here", None, None, None, "e"), (7, "other words " * 50_000, "en", "s", 5, "e")], "doc_id long, text string, lang string, source string, n_chars long, d string")
    for k, (_, stage) in enumerate(p.STAGES):
        for rows in (odd, odd.limit(0)):
            out = stage(spark, rows, "")
            assert out.count() <= 200 * rows.count() and (k == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars"])


def test_many_system_turns_stay_linear(spark):
    """Twice the system turns, twice the output; the last ones that fit are repeated, all stand once."""

    def formatted(n):
        rows = [(1, 2 * i + k, role, f"{role} {i} " + "word " * 60) for i in range(n) for k, role in enumerate(("system", "assistant"))]
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        made = chat_format.windows(df)
        back = chat_format.read_back(made).collect()
        assert [(t.role, t.text) for t in back[0].turns] == [(r, x) for _, _, r, x in rows]
        assert back[0].targets == "".join(x for _, _, r, x in rows if r == "assistant")
        repeats = {w.text.count("### system: ") for w in made.collect()}
        assert max(repeats) < 20
        return back[0].formatted_chars, sum(len(x) for *_, x in rows)

    (one, own), (two, _) = formatted(60), formatted(120)
    assert two < 2.5 * one and one < 12 * own


def test_a_document_of_white_space_left_goes(spark, tmp_path):
    import corpus_pipeline as p

    line = "a line of more than forty code points that repeats " * 2
    rows = [(i, f"{line}\n\n\t\x0b" if i < 6 else f"{line}\nown words", "en", "s", 1) for i in range(8)] + [(9, " \n\t", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in p.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {6: "own words", 7: f"{line}\nown words", 9: " \n\t"}
