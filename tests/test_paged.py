import base64
import random
import re
import struct
import zlib

import numpy as np
import pytest

from tessella.sources import paged


def read_png(url: str) -> np.ndarray:
    raw = base64.b64decode(url.removeprefix("data:image/png;base64,"))
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at, data = 8, b""
    while at < len(raw):
        (n,), kind = struct.unpack(">I", raw[at : at + 4]), raw[at + 4 : at + 8]
        body = raw[at + 8 : at + 8 + n]
        assert struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        data += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, width + 1)[:, 1:]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Files of many, one and no page, with and without a last form feed, letters of two and four bytes, empty pages, a page longer than a split."""
    rng, at = random.Random(3), tmp_path_factory.mktemp("pages")
    files = {}
    for name, n, last in (("a", 90, True), ("b", 1, False), ("c", 3, False), ("d", 60, True)):
        pages = ["\n".join("".join(rng.choice("  ab\tcé𐎀") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(6))) for _ in range(n)]
        pages[-1] += "end"
        files[name] = pages if name != "c" else [pages[0], "", "word " * 3000]
        (at / name).write_bytes("\f".join(files[name]).encode() + b"\f" * last)
    (at / "none").write_bytes(b"")
    (at / "_SUCCESS").write_bytes(b"x\fy")
    return at, files


def expected(files: dict) -> list:
    return sorted((name, k, m[0], m.start() * 6.0, m.end() * 6.0, i * 12.0, i * 12.0 + 12) for name, pages in files.items() for k, page in enumerate(pages, 1) for i, line in enumerate(page.split("\n")) for m in re.finditer(r"[^ \t]+", line))


def rows(df) -> list:
    return sorted((r.path.rsplit("/", 1)[1], *r[1:]) for r in df.collect())


def test_words_by_page_ranges(spark, folder, tmp_path):
    at, files = folder
    want = expected(files)
    assert rows(paged.words(spark, str(at))) == want
    pages = paged.index(spark, str(at), str(tmp_path / "index"), split_mb=0.0005)
    told = spark.read.parquet(pages)
    assert told.count() > 20 and sorted((p.rsplit("/", 1)[1], n) for p, n in told.groupBy("path").sum("pages").collect()) == [(k, len(v)) for k, v in sorted(files.items())]
    assert rows(paged.words(spark, str(at), pages)) == want
    some = paged.words(spark, str(at), pages).filter("page >= 2 and page < 61 and x0 > 6")
    assert rows(some) == [x for x in want if 2 <= x[1] < 61 and x[3] > 6]
    one = paged.words(spark, str(at), pages).filter("page = 70")
    assert rows(one) == [x for x in want if x[1] == 70]
    assert rows(paged.words(spark, str(at), pages).filter("page in (1, 90) or page is null")) == [x for x in want if x[1] in (1, 90)]


def test_filter_picks_ranges(spark, folder, tmp_path):
    at, _ = folder
    pages = paged.index(spark, str(at), str(tmp_path / "index"), split_mb=0.0005)
    reader = paged.PagesReader({"path": str(at), "index": pages, "split_mb": "0.0005"})
    everything = sum(len(p.ranges) for p in reader.partitions())
    assert list(reader.pushFilters([paged.D.EqualTo(("page",), 88), paged.D.GreaterThan(("x0",), 3.0)])) == [paged.D.GreaterThan(("x0",), 3.0)]
    left = [r for p in reader.partitions() for r in p.ranges]
    assert 1 == len(left) < everything and left[0][0].endswith("/a")


def test_every_cut(tmp_path):
    """Pages by ranges are those of the file, wherever it is cut and read on."""
    raw = b"ab\f\fc\f\f\fdef"
    (tmp_path / "f").write_bytes(raw)
    for cut in range(1, len(raw)):
        for chunk in (1, 2, 3, 100):
            with (tmp_path / "f").open("rb") as h:
                parts = [list(paged.pages_between(h, a, b, chunk)) for a, b in ((0, cut), (cut, len(raw)))]
                assert parts[0] + parts[1] == raw.split(b"\f")
                assert [paged.count_pages(h, 0, cut), paged.count_pages(h, cut, len(raw))] == [len(x) for x in parts]


def test_images(spark, folder):
    at, files = folder
    got = {(r.path.rsplit("/", 1)[1], r.page): r for r in paged.images(spark, str(at), wrap=12).collect()}
    assert len(got) == sum(map(len, files.values()))
    for (name, page), r in got.items():
        lines = [line[i : i + 12] for line in files[name][page - 1].split("\n") for i in range(0, max(len(line), 1), 12)]
        width = max(1, *map(len, lines))
        assert (r.width, r.height) == (width, len(lines))
        assert read_png(r.url).tolist() == [[255 if c in " \t" else 0 for c in line.ljust(width)] for line in lines]


def test_written_pages(spark, tmp_path):
    paged.write(spark.createDataFrame([("a\fb\nc",), (None,), ("",)], "text string").coalesce(1), str(tmp_path / "out"))
    got = [(r.page, r.text, r.x0, r.top) for r in paged.words(spark, str(tmp_path / "out")).orderBy("page", "top", "x0").collect()]
    assert got == [(1, "a", 0.0, 0.0), (1, "b", 12.0, 0.0), (1, "c", 0.0, 12.0)]
    spark.createDataFrame([], "text string").write.text(str(tmp_path / "empty"))
    assert paged.words(spark, str(tmp_path / "empty")).collect() == [] and paged.images(spark, str(tmp_path / "empty")).collect() == []
