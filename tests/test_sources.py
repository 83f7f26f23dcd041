"""Sources, sinks and streams."""

import pytest
from pyspark.sql import functions as F

from tessella.sources import readers, writers
from tessella.streaming.checkpoint import TokenBucket, keep_latest, latest, run_log, upsert_latest


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,text\n1,"two\nlines, ""quoted"""\n2,NA\n3,\n', encoding="utf-8")
    plain = readers.csv(spark, str(p)).orderBy("_ord").collect()
    assert [(r.id, r.text, r._ord) for r in plain] == [("1", 'two\nlines, "quoted"', 0), ("2", "NA", 1), ("3", "", 2)]
    assert [r.text for r in readers.csv(spark, str(p), na="pandas").orderBy("_ord").collect()][1:] == [None, None]


def test_contracts(spark):
    df = spark.createDataFrame([(" a ", "b", 0), (None, "c", 1)], "transliteration string, translation string, _ord long")
    assert [tuple(r)[:2] for r in readers.train(df).collect()] == [("a", "b")]
    assert [tuple(r) for r in readers.flexible(df.drop("translation")).collect()] == [("0", "a", "")]


def test_json_and_log(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"k": 1, "v": "a"}\n{"k": 1, "v": "b"}\n\n{"k": 2, "v": "c"}\n', encoding="utf-8")
    log = readers.with_order(readers.records(spark, str(p), "k long, v string", False).filter("k is not null"))
    assert sorted((r.k, r.v) for r in readers.last_by_key(log, "k", "_ord").collect()) == [(1, "b"), (2, "c")]


def test_replace_and_extend(spark, tmp_path):
    path = str(tmp_path / "t")
    assert writers.current(spark, path) is None
    seen = []
    for n in (3, 5, 7, 9):
        writers.replace_atomically(spark.range(n), path)
        seen.append(writers.current(spark, path))
        assert spark.read.parquet(seen[-1]).count() == n
    assert spark.read.parquet(seen[2]).count() == 7 and len(list((tmp_path / "t").glob("version-*"))) == 2

    def stop():
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):  # a writer that stops before its commit leaves the version before
        writers.replace_atomically(spark.range(11), path, before_commit=stop)
    assert writers.current(spark, path) == seen[3] and spark.read.parquet(seen[3]).count() == 9
    writers.replace_atomically(spark.range(2), path)
    assert spark.read.parquet(writers.current(spark, path)).count() == 2
    both = writers.extended(spark.createDataFrame([("a",)], "x string"), spark.createDataFrame([("b", "c")], "x string, y string"))
    assert sorted(map(tuple, both.collect())) == [("a", ""), ("b", "c")]
    assert spark.range(1).select(writers.formatted(F.lit(1.23456)).alias("x"), writers.formatted(F.lit(None).cast("double")).alias("y")).first() == ("1.235", "")


def test_upsert_survives_a_stop(spark, tmp_path, monkeypatch):
    """A batch whose commit is cut short runs again on the version before; nothing is lost or counted twice."""
    from tessella.streaming import checkpoint

    source, sink, state, schema = str(tmp_path / "in"), str(tmp_path / "last"), str(tmp_path / "s"), "k long, v string, o long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], schema).write.parquet(source)
    upsert_latest(spark, source, schema, sink, state, "k", "o").awaitTermination()
    spark.createDataFrame([(1, "z", 3), (4, "n", 4)], schema).write.mode("append").parquet(source)

    def cut(df, path):
        def stop():
            raise RuntimeError("cut short")

        writers.replace_atomically(df, path, before_commit=stop)

    monkeypatch.setattr(checkpoint, "replace_atomically", cut)
    with pytest.raises(Exception, match="cut short"):
        upsert_latest(spark, source, schema, sink, state, "k", "o").awaitTermination()
    read = lambda: sorted((r.k, r.v) for r in spark.read.parquet(writers.current(spark, sink)).collect())
    assert read() == [(1, "a"), (2, "b")]
    monkeypatch.undo()
    upsert_latest(spark, source, schema, sink, state, "k", "o").awaitTermination()
    assert read() == [(1, "z"), (2, "b"), (4, "n")]


def test_latest_as_state(spark, tmp_path):
    """Stops between batches and a batch written twice change nothing; a batch writes its own keys only; older rows that come late lose."""
    source, sink, state, schema = str(tmp_path / "in"), str(tmp_path / "last"), str(tmp_path / "s"), "k long, o long, v string"
    rounds = [[(1, 1, "a"), (2, 2, "b"), (None, 1, "n")], [(1, 3, "z"), (4, 4, None)], [(1, 2, "late"), (2, 2, "a"), (None, 2, None)]]
    want = {}
    for rows in rounds:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        keep_latest(spark, source, schema, sink, state, "k", "o").awaitTermination()
        for k, o, v in rows:
            want[k] = max(want.get(k, (o, v)), (o, v), key=lambda x: (x[0], x[1] or ""))
        assert {r.k: (r.o, r.v) for r in latest(spark, sink, "k").collect()} == want
    assert spark.read.parquet(f"{sink}/batch=1").count() == 2
    # The last batch's commit is lost: it runs again on the state before it and writes the same rows into the same folder.
    commits = sorted((tmp_path / "s" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    keep_latest(spark, source, schema, sink, state, "k", "o").awaitTermination()
    assert {r.k: (r.o, r.v) for r in latest(spark, sink, "k").collect()} == want and len(list((tmp_path / "last").glob("batch=*"))) == 3


def test_order_over_files(spark, tmp_path):
    for name, rows in (("b", "x,1\nx,2\n"), ("a", "y,3\n"), ("c", 'z,"4\n5"\nz,6\nz,7\n')):
        (tmp_path / f"{name}.csv").write_text("k,v\n" + rows, encoding="utf-8")
    got = readers.csv(spark, str(tmp_path), ["k", "v"]).orderBy("_ord").collect()
    assert [(r.k, r.v, r._ord) for r in got] == [("y", "3", 0), ("x", "1", 1), ("x", "2", 2), ("z", "4\n5", 3), ("z", "6", 4), ("z", "7", 5)]


def test_pdf_words(spark, tmp_path):
    (tmp_path / "one.pdf").write_bytes(b"a b")
    (tmp_path / "none.pdf").write_bytes(b"")
    got = readers.pdf_words(spark, str(tmp_path), lambda raw: [(1, w, 10.0 * i, 10.0 * i + 5, 3.0, 8.0) for i, w in enumerate(raw.decode().split())])
    assert sorted((r.text, r.page, r.x0, r.top) for r in readers.words(got).collect()) == [("a", 1, 0.0, 3.0), ("b", 1, 10.0, 3.0)]


def test_streams(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "k long, v string, o long"
    spark.createDataFrame([(1, "a", 1), (2, "b", 2)], schema).write.parquet(source)
    for _ in range(2):
        run_log(spark, source, schema, str(tmp_path / "log"), str(tmp_path / "s1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    upsert_latest(spark, source, schema, str(tmp_path / "last"), str(tmp_path / "s2"), "k", "o").awaitTermination()
    spark.createDataFrame([(1, "z", 3)], schema).write.mode("append").parquet(source)
    upsert_latest(spark, source, schema, str(tmp_path / "last"), str(tmp_path / "s2"), "k", "o").awaitTermination()
    assert sorted((r.k, r.v) for r in spark.read.parquet(writers.current(spark, str(tmp_path / "last"))).collect()) == [(1, "z"), (2, "b")]


def test_env_and_bucket(tmp_path):
    p = tmp_path / ".env"
    p.write_text("# c\nexport A='1'\nB = two=2\nA=3\n", encoding="utf-8")
    assert readers.env_file(str(p)) == {"A": "1", "B": "two=2"}
    now = [0.0]
    bucket = TokenBucket(60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    assert bucket.take(60) == 0 and abs(bucket.take(30) - 30) < 1e-6
