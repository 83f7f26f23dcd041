"""Erasure against a plain Python version over pyarrow tables."""

import hashlib
import math
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessella.llm import erasure
from tessella.llm.queries import op11_erasure_rewrite
from tessella.session import scratch

SF = "/root/testdata/sf0.001"
KEY = {"clients": "client_id", "clicks": "client_id", "sales": "client_id"}


def crc(v):
    return zlib.crc32(b"" if v is None else str(v).encode())


def brute(tables, parts=350, modulus=400):
    """Rows of each file, before and after, as lists of tuples by (table, file)."""
    rows = {t: [tuple(r.values()) for r in x.to_pylist()] for t, x in tables.items()}
    at = {t: {c: i for i, c in enumerate(x.column_names)} for t, x in tables.items()}
    col = lambda t, r, c: r[at[t][c]]
    owner = {}
    for r in rows["sales"]:
        s, c = col("sales", r, "sale_id"), col("sales", r, "client_id")
        if s is not None and (owner.get(s) is None or (c is not None and c < owner[s])):
            owner[s] = c
    clicks = Counter(col("clicks", r, "client_id") for r in rows["clicks"])
    pairs = {(col("clients", r, "master_id"), col("clients", r, "client_id")) for r in rows["clients"] if col("clients", r, "master_id") is not None}
    per = Counter()
    for m, c in pairs:
        per[m] += clicks[c] if c is not None else 0
    masters = {m for m in per if crc(m) % modulus == 0} | ({min(per, key=lambda m: (-per[m], m))} if per else set())
    gone_clients = {c for m, c in pairs if m in masters and c is not None}
    gone_sales = {col("sales", r, "sale_id") for r in rows["sales"] if col("sales", r, "client_id") in gone_clients} - {None}
    victim = {
        "clients": lambda r: col("clients", r, "master_id") in masters,
        "clicks": lambda r: col("clicks", r, "client_id") in gone_clients,
        "sales": lambda r: col("sales", r, "client_id") in gone_clients,
        "sale_lines": lambda r: col("sale_lines", r, "sale_id") in gone_sales,
    }
    out = {}
    for t, own in rows.items():
        first = lambda r: crc(owner.get(col(t, r, "sale_id")) if t == "sale_lines" else col(t, r, KEY[t]))  # noqa: B023, E731
        own = sorted(own, key=lambda r: (first(r), tuple((v is not None, v) for v in r)))
        size = 1 + len(own) // parts
        for k in range(0, len(own), size):
            part = own[k : k + size]
            out[t, k // size] = (part, [r for r in part if not victim[t](r)])
    return out, at


def check(got, tables, **args):
    want, at = brute(tables, **args)
    rows = {(r.table_name, r.file_no): r for r in got}
    assert set(rows) == {k for k, (_, left) in want.items() if left}
    for (t, k), r in rows.items():
        before, left = want[t, k]
        assert (r.n_rows, r.n_erased, r.rewritten) == (len(left), len(before) - len(left), len(before) > len(left))
        assert r.ids_sha256 == hashlib.sha256(",".join("" if x[0] is None else str(x[0]) for x in left).encode()).hexdigest()
        money = at[t][erasure.MONEY[t]]
        assert r.cents == sum(math.floor(100 * x[money] + 0.5) for x in left if x[money] is not None and math.isfinite(x[money]))
        assert r.columns == ",".join(tables[t].column_names)
        file = pq.ParquetFile(r.path.removeprefix("file://").replace("file:", ""))
        assert [tuple(x.values()) for x in file.read().to_pylist()] == left
        stats = [file.metadata.row_group(g).column(0).statistics for g in range(file.metadata.num_row_groups)]
        ids = [x[0] for x in left if x[0] is not None]
        if ids:
            assert min(s.min for s in stats if s.has_min_max) == min(ids) and max(s.max for s in stats if s.has_min_max) == max(ids)
    return rows


def test_query_against_brute_force(spark):
    tables = {t: pq.read_table(f"{SF}/{t}.parquet") for t in erasure.MONEY}
    rows = check(op11_erasure_rewrite(spark, SF).collect(), tables)
    root = next(iter(rows.values())).path.split("/clients/")[0].split("/clicks/")[0].split("/sales/")[0].split("/sale_lines/")[0]
    assert erasure.data_files(root) == sorted(r.path.removeprefix("file://").replace("file:", "") for r in rows.values())


def write(folder, t, rows, schema):
    os.makedirs(folder, exist_ok=True)
    table = pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
    pq.write_table(table, f"{folder}/{t}.parquet")
    return table


@pytest.mark.parametrize("most", [500_000, 0])
def test_odd_rows(spark, tmp_path, monkeypatch, most):
    """Nulls, repeated rows, a sale that comes twice, no sale, extra columns, several row groups and emptied files; victims broadcast and not."""
    monkeypatch.setattr(erasure, "BROADCAST_KEYS", most)
    monkeypatch.setattr(erasure.members, "__defaults__", (most,))
    rng = np.random.default_rng(2)
    long, text, real = pa.int64(), pa.string(), pa.float64()
    pick = lambda n, hi: [None if v == 0 else int(v) for v in rng.integers(0, hi, n)]
    clients = [(i if i % 11 else None, m, b, "x" * (100_000 if i == 5 else 1)) for i, (m, b) in enumerate(zip(pick(300, 40), rng.normal(size=300), strict=True))]
    clicks = [(i, c, float("nan") if i % 7 == 0 else None if i % 5 == 0 else float(i)) for i, c in enumerate(pick(3000, 300))]
    clicks += clicks[:50] + [(9999, 17, 1.0)] * 700
    sales = [(s, c, 1.25) for s, c in zip(pick(900, 500), pick(900, 300), strict=True)]
    lines = [(s, n, None if n == 3 else 2.5) for s, n in zip(pick(4000, 700), pick(4000, 5), strict=True)]
    tables = {
        "clients": write(tmp_path, "clients", clients, pa.schema([("client_id", long), ("master_id", long), ("balance", real), ("file_no", text)])),
        "clicks": write(tmp_path, "clicks", clicks, pa.schema([("click_id", long), ("client_id", long), ("value", real)])),
        "sales": write(tmp_path, "sales", sales, pa.schema([("sale_id", long), ("client_id", long), ("total", real)])),
        "sale_lines": write(tmp_path, "sale_lines", lines, pa.schema([("sale_id", long), ("position", long), ("amount", real)])),
    }
    # NaN is unequal to itself in Python: its rows are compared as None.
    monkeypatch.setattr(pq.ParquetFile, "read", lambda self, read=pq.ParquetFile.read: _plain(read(self)))
    got = erasure.erase_shop({t: spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in erasure.MONEY}, scratch(spark, "erased"), parts=40, modulus=9).collect()
    rows = check(got, {t: _plain(x) for t, x in tables.items()}, parts=40, modulus=9)
    assert any(r.rewritten for r in rows.values()) and any(not r.rewritten for r in rows.values())


def _plain(table):
    for i, f in enumerate(table.schema):
        if pa.types.is_floating(f.type):
            table = table.set_column(i, f.name, pa.array([None if v is None or v != v else v for v in table.column(i).to_pylist()], f.type))
    return table


def test_empty_tables(spark):
    empty = {t: spark.read.parquet(f"{SF}/{t}.parquet").limit(0) for t in erasure.MONEY}
    assert erasure.erase_shop(empty, scratch(spark, "erased")).collect() == []
    one = empty | {"clicks": spark.read.parquet(f"{SF}/clicks.parquet").limit(3)}
    got = erasure.erase_shop(one, scratch(spark, "erased")).collect()
    assert {(r.table_name, r.n_rows, r.rewritten) for r in got} == {("clicks", 1, False)} and len(got) == 3


def test_masks_in_order():
    gone = {0: [3, 32767], 2: [0, 5]}
    maps = []
    for bucket, places in gone.items():
        bits = np.zeros(erasure.BITMAP, bool)
        bits[places] = True
        maps.append((bucket, zlib.compress(np.packbits(bits, bitorder="little").tobytes())))
    mask, n = erasure._Mask(iter(maps)), 100_000
    got = np.concatenate([mask.stays(i, min(1000, n - i)) for i in range(0, n, 1000)])
    assert np.flatnonzero(~got).tolist() == [3, 32767, 2 * erasure.BITMAP, 2 * erasure.BITMAP + 5] and mask.erased == 4
