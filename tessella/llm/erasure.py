"""Cascading erasure from written Parquet files by deletion vectors.

`lay_out` writes tables as files of consecutive rows of a global order: rows are dealt by range and sorted, numbered by the counts of the
ranges before, dealt to their files and written one file a task, streaming. `erase` scans the written files' keys, semi-joins the victims to
(file, position), adds the positions up to bitmaps of 32,768 positions and compresses these: a file's deletion vector. Files that have one
are rewritten by one task each: Arrow tables are read in turn, the bitmaps applied as numpy masks, and what is left is written to a new file
that gets its name when it is whole. So a task that runs twice makes the same file twice; old files go only when all new ones are there.
Victims cascade: the victims' keys in one table are the victims of the tables that refer to it. `digest` reads the files back, in order.

Defined cases: nulls come first in the order, null keys belong to no victim, and rows equal in all columns stand next to each other; a child's
parent that comes twice counts once, its smallest owner decides the order; an empty table has no files; extra columns are kept whatever their names, but for tessella_file and names
that begin with two underscores, which are this module's own; texts of any length are written whole. A money column's null, NaN and infinite values count 0.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.skew import lookup_hot
from tessella.session import materialize, passing, remove, settle, ship

PARTS, FOLDER = 350, "tessella_file"
#: Positions of one bitmap; and the rows and bytes that a rewriting task holds before it writes them.
BITMAP, ROWS, BYTES = 1 << 15, 1 << 17, 64 << 20
#: Victims up to so many keys are broadcast; beyond, the semi join shuffles.
BROADCAST_KEYS = 500_000


@dataclass(frozen=True)
class Link:
    """Victims of table are the rows whose key is the parent_key of a victim of parent."""

    table: str
    key: str
    parent: str
    parent_key: str


def decimal_crc(key: str | Column) -> Column:
    """crc32 of a key as decimal text; null counts as an empty text."""
    return F.crc32(F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit("")).cast("binary"))


def owners_crc(child: DataFrame, parent: DataFrame, key: str, owner: str) -> DataFrame:
    """child with `__crc`, the crc32 of its parent's owner; children of one parent may be a large share of all."""
    sizes = child.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    own = parent.groupBy(F.col(key).alias("__key")).agg(F.min(owner).alias("__owner"))
    right = materialize(sizes.join(own, "__key").select("__key", "__n", decimal_crc("__owner").alias("__found")), "owners")
    rows = child.select(F.struct(*child.columns).alias("__row"), F.col(key).alias("__key"))
    return lookup_hot(rows, right, ["__key"], "__n", F.col("__row")).select("__row.*", F.coalesce("__found", F.crc32(F.lit("").cast("binary"))).alias("__crc"))


def lay_out(rows: DataFrame, columns: list[str], path: str, parts: int = PARTS) -> int:
    """Writes rows, in the order of `__crc` and then all columns, as files of 1 + floor(n / parts) rows under path; gives the number of files."""
    order = [F.col("__crc"), *(F.col(f"`{c}`") for c in columns)]
    sort = [c.asc_nulls_first() for c in order]
    placed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())
    placed = materialize(placed, "ranges")
    counts = placed.groupBy("__range").agg(F.count("*").alias("__c"))
    before = counts.select("__range", (F.sum("__c").over(W.orderBy("__range")) - F.col("__c")).alias("__before"))  # a row a range
    n = counts.agg(F.sum("__c")).first()[0] or 0
    if not n:
        return 0
    size = 1 + n // parts
    files = -(-n // size)
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("__before")
    numbered = placed.join(F.broadcast(before), "__range").withColumn("__place", place).withColumn(FOLDER, F.expr(f"int(__place div {size})"))
    whole = numbered.repartitionById(files, F.col(FOLDER)).sortWithinPartitions(FOLDER, "__place")
    whole.select(*(F.col(f"`{c}`") for c in columns), FOLDER).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(FOLDER).parquet(path)
    return files


def _number(path: str) -> int:
    return int(re.search(rf"{FOLDER}=(\d+)/", path)[1])


def list_files(spark: SparkSession, path: str, schema: str) -> list[tuple[str, int]]:
    """(path, file_no) of a table's files: as many as the layout has parts."""
    return [(p, _number(p)) for p in spark.read.schema(schema).parquet(path).inputFiles()]


def members(scan: DataFrame, key: str, victims: DataFrame, also: list[str], most: int = BROADCAST_KEYS) -> DataFrame:
    """(file_no, position, also...) of the rows whose key is one of victims (one column, distinct)."""
    places = scan.select(F.col(key).alias("__key"), F.col(FOLDER).alias("file_no"), F.col("_metadata.row_index").alias("position"), *also).filter(F.col("__key").isNotNull())
    keys = victims.toDF("__key")
    if keys.count() <= most:
        return places.join(F.broadcast(keys), "__key", "left_semi").drop("__key")
    sizes = materialize(places.groupBy("__key").agg(F.count("*").alias("__n")).join(keys, "__key", "left_semi"), "victims")
    return lookup_hot(places, sizes, ["__key"], "__n", F.struct("file_no", "position")).filter("__n IS NOT NULL").drop("__key", "__n")


def deletion_vectors(hits: DataFrame) -> DataFrame:
    """(file_no, bucket, bits): the compressed bitmaps of each file's positions, of BITMAP each."""
    at = F.col("position") + 1
    maps = hits.groupBy("file_no", (F.bitmap_bucket_number(at) - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zlib.compress(x.as_py()) for x in b.column(2)], pa.binary())], ["file_no", "bucket", "bits"])

    return maps.mapInArrow(pack, "file_no int, bucket long, bits binary")


class _Mask:
    """Whether the rows of a file stay, asked for in order; holds one bitmap at a time."""

    def __init__(self, maps: Iterator[tuple[int, bytes]]):
        self.maps, self.erased = maps, 0
        self._next()

    def _next(self) -> None:
        bucket, bits = next(self.maps, (None, b""))
        self.start = None if bucket is None else bucket * BITMAP
        self.gone = np.unpackbits(np.frombuffer(zlib.decompress(bits), np.uint8), bitorder="little").astype(bool) if bits else None

    def stays(self, start: int, n: int) -> np.ndarray:
        out = np.ones(n, bool)
        while self.start is not None and self.start < start + n:
            lo, hi = max(start, self.start), min(start + n, self.start + BITMAP)
            if lo < hi:
                out[lo - start : hi - start] = ~self.gone[lo - self.start : hi - self.start]
            if self.start + BITMAP > start + n:
                break
            self._next()
        self.erased += n - int(out.sum())
        return out


def _schema(file: pq.ParquetFile) -> pa.Schema:
    """The file's Arrow schema; instants that Spark keeps as INT96 stay instants."""
    old = {file.schema.column(i).path for i in range(len(file.schema)) if file.schema.column(i).physical_type == "INT96"}
    fields = [f.with_type(pa.timestamp("us", tz="UTC")) if f.name in old else f for f in file.schema_arrow]
    return pa.schema(fields, file.schema_arrow.metadata)


def rewrite_file(path: str, maps: Iterator[tuple[int, bytes]], staging: str) -> tuple[str | None, int]:
    """Writes what the bitmaps (bucket, bits; in order) leave of a file to a new one beside it, by way of the staging folder of the same
    file system; its path, None if no row is left, and how many rows went."""
    fs, source = FileSystem.from_uri(path)
    target = f"{source.rpartition('/')[0]}/kept-{_number(path):06d}.parquet"
    folder = FileSystem.from_uri(staging)[1]
    part = f"{folder}/{uuid.uuid4().hex}"
    fs.create_dir(folder)
    mask, start, held, writer, kept = _Mask(maps), 0, [], None, 0
    with fs.open_input_file(source) as handle:
        file = pq.ParquetFile(handle, coerce_int96_timestamp_unit="us")
        schema = _schema(file)

        def flush() -> None:
            nonlocal writer
            if held:
                writer = writer or pq.ParquetWriter(part, schema, filesystem=fs)
                writer.write_table(pa.Table.from_batches(held))
                held.clear()

        try:
            for batch in file.iter_batches(BITMAP):
                stays = mask.stays(start, batch.num_rows)
                start += batch.num_rows
                left = pa.Table.from_batches([batch]).filter(pa.array(stays)).cast(schema)
                held += [b for b in left.to_batches() if b.num_rows]
                kept += left.num_rows
                if sum(b.num_rows for b in held) >= ROWS or sum(b.nbytes for b in held) >= BYTES:
                    flush()
            flush()
        finally:
            if writer:
                writer.close()
    if not writer:
        return None, mask.erased
    fs.move(part, target)
    return path.rpartition("/")[0] + "/" + target.rpartition("/")[2], mask.erased


def _rewritten(files: DataFrame, vectors: DataFrame, tasks: int, staging: str) -> DataFrame:
    """(file_no, old, new, n_erased) of the files that have a deletion vector, each rewritten by one task."""
    work = files.join(vectors, "file_no").repartition(tasks, "file_no").sortWithinPartitions("file_no", "bucket").select("file_no", "path", "bucket", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
        for (number, path), maps in groupby(rows, key=lambda r: r[:2]):
            new, erased = rewrite_file(path, ((m[2], m[3]) for m in maps), staging)
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int32()), "old": pa.array([path]), "new": pa.array([new], pa.string()), "n_erased": pa.array([erased])})

    return work.mapInArrow(run, "file_no int, old string, new string, n_erased long")


def erase(spark: SparkSession, root: str, schemas: dict[str, str], first: str, victims: Callable[[DataFrame], DataFrame], links: list[Link]) -> DataFrame:
    """Erases the victims of the table `first` (victims: from its rows to its victim rows) and, by links in order, of all that refer to them, from the
    files under root/table. Returns (table_name, file_no, path, n_erased, rewritten) of the files that are left. schemas: DDL by table, of tables with files."""
    tasks, staging = int(spark.conf.get("spark.sql.shuffle.partitions")), passing(spark, "erasing")
    files = {t: list_files(spark, f"{root}/{t}", s) for t, s in schemas.items()}
    keys, done = {}, []
    for table in (t for t in [first, *dict.fromkeys(x.table for x in links)] if t in schemas):
        scan = spark.read.schema(f"{schemas[table]}, {FOLDER} int").parquet(f"{root}/{table}")
        needed = list(dict.fromkeys(x.parent_key for x in links if x.parent == table))
        own = [x for x in links if x.table == table and x.parent in keys]
        if table == first:
            hits = [victims(scan.withColumn("position", F.col("_metadata.row_index"))).select(F.col(FOLDER).alias("file_no"), "position", *needed)]
        else:
            hits = [members(scan, x.key, keys[x.parent].select(x.parent_key).filter(F.col(x.parent_key).isNotNull()).distinct(), needed) for x in own]
        if not hits:
            continue
        keys[table] = materialize(hits[0] if len(hits) == 1 else reduce(DataFrame.unionAll, hits).distinct(), "hits")
        vectors = materialize(deletion_vectors(keys[table]), "deletion-vectors")
        listed = spark.createDataFrame(files[table], "path string, file_no int")
        done += [(table, *r) for r in materialize(_rewritten(listed, vectors, tasks, staging), "rewritten").collect()]
    # All new files are there, and a rewritten file's row says so; only now do the old ones go. There are as many as the layout has parts.
    out = {(t, n): (t, n, p, 0, False) for t, own in files.items() for p, n in own}
    for table, number, old, new, erased in done:
        remove(spark, old if new else old.rpartition("/")[0])
        out[table, number] = (table, number, new, erased, True)
    return spark.createDataFrame([r for r in out.values() if r[2]], "table_name string, file_no int, path string, n_erased long, rewritten boolean")


def digest_file(path: str, money: str) -> dict:
    """A file read back in order, in bounded batches: rows, the sum of cents, a digest of the first column, the names of the columns."""
    fs, source = FileSystem.from_uri(path)
    sha, n, cents = hashlib.sha256(), 0, 0
    with fs.open_input_file(source) as handle:
        file = pq.ParquetFile(handle)
        names = file.schema_arrow.names
        for batch in file.iter_batches(1 << 16, columns=list(dict.fromkeys([names[0], money]))):
            ids = batch.column(batch.schema.names.index(names[0])).to_pylist()
            sha.update((("," if n else "") + ",".join("" if v is None else str(v) for v in ids)).encode() if ids else b"")
            value = batch.column(batch.schema.names.index(money)).cast(pa.float64()).to_numpy(zero_copy_only=False)
            value = value[np.isfinite(value)]
            cents += sum(map(int, np.floor(100 * value + 0.5).tolist()))
            n += batch.num_rows
    return {"n_rows": n, "cents": cents, "ids_sha256": sha.hexdigest(), "columns": ",".join(names)}


def digest(files: DataFrame, money: dict[str, str]) -> DataFrame:
    """The files with n_rows, cents, ids_sha256 and columns; each is read by one task."""
    columns = ["table_name", "file_no", "path", "n_erased", "rewritten"]
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_pylist([r | digest_file(r["path"], money[r["table_name"]])], schema)

    kinds = {"table_name": pa.string(), "file_no": pa.int64(), "path": pa.string(), "n_erased": pa.int64(), "rewritten": pa.bool_(), "n_rows": pa.int64(), "cents": pa.int64(), "ids_sha256": pa.string(), "columns": pa.string()}
    schema = pa.schema(list(kinds.items()))
    dealt = files.select("table_name", F.col("file_no").cast("long").alias("file_no"), *columns[2:]).repartition(tasks, "path")
    return dealt.mapInArrow(run, "table_name string, file_no long, path string, n_erased long, rewritten boolean, n_rows long, cents long, ids_sha256 string, columns string")


def data_files(path: str) -> list[str]:
    """All files under a folder that hold data, for tests and audits of folders this process can list."""
    from pyarrow.fs import FileSelector

    fs, p = FileSystem.from_uri(path)
    return sorted(f.path for f in fs.get_file_info(FileSelector(p, recursive=True)) if f.type == FileType.File and not f.base_name.startswith((".", "_")))


MONEY = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
SHOP = [Link("clicks", "client_id", "clients", "client_id"), Link("sales", "client_id", "clients", "client_id"), Link("sale_lines", "sale_id", "sales", "sale_id")]


def shop_victims(clients: DataFrame, clicks: DataFrame, modulus: int = 400) -> DataFrame:
    """The master ids to erase: those whose crc32 is divisible by modulus, and the one with most clicks (of ties the smallest)."""
    masters = clients.filter("master_id IS NOT NULL").select("master_id", "client_id").distinct()
    counts = clicks.filter("client_id IS NOT NULL").groupBy("client_id").agg(F.count("*").alias("n"))
    busiest = masters.join(counts, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).orderBy(F.desc("n"), "master_id").limit(1)
    return masters.select("master_id").filter(decimal_crc("master_id") % modulus == 0).unionAll(busiest.select("master_id")).distinct()


def erase_shop(tables: dict[str, DataFrame], root: str, parts: int = PARTS, modulus: int = 400) -> DataFrame:
    """Lays the shop's tables (clients, clicks, sales, sale_lines) out under root and erases the victim masters; a row for each file that is left."""
    spark = tables["clients"].sparkSession
    ship(spark)

    def build() -> DataFrame:
        masters = materialize(shop_victims(tables["clients"], tables["clicks"], modulus), "masters")
        schemas = {}
        for name, df in tables.items():
            keyed = owners_crc(df, tables["sales"], "sale_id", "client_id") if name == "sale_lines" else df.withColumn("__crc", decimal_crc("client_id"))
            if lay_out(keyed, df.columns, f"{root}/{name}", parts):
                schemas[name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
        few = masters.count() <= BROADCAST_KEYS
        victims = lambda scan: scan.join(F.broadcast(masters) if few else masters, "master_id", "left_semi")
        return digest(erase(spark, root, schemas, "clients", victims, SHOP), MONEY)

    return settle(spark, build, "erasure")
