"""Near-duplicate documents by BagMinHash over bags of five-word shingles.

An element of multiplicity w takes all points of a Poisson process on (0, w] x time; the process is made
of independent ones on the dyadic weight intervals (0, 1], (1, 2], (2, 4], ..., whose points carry a
weight place, so that a smaller weight keeps a part of a larger weight's points. Each point falls into one
of M slots and a slot keeps its first point: two bags share a slot's point with probability equal to their
weighted Jaccard similarity. Points come in order of time, so a document stops at the time by which all
slots are filled.

Bags that agree in a band of slots meet in a group. Links are verified on the multisets of whole texts:
sum of min counts / sum of max counts >= 0.8. A group makes no pairs of all its members. First it takes one
pivot (the member that meets the most others, a count linear in the group), works out the exact overlap of
every member with it and joins the similar ones. Where a group's members are then still in several
components, and its pairs across components are no more than SMALL for each member, those pairs are
compared. The members of other groups get a second, longer signature with bands of STRICT_ROWS slots, so many
of them that two bags of similarity 0.8 meet as before, but less similar ones rarely do; its groups end in
the same way, and those with more pairs take pivots in turn, each without the pivots before. After
ROUNDS pivots groups end in pairs if these are up to LAST * SMALL for each member, and the members of the others meet by an
exact prefix filter over the bags' rarest elements. Either way is exact, so which one is taken changes no result.

Pairs that can't be similar are not verified: with a(x) units of x inside a pivot p, x and y share
a(x) + a(y) - n(p) units, what both lack of p, and what both have beyond p. Of either set a member keeps a
bit map of BITS buckets, and the buckets that two members have in common bound what they share there.

Defined cases: null text is an empty one; a document without a word is in a class of its own; one with 1
to 4 words has one shingle of them all; equal bags are one node, so copies never make pairs, and one doc_id
on several texts is a node for each; rows without doc_id have the class of their text, null where no other
row has it; repeated rows each get a row; of several likely pivots the first node wins, which changes no
class; a very long text goes through a worker by itself; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.session import materialize, settle, ship

SLOTS, ROWS, BANDS, SHINGLE = 168, 6, 28, 5
NUM, DEN = 4, 5  # similarity 0.8
#: Groups end in pairs where these are up to SMALL for each member; the nodes of others meet by their rarest elements after ROUNDS pivots.
SMALL, ROUNDS = 64, 3
#: After ROUNDS pivots pairs are made up to LAST times as many for each member.
LAST = 16
#: Buckets of the bit maps, 64 in each long.
BITS = 512
#: The second signature: two bags of similarity 0.8 meet in none of its bands with a chance of 1 in 1,000.
STRICT_ROWS, STRICT_BANDS = 14, 153
#: So many members are compared with one copy of a pivot's text.
STAR = 64
#: So many links (16 bytes each) are joined in one task.
BLOCK = 500_000
#: Ids of up to so many documents are broadcast (8 bytes each); beyond, the join shuffles.
BROADCAST_IDS = 500_000
U = np.uint64


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """First point times by document and slot, as float64; rows without elements stay infinite."""
    out = np.full((n, slots), np.inf)
    total = np.bincount(doc, weights=weight, minlength=n)
    todo, slack = total > 0, 4.0
    while todo.any():
        limit = np.where(todo, slots / np.maximum(total, 1) * (np.log(slots) + slack), 0.0)
        _points(out, doc, element, weight, limit, slots)
        todo &= ~np.isfinite(out).all(axis=1)
        slack += 6
    return out


def _salt(k: int, odd: int) -> np.uint64:
    return U(k * odd & (1 << 64) - 1)


def _points(out: np.ndarray, doc: np.ndarray, element: np.ndarray, weight: np.ndarray, limit: np.ndarray, slots: int) -> None:
    top = int(np.ceil(np.log2(max(1, weight.max(initial=1))))) + 1
    for node in range(top):
        low, width = (0, 1) if node == 0 else (1 << (node - 1), 1 << (node - 1))
        here = np.flatnonzero((weight > low) & (limit[doc] > 0))
        d, w = doc[here], weight[here]
        seed = tb.mix(element[here] * U(0x9E3779B97F4A7C15) + _salt(node + 1, 0xD1B54A32D192ED03))
        t, turn = np.zeros(len(here)), 0
        while len(d):
            # Few elements left: many steps at once; many elements: one step, whose hash alone tells most of
            # them that their point comes too late, before any logarithm.
            block = 1 if len(d) > 4096 else min(256, max(1, 32768 // len(d)))
            if block == 1:
                h = tb.mix(seed + _salt(turn + 1, 0x8CB92BA72F3D8DD7))
                u = ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
                live = np.flatnonzero(u >= np.exp((t - limit[d]) * width))
                d, w, seed, h = d[live], w[live], seed[live], h[live]
                t = t[live] - np.log(u[live]) / width
                _drop(out, d, w, h, t, low, width, slots, node)
            else:
                salts = np.array([_salt(turn + 1 + k, 0x8CB92BA72F3D8DD7) for k in range(block)])
                h = tb.mix(seed[:, None] + salts)
                u = ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53
                times = np.cumsum(np.concatenate((t[:, None], -np.log(u) / width), axis=1), axis=1)[:, 1:]
                row, col = np.nonzero(times <= limit[d][:, None])
                _drop(out, d[row], w[row], h[row, col], times[row, col], low, width, slots, node)
                live = np.flatnonzero(times[:, -1] <= limit[d])
                d, w, seed, t = d[live], w[live], seed[live], times[live, -1]
            turn += block


def _drop(out: np.ndarray, d: np.ndarray, w: np.ndarray, h: np.ndarray, t: np.ndarray, low: int, width: int, slots: int, node: int) -> None:
    """Points fall into their slots; above the first interval only those whose weight place the element reaches."""
    g = tb.mix(h ^ U(0xA0761D6478BD642F))
    at = d * slots + (((g >> U(32)) * U(slots)) >> U(32)).astype(np.int64)
    if node:
        keep = low + 1 + (((g & U(0xFFFFFFFF)) * U(width)) >> U(32)).astype(np.int64) <= w
        at, t = at[keep], t[keep]
    np.minimum.at(out.reshape(-1), at, t)


def _bag_of(column: pa.Array) -> Iterator[tuple[int, int, tuple]]:
    for i, j, data, offsets in tb.chunks(column):
        _, _, docs, word = tb.words(data, offsets)
        _, doc, value = tb.windows(word, docs, j - i, SHINGLE)
        yield i, j, tb.bags(doc, value)


def banded(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """A hash of each band of so many slots."""
    bits = tb.mix(signature.view(np.uint64))
    out = np.zeros((len(bits), bands), np.uint64)
    for r in range(rows):
        out += bits[:, r : bands * rows : rows] * tb._PLACE[r]
    return tb.mix(out + np.arange(bands, dtype=np.uint64))


def _lists(bands: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.reshape(-1).view(np.int64)))


def _sign_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, (doc, element, count) in _bag_of(batch.column(1)):
            # Other elements, so other points than those of the first signature.
            bands = banded(signatures(doc, element ^ U(0x5DEECE66D), count, j - i, STRICT_ROWS * STRICT_BANDS), STRICT_ROWS, STRICT_BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), _lists(bands)], ["node", "root", "bands"])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tb.claim("minhash_dedup")
    for batch in batches:
        for i, j, (doc, element, count) in _bag_of(batch.column(2)):
            n = j - i
            bands = banded(signatures(doc, element, count, n), ROWS, BANDS)
            prints = []
            for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                each = tb.mix(element ^ U(salt)) * count.astype(np.uint64)
                total = np.zeros(n, np.uint64)
                np.add.at(total, doc, each)
                prints.append(tb.mix(total + U(salt)))
            size = np.bincount(doc, weights=count, minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(size), *(pa.array(p.view(np.int64)) for p in prints), _lists(bands)], ["doc_id", "t", "size", "f1", "f2", "bands"])
        del batch
        pa.default_memory_pool().release_unused()


def _against_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (pivot, salt, role, node, text) come sorted; each pivot's text is followed by its members'. Per member: the units
    it shares with the pivot, and the buckets of the elements of which it has more and of which it has less than the pivot."""
    last = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    for batch in batches:
        roles = batch.column(2).to_numpy()
        for i, j, (doc, element, count) in _bag_of(batch.column(4)):
            is_pivot = roles[i:j] == 0
            segment = np.cumsum(is_pivot).astype(np.uint64)  # 0: the pivot of an earlier chunk
            key = (segment[doc] << U(44)) | element
            of_pivot = is_pivot[doc]
            keys = np.concatenate((last[0], key[of_pivot]))
            counts = np.concatenate((last[1], count[of_pivot]))
            if is_pivot.any():
                mine = of_pivot & (doc == np.flatnonzero(is_pivot)[-1])
                last = (element[mine], count[mine])
            doc, element, count, key = doc[~of_pivot], element[~of_pivot], count[~of_pivot], key[~of_pivot]
            at = np.searchsorted(keys, key)
            have = np.zeros(len(key), np.int64)
            inside = at < len(keys)
            hit = inside.copy()
            hit[inside] = keys[at[inside]] == key[inside]
            have[hit] = np.minimum(counts[at[hit]], count[hit])
            members = np.flatnonzero(~is_pivot)
            shared = np.bincount(doc, weights=have, minlength=j - i).astype(np.int64)[members]
            # Buckets of the pivots' elements, less those that a member has in full.
            row = np.cumsum(~is_pivot) - 1
            bucket = lambda e: (tb.mix(e) & U(BITS - 1)).astype(np.int64)
            more = count > have
            extra = np.zeros(len(members) * BITS, bool)
            extra[row[doc[more]] * BITS + bucket(element[more])] = True
            full = np.zeros(len(key), bool)
            full[hit] = have[hit] == counts[at[hit]]
            total = np.bincount((keys >> U(44)).astype(np.int64) * BITS + bucket(keys & U((1 << 44) - 1)), minlength=(int(segment[-1]) + 1) * BITS).reshape(-1, BITS)
            missing = total[segment[members].astype(np.int64)].reshape(-1) > np.bincount(row[doc[full]] * BITS + bucket(element[full]), minlength=len(members) * BITS)
            take = pa.array(members)
            maps = [pa.ListArray.from_arrays(pa.array(np.arange(len(members) + 1, dtype=np.int32) * (BITS // 64)), pa.array(np.packbits(x).view(np.int64))) for x in (extra, missing)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(take), batch.column(3).slice(i, j - i).take(take), pa.array(shared), *maps], ["pivot", "node", "shared", "extra", "missing"])
        del batch
        pa.default_memory_pool().release_unused()


def overlaps(stars: DataFrame, texts: DataFrame) -> DataFrame:
    """(pivot, node, shared units, bit maps extra and missing) of the distinct pairs (pivot, node); a pivot's text goes along once for STAR members."""
    stars = materialize(stars, "pairs")
    sizes = stars.groupBy("pivot").agg(F.ceil(F.count("*") / STAR).alias("salts"))
    dealt = stars.join(sizes, "pivot").select("pivot", F.pmod(F.xxhash64("node"), "salts").alias("salt"), "node")
    rows = dealt.select("pivot", "salt", F.lit(1).alias("role"), "node").unionAll(dealt.select("pivot", "salt", F.lit(0).alias("role"), F.col("pivot").alias("node")).distinct())
    full = rows.join(texts, "node").select("pivot", "salt", "role", "node", "text")
    full = full.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    return materialize(full.mapInArrow(_against_pivots, "pivot long, node long, shared long, extra array<long>, missing array<long>"), "overlaps")


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a block as stars: each node with the least of its component there."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    ends = np.concatenate([np.concatenate(x) for x in zip(*parts, strict=True)])
    names, at = np.unique(ends, return_inverse=True)
    u, v = at[: len(at) // 2], at[len(at) // 2 :]
    root = np.arange(len(names))
    while True:  # the least root of either end goes to the other's root, then paths are halved until they are flat
        least = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], least)
        np.minimum.at(root, root[v], least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    some = np.flatnonzero(root != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(names[root[some]])], ["u", "v"])


def components(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b), the least one being the root.

    Blocks of about `block` edges become stars by themselves, then a large-star and a small-star step brings their
    roots together; again until no root has a root. A single block is done at once."""
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = materialize(now, "stars")
    while True:
        blocks = -(-now.count() // block)
        now = materialize((now.coalesce(1) if blocks <= 1 else now.repartition(blocks)).mapInArrow(_contract, "u long, v long"), "stars")
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("own")).unionAll(now.select(F.col("v").alias("x"), F.lit(0).alias("own")))
        deep = ends.groupBy("x").agg(F.sum("own").alias("roots"), F.min("own").alias("leaf")).filter("roots > 1 or (roots = 1 and leaf = 0)")
        if blocks <= 1 or deep.isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = materialize(small, "stars")


def _similar(shared: str, n: str, m: str) -> str:
    """Shared units of bags of n and m units that make them similar enough."""
    return f"{NUM + DEN} * {shared} >= {NUM} * ({n} + {m})"


def _links(stars: DataFrame, nodes: DataFrame) -> DataFrame:
    size = lambda c, n: nodes.select(F.col("node").alias(c), F.col("size").alias(n))
    return stars.join(size("pivot", "np"), "pivot").join(size("node", "nx"), "node").filter(_similar("shared", "np", "nx")).select(F.col("pivot").alias("a"), F.col("node").alias("b"))


def _pivots(groups: DataFrame) -> DataFrame:
    """The members (key, node, ..., n in the group) with the pivot of their group: the member that meets the most others; of near copies of one text, the text itself."""
    met = groups.groupBy("node").agg(F.sum(F.col("n") - 1).alias("met"))
    ranked = groups.join(met, "node").groupBy("key").agg((-F.max(F.struct("met", (-F.col("node")).alias("m")))["m"]).alias("pivot"))
    return groups.join(ranked, "key")


def _open(placed: DataFrame, small: int) -> DataFrame:
    """The members (key, node, root, ...) of groups that lie in several components; few: whether the pairs across them are up to small
    for each member; main: whether a member is in the group's largest component."""
    sizes = placed.groupBy("key", "root").agg(F.count("*").cast("double").alias("c"))
    parts = sizes.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("within"), F.max(F.struct("c", "root"))["root"].alias("most"), F.count("*").alias("parts"))
    spread = parts.filter("parts > 1").select("key", F.col("n").cast("long").alias("n"), "most", (F.col("n") * F.col("n") - F.col("within") <= 2.0 * small * F.col("n")).alias("few"))
    return placed.join(spread, "key").withColumn("main", F.col("root") == F.col("most")).drop("most")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _measured(stars: DataFrame, sizes: DataFrame) -> DataFrame:
    """The overlaps with what their bounds need: size, that of the pivot, and the units that share a bucket with others."""
    bits = lambda x: " + ".join(f"bit_count({x}[{k}])" for k in range(BITS // 64))
    sized = stars.join(sizes, "node").join(sizes.select(F.col("node").alias("pivot"), F.col("size").alias("np")), "pivot")
    return sized.withColumns({"xo": F.expr(f"size - shared - ({bits('extra')})"), "mo": F.expr(f"np - shared - ({bits('missing')})")})


def _pairs(members: DataFrame) -> DataFrame:
    """(pivot, node): the pairs of members of a group that lie in different components and may be similar, as far as a pivot that they have
    in common tells. One of each pair is outside the group's largest component, so its members never meet each other."""
    cols = ("node", "main", "root", "size", "pivot", "shared", "np", "extra", "missing", "xo", "mo")
    a, b = (members.select("key", *(F.col(c).alias(f"{c}{k}") for c in cols)) for k in "ab")
    both = lambda x: " + ".join(f"bit_count({x}a[{k}] & {x}b[{k}])" for k in range(BITS // 64))
    lacking = f"least(npa - shareda, npa - sharedb, {both('missing')} + least(moa, mob))"
    beyond = f"least(sizea - shareda, sizeb - sharedb, {both('extra')} + least(xoa, xob))"
    likely = f"pivota <> pivotb or {_similar(f'(shareda + sharedb - npa + {lacking} + {beyond})', 'sizea', 'sizeb')}"
    fit = f"roota <> rootb and (mainb or nodea < nodeb) and {DEN} * least(sizea, sizeb) >= {NUM} * greatest(sizea, sizeb) and ({likely})"
    return a.filter("not maina").join(b, "key").filter(fit).select(F.least("nodea", "nodeb").alias("pivot"), F.greatest("nodea", "nodeb").alias("node")).distinct()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root, size, element, count) of the bags of rows (node, root, size, text)."""
    for batch in batches:
        for i, j, (doc, element, count) in _bag_of(batch.column(3)):
            own = [batch.column(k).slice(i, j - i).take(pa.array(doc)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(element.view(np.int64)), pa.array(count)], ["node", "root", "size", "element", "count"])


def _by_rare_elements(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(pivot, node): all pairs of the members' nodes in different components that may be similar, by an exact prefix filter: similar bags share four fifths
    of either's units, so they share one of the rarest of each, as many as a fifth and one. What all have in common brings none together."""
    nodes = members.select("node", "root", "size").distinct()
    units = materialize(texts.join(nodes, "node").select("node", "root", "size", "text").mapInArrow(_elements, "node long, root long, size long, element long, count long"), "elements")
    held = units.groupBy("element").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("count").over(W.partitionBy("node").orderBy("held", "element").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rare = units.join(held, "element").withColumn("before", before).filter((F.expr(f"before <= size - ({NUM} * size + {DEN - 1}) div {DEN}")) & (F.col("held") > 1))
    rare = materialize(rare.select("element", "node", "root", "size"), "rare-elements")
    a, b = (rare.select("element", *(F.col(c).alias(f"{c}{k}") for c in ("node", "root", "size"))) for k in "ab")
    fit = f"nodea < nodeb and roota <> rootb and {DEN} * least(sizea, sizeb) >= {NUM} * greatest(sizea, sizeb)"
    return a.join(b, "element").filter(fit).select(F.col("nodea").alias("pivot"), F.col("nodeb").alias("node")).distinct()


def _again(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, node, root): the groups of the second signature of nodes (node, root)."""
    signed = materialize(texts.join(nodes, "node").select("node", "text", "root").mapInArrow(_sign_again, "node long, root long, bands array<long>"), "signatures")
    return signed.select("node", "root", F.explode("bands").alias("key"))


def near_duplicates(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", small: int = SMALL, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_col and class_id, the smallest doc_col of its class (its own where it has no like)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_col).cast("long").alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return settle(docs.sparkSession, lambda: _classes(rows, small, rounds).select("doc_id", "class_id"), "classes").withColumnRenamed("doc_id", doc_col)


def first_of_class(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay when one document of each class stays: the one with the smallest doc_col. Of rows
    that agree in document and text one stays; a document without a word, or without doc_col, stays."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(doc_col).cast("long").alias("d"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    own = [F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]
    keyed = docs.select(*own, F.col(doc_col).cast("long").alias("d"), F.xxhash64(text_col).alias("t"))

    def build() -> DataFrame:
        found = _classes(rows, SMALL, ROUNDS).filter("root is not null and doc_id is not null")
        each = found.groupBy("root", "doc_id", "t").agg(F.count("*").alias("times"))
        least = each.groupBy("root").agg(F.min(F.struct("doc_id", "t")).alias("of"))
        judged = each.join(least, "root").select("doc_id", "t", (F.struct("doc_id", "t") == F.col("of")).alias("stays"), "times")
        return judged.filter("not stays or times > 1")

    judged = settle(spark, build, "judged")
    few = judged.count() <= BROADCAST_IDS
    side = judged.select(F.col("doc_id").alias("gd"), F.col("t").alias("gt"), "stays")
    alike = (keyed["d"] == side["gd"]) & (keyed["t"] == side["gt"])
    left = keyed.join(F.broadcast(side) if few else side, alike, "left_anti")
    # Rows that come more than once and stay: one of each.
    again = side.filter("stays")
    if not again.isEmpty():
        again = keyed.join(F.broadcast(again) if few else again, alike, "left_semi").dropDuplicates(["d", "t"])
        left = left.unionAll(again)
    return left.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(docs.columns)))


def _classes(docs: DataFrame, small: int, rounds: int) -> DataFrame:
    """Per row of docs: doc_id, t, class_id and the root of its component, null for a text without a word."""
    signed = materialize(docs.mapInArrow(_sign, "doc_id long, t long, size long, f1 long, f2 long, bands array<long>"), "signatures")
    # A node for each bag, whatever rows have it.
    bags = signed.filter("size > 0 and doc_id is not null").groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "t")).alias("of"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = materialize(bags.select(F.monotonically_increasing_id().alias("node"), "f1", "f2", "of.doc_id", "of.t", "size", "bands"), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("key"))
    many = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    groups = materialize(_pivots(materialize(rows.join(many, "key"), "members")).drop("n"), "groups")
    ids = materialize(nodes.join(groups.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "t"), "texts-of")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, (docs["d"] == ids["doc_id"]) & (docs["t"] == ids["t"])).select("node", "text").dropDuplicates(["node"])
    texts = materialize(texts, "texts")
    stars = overlaps(groups.filter("pivot <> node").select("pivot", "node").distinct(), texts)
    links = materialize(_links(stars, nodes), "links")
    roots = components(links)
    near = materialize(_measured(stars, nodes.select("node", "size")), "near")
    # Of a node's pivots, the one that most nodes have: the likeliest to tell something of a pair.
    known = near.join(near.groupBy("pivot").agg(F.count("*").alias("of")), "pivot")
    best = known.groupBy("node").agg(F.max_by(F.struct(*(c for c in near.columns if c != "node")), F.struct("of", "pivot")).alias("x")).select("node", "x.*")
    room = lambda turn: small if turn < rounds else LAST * small
    members = materialize(_open(_rooted(groups.filter("pivot <> node"), roots), room(1)).join(near, ["pivot", "node"]), "open")
    for turn in range(1, rounds + 1):
        if members.isEmpty():
            break
        stars = _pairs(members.filter("few"))
        large = members.filter("not few")
        if turn == 1 and not large.isEmpty():
            large = materialize(_open(_again(large.select("node", "root").distinct(), texts), room(turn)).join(best, "node"), "open")
            stars = stars.unionAll(_pairs(large.filter("few")))
            large = large.filter("not few")
        if turn == rounds and not large.isEmpty():
            stars = stars.unionAll(_by_rare_elements(large, texts)).distinct()
            large = large.limit(0)
        if large.isEmpty():
            groups, found = None, stars
        else:
            groups = materialize(_pivots(large.select("key", "node", "root", "n")), "groups")
            other = groups.filter("node = pivot").select("key", F.col("root").alias("other"))
            found = stars.unionAll(groups.join(other, "key").filter("root <> other").select("pivot", "node")).distinct()
        found = materialize(_links(overlaps(found, texts), nodes), "links")
        if not found.isEmpty():
            links = links.unionAll(found)
            roots = components(links)
        if groups is None:
            break
        members = materialize(_open(_rooted(groups.filter("pivot <> node").select("key", "node"), roots), room(turn + 1)).join(best, "node"), "open")
    # The class of a component has the smallest doc_id of its bags.
    of = nodes.select("node", "f1", "f2", "doc_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    named = of.join(least, "root").select("f1", "f2", "class_id", "root")
    out = signed.select("doc_id", "t", F.when(F.col("size") > 0, F.col("f1")).alias("f1"), "f2").join(named, ["f1", "f2"], "left")
    return out.select("doc_id", "t", F.coalesce("class_id", "doc_id").alias("class_id"), "root")
