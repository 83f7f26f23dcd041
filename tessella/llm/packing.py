"""Best-fit packing by a configuration linear program.

The histogram of piece lengths (at most CAPACITY values, so it has a proven bound) goes to the driver.
Its configuration LP - fewest sequences so that configurations cover the counts - is solved by
multiplicative weights: each round prices the lengths, a bounded knapsack dynamic program over the capacity
finds the configuration worth most among the pieces still open, and a share of sequences is given to it
while the prices of what it covers sink. Configurations that leave room are no part of the plan. The
fractional solution is rounded down, then up where pieces are left, largest fractions first; what it leaves
over is packed best fit, longest first. Each shard keeps the better of this packing and plain best fit.

Pieces are dealt by hash to shards of about SHARD pieces; each shard takes its share of the solution and
packs its own rest, so no task holds more than a shard and a length that a third of all pieces share is
spread. Only ids and lengths move, never texts.

Tokens: the tokenizer's pre-tokens are independent of each other, so each worker encodes a pre-token once
and keeps its ids in a cache of bounded size, under a 64-bit hash; a text's ids are gathered from there. A
text that holds a special token's string, or a character that is unassigned in Python's Unicode tables (the tokenizer's may be newer), goes to the tokenizer as a whole.

Defined cases: null text is an empty one and has the single id 0; documents over CAPACITY are cut into
full pieces from their end, so the first may be shorter; a very long text goes through a worker by itself;
pieces of equal length are taken in the order in which they come; repeated rows are packed each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.session import materialize, settle, ship

CAPACITY, SHARD, ROUNDS, CACHE = 2048, 60_000, 200, 500_000
U = np.uint64
#: The kind of a character that Python's tables leave unassigned.
UNKNOWN = 4
_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTED = ("s", "t", "re", "ve", "m", "ll", "d")
_kinds: list[np.ndarray] = []
_coders: dict[str, Coder] = {}


def _kind() -> np.ndarray:
    """Code point to 0 other, 1 letter, 2 number, 3 white space, 4 unassigned."""
    if not _kinds:
        import unicodedata

        kind = np.array([UNKNOWN if (own := unicodedata.category(chr(c))) == "Cn" else {"L": 1, "N": 2}.get(own[0], 0) for c in range(0x110000)], np.uint8)
        kind[_SPACE] = 3
        _kinds.append(kind)
    return _kinds[0]


def pretokens(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of the byte-level pattern start, over documents one after another."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _kind()[points]
    first = np.zeros(n, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    # The last character of a white space run goes to what follows: a blank joins it, others stand alone.
    white = kind == 3
    tail = np.zeros(n, bool)
    tail[:-1] = white[:-1] & ~white[1:] & ~last[:-1]
    blank = tail & (points == 32)
    at = np.flatnonzero(tail)
    begin[at] = True
    begin[np.flatnonzero(blank) + 1] = False
    # An apostrophe alone, not after a joined blank, takes the letters of a contraction.
    quote = np.flatnonzero((points == 39) & begin & ~last)
    quote = quote[kind[quote + 1] == 1]
    for q in quote:
        after = "".join(map(chr, points[q + 1 : q + 3])) if not last[q + 1] else chr(points[q + 1])
        size = next((len(c) for c in _CONTRACTED if after.startswith(c)), 0)
        if size:
            begin[q + 1] = False
            if q + 1 + size < n and not first[q + 1 + size]:
                begin[q + 1 + size] = True
    return np.flatnonzero(begin)


class Coder:
    """Ids of whole texts, through a cache of pre-tokens."""

    def __init__(self, path: str):
        # A worker has one core; the tokenizer's own threads would only take memory.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are one token wherever they stand.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.keys, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.begin, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, texts: list[str], keys: np.ndarray) -> None:
        if len(self.keys) + len(keys) > CACHE:
            self._forget()
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        slot = np.arange(len(self.begin) - 1, len(self.begin) - 1 + len(found))
        self.begin = np.concatenate((self.begin, self.begin[-1] + np.cumsum(size)))
        self.ids = np.concatenate((self.ids, np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))))
        merged, slots = np.concatenate((self.keys, keys)), np.concatenate((self.slot, slot))
        order = np.argsort(merged, kind="stable")
        self.keys, self.slot = merged[order], slots[order]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets by text); id 0 ends each text."""
        whole = "".join(texts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        odd = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        # The tokenizer's tables may be newer: texts with characters that Python has no kind for go to it as a whole.
        new = np.flatnonzero(_kind()[points] == UNKNOWN)
        if len(new):
            odd.update((np.searchsorted(np.cumsum([len(t) for t in texts]), new, side="right")).tolist())
        if not odd:
            return self._gather(texts, whole, points)
        left = ["" if i in odd else t for i, t in enumerate(texts)]
        whole = "".join(left)
        ids, at = self._gather(left, whole, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
        parts = [ids[a:b] for a, b in zip(at, at[1:], strict=False)]
        for i in odd:
            parts[i] = np.array([*self.tokenizer.encode(texts[i], add_special_tokens=False).ids, 0], np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _gather(self, texts: list[str], whole: str, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts = pretokens(points, offsets)
        ends = np.append(starts[1:], len(points)) if len(starts) else starts
        unique, first, of = tb.distinct(tb.hashed_points(points, starts, ends))
        at = np.searchsorted(self.keys, unique)
        known = np.zeros(len(unique), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == unique[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            before = len(self.keys)
            self._learn([whole[s:e] for s, e in zip(starts[first[new]], ends[first[new]], strict=True)], unique[new])
            if len(self.keys) < before + len(new):  # the cache began anew
                old = np.flatnonzero(known)
                self._learn([whole[s:e] for s, e in zip(starts[first[old]], ends[first[old]], strict=True)], unique[old])
            at = np.searchsorted(self.keys, unique)
        slot = self.slot[at]
        size = (self.begin[slot + 1] - self.begin[slot])[of]
        source = self.begin[slot][of]
        doc = np.searchsorted(offsets, starts, side="right") - 1
        tokens = np.bincount(doc, weights=size, minlength=len(texts)).astype(np.int64)
        out_at = np.concatenate(([0], np.cumsum(tokens + 1)))
        out = np.zeros(out_at[-1], np.uint32)
        place = np.concatenate(([0], np.cumsum(size)))[:-1] + doc if len(size) else np.zeros(0, np.int64)
        total = int(size.sum())
        step = np.arange(total) - np.repeat(np.concatenate(([0], np.cumsum(size)))[:-1], size) if total else np.zeros(0, np.int64)
        out[np.repeat(place, size) + step] = self.ids[np.repeat(source, size) + step]
        return out, out_at


def coder(path: str) -> Coder:
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.claim("packing", _coders.clear)
        code = coder(tokenizer)
        for batch in batches:
            for i, j, _, _ in tb.chunks(batch.column(1)):
                ids, at = code.encode([t or "" for t in batch.column(1).slice(i, j - i).to_pylist()])
                raw = memoryview(ids.astype("<u4").tobytes())
                total = np.diff(at)
                count = -(-total // capacity)
                doc = np.repeat(np.arange(j - i), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                end = total[doc] - (count[doc] - 1 - piece) * capacity
                start = np.maximum(0, end - capacity)
                base = at[doc]
                crc = np.fromiter((zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(base + start, base + end, strict=True)), np.int64, len(doc))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc)), *(pa.array(x.astype(np.int64)) for x in (piece, start, end - start)), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, "doc_id long, piece long, start long, length long, ids_crc32 long")


def knapsack(price: np.ndarray, lengths: np.ndarray, counts: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length is in the configuration worth most, no length more often than its count allows.

    Each length goes in by bundles of 1, 2, 4, ... copies that add up to its bound."""
    value = np.zeros(capacity + 1)
    bundles, taken = [], []
    for k in np.flatnonzero(counts > 0):
        size, left, copies = int(lengths[k]), int(min(counts[k], capacity // int(lengths[k]))), 1
        while left > 0:
            copies = min(copies, left)
            room = copies * size
            worth = value[: capacity + 1 - room] + copies * price[k]
            better = worth > value[room:]
            if better.any():
                value[room:] = np.where(better, worth, value[room:])
                bundles.append((int(k), copies, room))
                taken.append(better)
            left -= copies
            copies *= 2
    used = np.zeros(len(lengths), np.int64)
    room = int(value.argmax())
    for (k, copies, size), better in zip(reversed(bundles), reversed(taken), strict=True):
        if room >= size and better[room - size]:
            used[k] += copies
            room -= size
    return used


def configurations(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS, full: float = 1.0) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many sequences of each, the rounded fractional solution; never more than the counts hold.

    Each round adds the best-priced configuration by its step and multiplies the prices of lengths by
    exp(-eta * (share covered, relative to the least)): what falls behind becomes dear. A configuration is
    part of the solution if it fills the capacity to the share `full`."""
    if not len(lengths):
        return []
    demand = counts.astype(np.float64)
    covered = np.zeros(len(lengths))
    found: dict[bytes, float] = {}
    worth = np.log(lengths / capacity)
    log_price = worth.copy()
    bound = float((lengths * counts).sum()) / capacity
    step = bound / rounds
    eta = 4.0 * np.log(len(lengths) + 1)
    for _ in range(rounds):
        free = np.ceil(np.maximum(0.0, demand - covered) / max(1.0, step)).astype(np.int64)
        config = knapsack(np.exp(log_price - log_price.max()), lengths, free, capacity)
        if not config.any():
            break
        if (config * lengths).sum() >= full * capacity:
            found[config.tobytes()] = found.get(config.tobytes(), 0.0) + step
        covered = np.minimum(demand, covered + config * step)
        share = covered / demand
        log_price = worth - eta * (share - share.min())
    left = counts.copy()
    times = {}
    # Down first, then up by the largest fractions, both as far as pieces are left.
    for raw, amount in [*sorted(((r, float(int(a))) for r, a in found.items()), key=lambda x: (-x[1], x[0])), *sorted(((r, a % 1) for r, a in found.items() if a % 1), key=lambda x: (-x[1], x[0]))]:
        config = np.frombuffer(raw, np.int64)
        some = config > 0
        n = min(int(np.ceil(amount)), int((left[some] // config[some]).min()))
        if n > 0:
            left -= config * n
            times[raw] = times.get(raw, 0) + n
    return [(np.frombuffer(raw, np.int64), n) for raw, n in times.items()]


def _place(length: np.ndarray, lengths: np.ndarray, plan: list[tuple[np.ndarray, int]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of each piece and the number of sequences: the plan, as far as pieces are there, the rest best fit with the longest first."""
    order = np.argsort(length, kind="stable")
    ranked = length[order]
    begin = {int(x): int(i) for x, i in zip(*np.unique(ranked, return_index=True), strict=True)}
    have = dict(zip(*(x.tolist() for x in np.unique(ranked, return_counts=True)), strict=True))
    sequence, offset = np.full(len(length), -1, np.int64), np.zeros(len(length), np.int64)
    made = 0
    for config, times in plan:
        used = [(int(lengths[k]), int(config[k])) for k in np.flatnonzero(config)]
        n = min([times, *(have.get(x, 0) // c for x, c in used)])
        if n <= 0:
            continue
        at = 0
        for x, c in used:
            for _ in range(c):
                rows = order[begin[x] : begin[x] + n]
                sequence[rows], offset[rows] = np.arange(made, made + n), at
                begin[x] += n
                have[x] -= n
                at += x
        made += n
    # Best fit by room left: stacks of open sequences for each room, and a bit set of the rooms in use.
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0
    for x in sorted(have, reverse=True):
        for row in order[begin[x] : begin[x] + have[x]]:
            fitting = open_rooms >> x
            if fitting:
                room = x + (fitting & -fitting).bit_length() - 1
                s = rooms[room].pop()
                if not rooms[room]:
                    open_rooms &= ~(1 << room)
            else:
                room, s = capacity, made
                made += 1
            sequence[row], offset[row] = s, capacity - room
            if room > x:
                rooms[room - x].append(s)
                open_rooms |= 1 << (room - x)
    return sequence, offset, made


def pack_lengths(length: np.ndarray, lengths: np.ndarray, plan: list[tuple[np.ndarray, int]], shard: int = 0, shards: int = 1, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece of a shard: by its share of the plan, or as much of it as needs no more sequences than plain best fit."""
    own = [(config, times * (shard + 1) // shards - times * shard // shards if times >= shards else int((shard + i) % shards < times)) for i, (config, times) in enumerate(plan)]
    # Few small pieces may be left to fill the last gaps; then the shard takes the largest part of the plan that costs no sequence.
    ends = np.cumsum([times for _, times in own])
    parts = (_place(length, lengths, own[: int((ends <= part * ends[-1]).sum())] if own else [], capacity) for part in (1, 0.75, 0.5, 0.25, 0))
    best = next(parts)
    for other in parts:
        if best[2] <= -(-int(length.sum()) // capacity):  # none can need fewer
            break
        best = min(best, other, key=lambda x: x[2])
    return best[:2]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, shard: int = SHARD, rounds: int = ROUNDS, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    ship(docs.sparkSession)
    return settle(docs.sparkSession, lambda: _packed(docs, tokenizer, capacity, shard, rounds, doc_col, text_col), "packed")


def _packed(docs: DataFrame, tokenizer: str, capacity: int, shard: int, rounds: int, doc_col: str, text_col: str) -> DataFrame:
    rows = materialize(pieces(docs, tokenizer, capacity, doc_col, text_col), "pieces")
    histogram = np.array(sorted((r.length, r.n) for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()), np.int64).reshape(-1, 2)  # at most `capacity` rows
    lengths, counts = histogram[:, 0], histogram[:, 1]
    plan = configurations(lengths, counts, capacity, rounds)
    shards = max(1, -(-int(counts.sum()) // shard))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def work(part: pa.Table) -> pa.Table:
        own = part["shard"][0].as_py()
        sequence, offset = pack_lengths(part["length"].to_numpy(), lengths, plan, own, shards, capacity)
        cols = [part["doc_id"], part["piece"].cast(pa.int32()), part["start"], part["length"], part["ids_crc32"], pa.array(sequence * shards + own), pa.array(offset)]
        return pa.table(cols, names=[x.split()[0] for x in schema.split(", ")])

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(work, schema)
