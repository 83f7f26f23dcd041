"""Language identification by cross-parsing entropy.

For each language the suffix automaton of a bounded sample of labelled words accepts every substring of
them. A text is parsed greedily into the longest phrases that the automaton accepts; phrases end at the
bounds of a word (a maximal run of letters, lowered), and a letter that starts no substring is a phrase of
its own. The language that needs the fewest phrases for each letter wins. As phrases don't cross words, a
chunk's distinct words are parsed once, all languages and words in lock step.

The training sample: of each language, SAMPLE_DOCS documents with the smallest hashes of doc_id among
those whose crc32(doc_id) mod 3 is not 1, at most SAMPLE_WORDS distinct words of them, of up to WORD_LETTERS
letters, in order of their hash. The bounds are parameters, and words are picked before they reach the
driver; all documents are predicted from whole texts.

Defined cases: null text or one without a letter is `und` with score 0; null lang rows aren't learned
from; of several texts of one doc_id all are learned from; ties go to the first language by name; without any
labelled row all is `und`; a very long text goes through a worker by itself; an empty table gives an empty
result; repeated rows each get a row; other columns are ignored, or kept where asked for, but for those
named held_out, lang_pred and score, which give way to the result's.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tessella.llm import textbytes as tb
from tessella.session import ship

SAMPLE_DOCS, SAMPLE_WORDS, WORD_LETTERS, FOLDS, HELD_OUT, UNKNOWN = 48, 6000, 64, 3, 1, "und"
U = np.uint64
_letters: list[np.ndarray] = []
_models: dict[tuple, Model] = {}


def _letter() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def automaton(words: list[str], code: dict[str, int]) -> np.ndarray:
    """Transitions by state and letter code of the generalised suffix automaton; 0 is the start and, as a target, no transition."""
    step, link, length = [{}], [-1], [0]
    for word in words:
        last = 0
        for ch in map(code.__getitem__, word):
            if ch in step[last]:
                q = step[last][ch]
                if length[q] == length[last] + 1:
                    last = q
                    continue
                step.append(dict(step[q])), link.append(link[q]), length.append(length[last] + 1)
                clone = len(step) - 1
                link[q], p = clone, last
                while p >= 0 and step[p].get(ch) == q:
                    step[p][ch] = clone
                    p = link[p]
                last = clone
                continue
            step.append({}), link.append(0), length.append(length[last] + 1)
            new, p = len(step) - 1, last
            while p >= 0 and ch not in step[p]:
                step[p][ch] = new
                p = link[p]
            if p >= 0:
                q = step[p][ch]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    step.append(dict(step[q])), link.append(link[q]), length.append(length[p] + 1)
                    clone = len(step) - 1
                    link[q] = link[new] = clone
                    while p >= 0 and step[p].get(ch) == q:
                        step[p][ch] = clone
                        p = link[p]
            last = new
    table = np.zeros((len(step), len(code) + 1), np.int32)
    for state, moves in enumerate(step):
        for ch, to in moves.items():
            table[state, ch] = to
    return table


class Model:
    """One automaton for each language over a common alphabet, in one table."""

    def __init__(self, sample: dict[str, list[str]]):
        self.langs = sorted(sample)
        chars = sorted({c for words in sample.values() for w in words for c in w})
        code = {c: i + 1 for i, c in enumerate(chars)}
        tables = [automaton(sample[x], code) for x in self.langs]
        self.start = np.cumsum([0, *(len(t) for t in tables)])[:-1].astype(np.int64)
        moves = np.concatenate([np.where(t > 0, t + s, -1) for t, s in zip(tables, self.start, strict=True)]) if tables else np.zeros((0, 1), np.int64)
        self.width = moves.shape[1]
        # The last state has no move: a letter that no phrase starts with leads there.
        self.nowhere = len(moves)
        self.moves = np.concatenate((moves, np.full((1, self.width), -1))).astype(np.int32).reshape(-1)
        self.code = np.zeros(0x110000, np.int32)
        for c, i in code.items():
            self.code[ord(c)] = i

    def phrases(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases needed for each word (span of points) by language."""
        code, lengths = self.code[points], ends - starts
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        out = np.ones((len(self.langs), len(starts)), np.int32)
        for k, root in enumerate(self.start):
            state = np.full(len(starts), root, np.int64)
            live, shorter = len(starts), -lengths
            for i in range(int(lengths[0]) if len(lengths) else 0):
                live = int(np.searchsorted(shorter[:live], -i, side="left"))  # words of more than i letters
                ch = code[starts[:live] + i]
                to = self.moves[state[:live] * self.width + ch]
                # A phrase ends where no move is: the letter begins the next one, which the first letter of a word did already.
                bad = np.flatnonzero(to < 0)
                if len(bad):
                    out[k, bad] += i > 0
                    again = self.moves[root * self.width + ch[bad]]
                    to[bad] = np.where(again < 0, self.nowhere, again)
                state[:live] = to
        back = np.empty_like(out)
        back[:, order] = out
        return back


def model_of(sample: tuple[tuple[str, tuple[str, ...]], ...]) -> Model:
    """Built once in each Python worker."""
    key = zlib.crc32(repr(sample).encode())
    if key not in _models:
        _models.clear()
        _models[key] = Model({k: list(v) for k, v in sample})
    return _models[key]


def word_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(points, starts, ends, document) of the runs of letters of the lowered texts."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in lowered]))).astype(np.int64)
    starts, ends = tb.spans(_letter()[points], offsets)
    return points, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def predict(texts: list[str], model: Model) -> tuple[list[str], np.ndarray]:
    n = len(texts)
    points, starts, ends, doc = word_spans(texts)
    if not len(starts) or not model.langs:
        return [UNKNOWN] * n, np.zeros(n)
    _, first, of = tb.distinct(tb.hashed_points(points, starts, ends))
    need = model.phrases(points, starts[first], ends[first])
    total = np.stack([np.bincount(doc, weights=row[of], minlength=n) for row in need])
    best = total.argmin(axis=0)
    least = total.min(axis=0)
    others = np.sort(total, axis=0)[1] if len(total) > 1 else least * 2
    score = np.where(others > 0, 1 - least / np.maximum(others, 1), 0.0)
    some = np.bincount(doc, minlength=n) > 0
    names = np.array(model.langs, dtype=object)
    return list(np.where(some, names[best], UNKNOWN)), np.where(some, score, 0.0)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, o, word): the distinct words of each text, with their hash."""
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            points, starts, ends, _ = word_spans([text or ""])
            short = ends - starts <= WORD_LETTERS
            _, first, _ = tb.distinct(tb.hashed_points(points, starts[short], ends[short]))
            flat = points.astype("<u4").tobytes()
            found = [flat[4 * s : 4 * e].decode("utf-32-le", "surrogatepass") for s, e in zip(starts[short][first], ends[short][first], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in found], pa.int64()), pa.array(found, pa.string())], ["lang", "o", "word"])


def training_sample(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, words_per_lang: int = SAMPLE_WORDS, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple:
    """Words by language, from at most docs_per_lang documents each; only words_per_lang of them reach the driver."""
    fold = F.pmod(F.crc32(F.col(doc_col).cast("string").cast("binary")), F.lit(FOLDS))
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold != HELD_OUT)).select(F.col(doc_col).alias("d"), F.col(lang_col).alias("lang"), F.xxhash64(doc_col).alias("o"))
    # A hot language is cut to its first documents in each hash shard before its shards meet.
    shard = usable.withColumn("s", F.pmod(F.xxhash64("o"), F.lit(64)))
    near = shard.withColumn("k", F.row_number().over(W.partitionBy("lang", "s").orderBy("o", "d"))).filter(F.col("k") <= docs_per_lang)
    best = near.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("o", "d"))).filter(F.col("k") <= docs_per_lang)
    picked = best.select("d", "lang").distinct().collect()  # at most docs_per_lang ids a language
    if not picked:
        return ()
    ids: dict[str, list] = {}
    for r in picked:
        ids.setdefault(r.lang, []).append(r.d)
    chosen = reduce(lambda a, b: a | b, ((F.col(lang_col) == lang) & F.col(doc_col).isin(own) for lang, own in ids.items()))
    texts = docs.filter(chosen).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    found = texts.mapInArrow(_words, "lang string, o long, word string").distinct()
    kept = found.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("o", "word"))).filter(F.col("k") <= words_per_lang)
    sample: dict[str, list[str]] = {}
    for r in kept.orderBy("lang", "k").collect():
        sample.setdefault(r.lang, []).append(r.word)
    return tuple((k, tuple(v)) for k, v in sorted(sample.items()))


def identify(docs: DataFrame, sample: tuple | None = None, doc_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: bool = False) -> DataFrame:
    """Per row: doc_col (all columns with keep), held_out, lang_pred and score."""
    ship(docs.sparkSession)
    if sample is None:
        sample = training_sample(docs, doc_col=doc_col, text_col=text_col, lang_col=lang_col)
    sent = docs.sparkSession.sparkContext.broadcast(sample)  # bounded by languages x SAMPLE_WORDS words
    kept = [c for c in docs.columns if c not in ("held_out", "lang_pred", "score")] if keep else [doc_col]
    # Kept columns travel as one, so that their names clash with none.
    rows = docs.select(F.struct(*(F.col(c) for c in kept)).alias("row"), F.lit(None).cast("string").alias("text") if keep and text_col in kept else F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tb.claim("language_id", _models.clear)
        model = model_of(sent.value)
        for batch in batches:
            column = pc.struct_field(batch.column(0), text_col) if text_col in kept else batch.column(1)
            for i, j, _, _ in tb.chunks(column):
                names, scores = predict([t or "" for t in column.slice(i, j - i).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names, pa.string()), pa.array(scores)], ["row", "lang_pred", "score"])

    out = rows.mapInArrow(work, StructType([rows.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
    own = F.col("row")[doc_col]
    held = F.coalesce(F.pmod(F.crc32(own.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return out.select(*(F.col("row")[c].alias(c) for c in kept), held.alias("held_out"), "lang_pred", "score")
