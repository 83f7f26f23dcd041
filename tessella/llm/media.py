"""Telephony audio: texts as payloads of 8-bit samples.

A payload is the text's UTF-8 bytes, zero-padded to a positive multiple of 64. It is stored losslessly as
a WAV file of 8-bit mu-law samples at 8 kHz, in a column of a Parquet table in the shared folder; what follows reads
that table. Decoding expands mu-law and A-law by lookup tables of 256 values and IMA ADPCM blocks of 64 bytes
(4 of head, 120 nibbles) with one numpy step for each nibble across all blocks of a chunk of files. PCM is
resampled to 16 kHz by a half-band filter; `decode` gives it as a column of 16-bit WAV files to store.

Features of a file: the number of mu-law samples, the rounded root mean square of mu-law and of A-law
expansion, the crc32 of the decoded ADPCM and of the resampled PCM.

Defined cases: null text is an empty one, so its payload is 64 zero bytes; equal texts have equal values; repeated rows
each get a row; an empty table gives an empty result; other columns are ignored. Work goes by chunks of about half a MB of
text, a longer text by itself; its samples are decoded by blocks of STEP bytes, so that memory is bounded by a few times
its bytes. Only where PCM is asked for, 4 bytes for each byte of text have to fit into one value (texts up to 512 MB).
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import textbytes as tb
from tessella.session import materialize, settle, ship

UNIT, RATE = 64, 8000
#: Bytes of a payload that are decoded at once.
STEP = 1 << 20
#: Fixed values of the IMA ADPCM format: index moves by nibble, and step sizes.
INDEX_MOVES = (-1, -1, -1, -1, 2, 4, 6, 8)
STEP_SIZES = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
_HALFBAND = np.array([-3, 0, 19, 32, 19, 0, -3], np.float32) / 32


def mu_law() -> np.ndarray:
    """The 16-bit value of each mu-law byte."""
    b = ~np.arange(256, dtype=np.uint8)
    size = (((b & 0x0F).astype(np.int32) << 3) + 0x84 << ((b & 0x70) >> 4).astype(np.int32)) - 0x84
    return np.where(b & 0x80, -size, size).astype(np.int16)


def a_law() -> np.ndarray:
    """The 16-bit value of each A-law byte."""
    b = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent = ((b & 0x70) >> 4).astype(np.int32)
    size = ((b & 0x0F).astype(np.int32) << 4) + 8
    size = np.where(exponent > 0, size + 0x100 << np.maximum(exponent - 1, 0), size)
    return np.where(b & 0x80, size, -size).astype(np.int16)


_MU, _A, _STEPS, _MOVES = mu_law(), a_law(), np.array(STEP_SIZES, np.int32), np.array(INDEX_MOVES * 2, np.int32)


def payload(text: bytes) -> bytes:
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def write_wav(samples: bytes, coding: int = 7, bits: int = 8, rate: int = RATE) -> bytes:
    """A WAV file; coding 7 is mu-law, 1 is PCM."""
    form = struct.pack("<HHIIHH", coding, 1, rate, rate * bits // 8, bits // 8, bits)
    size = 4 + 8 + len(form) + 8 + len(samples)
    return b"RIFF" + struct.pack("<I", size) + b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples


def read_wav(media: bytes) -> bytes:
    """The bytes of the data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack("<I", media[at + 4 : at + 8])[0]
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """Samples (block, 121) of IMA ADPCM blocks (block, 64): a 16-bit first sample, a step index, a filler and 120 nibbles, low ones first."""
    out = np.empty((121, len(blocks)), np.int16)
    now = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out[0] = now
    for i in range(120):
        nibble = body[i >> 1] >> 4 if i & 1 else body[i >> 1] & 15
        step = _STEPS[index]
        move = step >> 3
        move += np.where(nibble & 4, step, 0)
        move += np.where(nibble & 2, step >> 1, 0)
        move += np.where(nibble & 1, step >> 2, 0)
        now = np.clip(now + np.where(nibble & 8, -move, move), -32768, 32767)
        index = np.clip(index + _MOVES[nibble], 0, 88)
        out[i + 1] = now
    return out.T


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice as many samples: zeros between, then the half-band filter."""
    wide = np.zeros(2 * len(pcm), np.float32)
    wide[::2] = pcm
    return np.clip(np.rint(np.convolve(wide, _HALFBAND, "same")), -32768, 32767).astype("<i2")


def _feature(part: np.ndarray, decoded: Callable[[int, int], bytes]) -> tuple[str, list[bytes]]:
    """The feature string of a payload, and its resampled PCM by blocks."""
    squares, crcs, pcm = [0.0, 0.0], [0, 0], []
    for at in range(0, len(part), STEP):
        end = min(at + STEP, len(part))
        for k, law in enumerate((_MU, _A)):
            squares[k] += float(np.square(law[part[at:end]].astype(np.float64)).sum())
        crcs[0] = zlib.crc32(decoded(at, end), crcs[0])
        # The filter reaches two samples to either side.
        low, high = max(0, at - 2), min(len(part), end + 2)
        wide = resample(_MU[part[low:high]])[2 * (at - low) : 2 * (end - low)].tobytes()
        crcs[1] = zlib.crc32(wide, crcs[1])
        pcm.append(wide)
    rms = [int(np.rint(np.sqrt(x / len(part)))) for x in squares]
    return f"mulaw8k:{len(part)}:{rms[0]}:{rms[1]}:{crcs[0]:08x}:{crcs[1]:08x}", pcm


def features(stored: list[bytes], with_pcm: bool = True) -> tuple[list[str], list[bytes]]:
    """A feature string and, if asked for, the resampled PCM file of each payload read back."""
    names, files = [], []
    sizes = [len(x) for x in stored]
    # Small files are decoded together, large ones by steps.
    small = [np.frombuffer(x, np.uint8) for x in stored if len(x) <= STEP]
    together = adpcm(np.concatenate(small).reshape(-1, UNIT)).astype("<i2") if small else None
    place = 0
    for raw, size in zip(stored, sizes, strict=True):
        part = np.frombuffer(raw, np.uint8)
        if size <= STEP:
            blocks = together[place : place + size // UNIT]
            place += size // UNIT
            name, pcm = _feature(part, lambda a, b, blocks=blocks: blocks.tobytes())
        else:
            name, pcm = _feature(part, lambda a, b, part=part: adpcm(part[a:b].reshape(-1, UNIT)).astype("<i2").tobytes())
        names.append(name)
        if with_pcm:
            files.append(write_wav(b"".join(pcm), 1, 16, 2 * RATE))
    return names, files


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in tb.chunks(batch.column(1)):
            raw = memoryview(data)
            media = [write_wav(payload(bytes(raw[a:b]))) for a, b in zip(offsets, offsets[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets).astype(np.int64)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the files of all rows."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_write, "doc_id long, n_bytes long, media binary")


_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def decode(stored: DataFrame, with_pcm: bool = False) -> DataFrame:
    """Of a table (doc_id, n_bytes, media): what its files hold, and pcm (binary) if asked for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            at = 0
            while at < n:
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + tb.CHUNK, side="right")))
                part = batch.slice(at, upto - at)
                media = part.column(2).to_pylist()
                back = [read_wav(m) for m in media]
                names, pcm = features(back, with_pcm)
                cols = [
                    part.column(0),
                    part.column(1),
                    pa.array([len(x) for x in back], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                    pa.array([zlib.crc32(x[-UNIT:]) for x in back], pa.int64()),
                    pa.array([len(x) for x in media], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in media]),
                    pa.array(names),
                ]
                names = [x.partition(" ")[0] for x in _DIGESTS.split(", ")]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(pcm, pa.binary())] if with_pcm else [])], [*names, *(["pcm"] if with_pcm else [])])
                at = upto

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(work, _DIGESTS + ", pcm binary" * with_pcm)


def encode(docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, all of the stored files, which are deleted when they have been read."""
    spark = docs.sparkSession
    out = settle(spark, lambda: decode(materialize(store(docs, doc_col, text_col), "media", "zstd")), "digests")
    return out.withColumnRenamed("doc_id", doc_col)
