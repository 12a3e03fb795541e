"""Telephony media columns: companded and ADPCM wave files to resampled PCM (operator 6)."""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import blocks
from .store import ship, table

MU_LAW, A_LAW, IMA_ADPCM, PCM = 7, 6, 0x11, 1
UNIT = 192

# Fixed values of the IMA ADPCM format: quantiser steps and index changes.
IMA_STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mu_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    size = (((code & 15).astype(np.int32) << 3) + 132) << ((code >> 4) & 7)
    return np.where(code & 128, 132 - size, size - 132).astype(np.int16)


def _a_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    part, low = ((code >> 4) & 7).astype(np.int32), ((code & 15).astype(np.int32) << 4) + 8
    size = np.where(part > 0, (low + 256) << np.maximum(part - 1, 0), low)
    return np.where(code & 128, size, -size).astype(np.int16)


TABLES = {MU_LAW: _mu_table(), A_LAW: _a_table()}


def write_wave(data: bytes, tag: int, rate: int = 8000, align: int = 1, bits: int = 8) -> bytes:
    """A mono RIFF wave file around `data`, which is kept byte for byte."""
    if tag == IMA_ADPCM:
        per_block = (align - 4) * 2 + 1
        told = struct.pack("<HHIIHHHH", tag, 1, rate, rate * align // per_block, align, 4, 2, per_block)
        samples = len(data) // align * per_block
    else:
        told = struct.pack("<HHIIHHH", tag, 1, rate, rate * align, align, bits, 0)
        samples = len(data) // align
    pad = b"\0" * (len(data) & 1)
    body = b"WAVEfmt " + struct.pack("<I", len(told)) + told + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, data) of a wave file; ValueError if it is none."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at, told = 12, None
    while at + 8 <= len(media):
        kind, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate, _, align = struct.unpack_from("<HHIIH", media, at + 8)
            told = tag, rate, align
        elif kind == b"data" and told:
            return (*told, media[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def decode_ima(data: bytes | np.ndarray, align: int) -> np.ndarray:
    """Samples of IMA ADPCM blocks, all blocks at once: one step for each nibble of a block."""
    raw = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    raw = raw[: len(raw) // align * align].reshape(-1, align)
    n = len(raw)
    out = np.empty((n, (align - 4) * 2 + 1), np.int16)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    out[:, 0] = value
    for k in range((align - 4) * 2):
        nibble = (raw[:, 4 + k // 2] >> (4 * (k & 1))) & 15
        step = IMA_STEPS[index]
        size = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -size, size), -32768, 32767)
        index = np.clip(index + IMA_MOVES[nibble & 7], 0, 88)
        out[:, k + 1] = value
    return out.ravel()


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a mu-law, A-law, IMA ADPCM or 16-bit PCM wave file."""
    tag, rate, align, data = read_wave(media)
    if tag in TABLES:
        return rate, TABLES[tag][np.frombuffer(data, np.uint8)]
    if tag == IMA_ADPCM:
        return rate, decode_ima(data, align)
    if tag == PCM:
        return rate, np.frombuffer(data, "<i2")
    raise ValueError(f"format tag {tag}")


def double_rate(samples: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the floor mean of it and the next (the last repeats)."""
    out = np.empty(2 * len(samples), np.int16)
    wide = samples.astype(np.int32)
    out[::2] = samples
    out[1::2] = (wide + np.append(wide[1:], wide[-1:])) >> 1
    return out


def to_pcm(df: DataFrame, media: str = "media", out: str = "pcm") -> DataFrame:
    """Add `out`: the 16-bit PCM wave file at twice the rate of each wave file in `media`.

    Null where `media` is null or can't be read; other columns stay, a column
    already named `out` is replaced.
    """
    ship(df.sparkSession)

    @F.pandas_udf("binary")
    def convert(column):
        def one(x):
            try:
                return resampled(bytes(x))
            except (ValueError, TypeError, struct.error):
                return None

        return column.map(one)

    return df.withColumn(out, convert(F.col(media)))


def payload_of(text: str | bytes | None, unit: int = UNIT) -> bytes:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw + b" " * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def pcm_file(rate: int, samples: np.ndarray) -> bytes:
    """The 16-bit PCM wave file of samples at twice their rate."""
    return write_wave(double_rate(samples).astype("<i2").tobytes(), PCM, 2 * rate, 2, 16)


def resampled(media: bytes) -> bytes:
    """The 16-bit PCM wave file at twice the rate of a wave file."""
    return pcm_file(*decode(media))


def decode_all(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """decode() of every file; the ADPCM blocks of all files of a block size are decoded at once."""
    out: list = [None] * len(files)
    held: dict[int, list] = {}
    for i, media in enumerate(files):
        tag, rate, align, data = read_wave(media)
        if tag == IMA_ADPCM:
            held.setdefault(align, []).append((i, rate, data[: len(data) // align * align]))
        else:
            out[i] = decode(media)
    for align, group in held.items():
        samples = decode_ima(b"".join(data for *_, data in group), align)
        cuts = np.cumsum([len(data) // align * ((align - 4) * 2 + 1) for *_, data in group])
        for (i, rate, _), own in zip(group, np.split(samples, cuts[:-1]), strict=True):
            out[i] = rate, own
    return out


def feature(pcm: bytes) -> str:
    """The feature line of a 16-bit PCM wave file."""
    rate, samples = decode(pcm)
    wide = samples.astype(np.int64)
    crossings = np.count_nonzero(np.diff(samples < 0))
    return f"rate={rate};samples={len(wide)};rms={math.isqrt(int(wide @ wide) // len(wide))};peak={np.abs(wide).max()};crossings={crossings}"


#: Data bytes of an ADPCM block that stores a payload, behind its header of 4.
BLOCK = 192


def store_payload(payload: bytes, tag: int) -> bytes:
    """A wave file that holds the payload bit for bit: as companded samples, or as the nibbles of ADPCM blocks.

    Every ADPCM block starts at sample 0 and step index 0.
    """
    if tag != IMA_ADPCM:
        return write_wave(payload, tag)
    blocks_ = np.zeros((len(payload) // BLOCK, BLOCK + 4), np.uint8)
    blocks_[:, 4:] = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    return write_wave(blocks_.tobytes(), tag, align=BLOCK + 4)


def read_payload(media: bytes) -> bytes:
    """What store_payload() stored."""
    tag, _, align, data = read_wave(media)
    return data if tag != IMA_ADPCM else np.frombuffer(data, np.uint8).reshape(-1, align)[:, 4:].tobytes()


#: Codecs among which a payload's checksum chooses.
CODECS = (MU_LAW, A_LAW, IMA_ADPCM)


def codec_of(payload: bytes) -> int:
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def media_digests(docs: DataFrame, tag: int | None = None, keep_media: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as the codes of a telephony wave file, read it back, resample and describe it.

    The payload is the UTF-8 text and blanks up to a positive multiple of 192
    bytes; a null text counts as empty (192 blanks), a long one is stored whole.
    `tag` is mu-law, A-law or IMA ADPCM for all of them; by default the payload's
    checksum chooses one, so all three decoders run.  The stored file's bytes are
    read again, decoded and stored as 16-bit PCM at twice the rate, which the
    feature describes and pcm_bytes and pcm_sha256 tell.  Equal texts give equal values, repeated rows a row each, a
    null doc_id stays null, an empty table no rows; other columns are not read.
    `keep_media` adds the file itself as `media` and the PCM file as `pcm`.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string" + ", media binary, pcm binary" * keep_media
    def describe(batches):
        for batch in batches:
            for first, end, data, offsets in blocks(batch.column(1)):
                raw, rows = data.tobytes(), []
                payloads = [payload_of(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                files = [store_payload(p, codec_of(p) if tag is None else tag) for p in payloads]
                for n, stored, heard in zip(np.diff(offsets).tolist(), files, decode_all(files), strict=True):
                    back, pcm = read_payload(stored), pcm_file(*heard)
                    rows.append([n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(pcm), len(pcm), hashlib.sha256(pcm).hexdigest(), *[stored, pcm] * keep_media])
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary())
                names = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False))], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(describe, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
