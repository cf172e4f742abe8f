"""Media columns: telephony audio.

G.711 mu-law and A-law bytes expand by lookup tables of 256 entries that the companding formulas
give. IMA ADPCM blocks decode with numpy across blocks: step k of every block at once. A stored
medium is a WAV file: `wav` puts a payload of bytes into one without loss, one byte a sample, `unwav`
takes it out again. `resample` makes PCM of another rate, which is stored as a WAV file too
(`pcm_column`; the query reads such a file back for its features and returns the file's digest).

Defined cases: a null text counts as an empty one; an empty one is one unit of padding; a null
medium has a null PCM; long texts
are processed whole, in blocks of samples that hold one text at least; equal texts give equal values; repeated rows stay
repeated; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import blocks, parts, small_batches, utf8

UNIT = 576
RATE = 8000
MULAW, ALAW, PCM = 7, 6, 1
#: Bytes that are decoded at a time.
CHUNK = UNIT * 4096


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code & 0x70) >> 4)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    shift, low = (code & 0x70) >> 4, (code & 0x0F) << 4
    size = np.where(shift == 0, low + 8, low + 0x108 << np.maximum(shift - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}
# Fixed values of the IMA ADPCM standard.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: The difference that each nibble adds at each step size, and the step that follows.
DELTAS = np.array([[(-1 if n & 8 else 1) * ((s >> 3) + (s >> 2) * (n & 1) + (s >> 1) * (n >> 1 & 1) + s * (n >> 2 & 1)) for n in range(16)] for s in STEPS.tolist()], np.int32).ravel()
NEXT = np.array([[min(88, max(0, i + d)) for d in INDEX.tolist()] for i in range(89)], np.int32).ravel()


def expand(samples: np.ndarray, law: int) -> np.ndarray:
    return TABLES[law][samples]


def decode_adpcm(data: np.ndarray) -> np.ndarray:
    """Blocks (one a row: predictor, step index, a spare byte, nibbles) to PCM rows."""
    n, width = data.shape
    value = data[:, :2].copy().view("<i2").ravel().astype(np.int32)
    step = np.minimum(data[:, 2], 88).astype(np.int32)
    body = np.ascontiguousarray(data[:, 4:].T)
    out = np.empty((2 * (width - 4) + 1, n), np.int16)
    out[0] = value
    for k in range(width - 4):
        for half, nibble in enumerate((body[k] & 15, body[k] >> 4)):
            at = step * 16 + nibble
            value = np.clip(value + DELTAS[at], -32768, 32767)
            step = NEXT[at]
            out[2 * k + 1 + half] = value
    return out.T


def encode_adpcm(pcm: np.ndarray, width: int) -> np.ndarray:
    """The inverse of decode_adpcm up to its loss: PCM rows of 2 * (width - 4) + 1 samples to blocks."""
    n = len(pcm)
    data = np.zeros((n, width), np.uint8)
    value, step = pcm[:, 0].astype(np.int32), np.zeros(n, np.int32)
    data[:, :2] = pcm[:, :1].astype("<i2").view(np.uint8)
    for k in range(2 * (width - 4)):
        gap = np.abs(DELTAS.reshape(89, 16)[step] + value[:, None] - pcm[:, k + 1, None].astype(np.int32))
        nibble = gap.argmin(axis=1).astype(np.int32)
        value = np.clip(value + DELTAS[step * 16 + nibble], -32768, 32767)
        step = NEXT[step * 16 + nibble]
        data[:, 4 + k // 2] |= (nibble << 4 * (k % 2)).astype(np.uint8)
    return data


def resample(pcm: np.ndarray, up: int, down: int) -> np.ndarray:
    """Linear interpolation between samples, in whole numbers: sample k is at k * down / up.

    For a lower rate the binomial kernel 1 4 6 4 1 takes off what that rate can't carry, before."""
    if not len(pcm):
        return pcm
    if up < down:
        wide = np.pad(pcm.astype(np.int32), 2, mode="edge")
        n = len(pcm)
        pcm = ((wide[:n] + wide[4 : 4 + n] + 4 * (wide[1 : 1 + n] + wide[3 : 3 + n]) + 6 * wide[2 : 2 + n] + 8) >> 4).astype(np.int16)
    at = np.arange((len(pcm) * up + down - 1) // down, dtype=np.int64) * down
    whole, part = at // up, at % up
    a, b = pcm[whole].astype(np.int64), pcm[np.minimum(whole + 1, len(pcm) - 1)].astype(np.int64)
    return ((a * (up - part) + b * part) // up).astype(np.int16)


def wav(data: bytes, law: int = MULAW, rate: int = RATE) -> bytes:
    """A WAV file of one channel; one byte a sample (mu-law, A-law) or two (PCM)."""
    width = 2 if law == PCM else 1
    head = struct.pack("<4sI4s4sIHHIIHHH4sI", b"RIFF", 38 + len(data) + (len(data) & 1), b"WAVE", b"fmt ", 18, law, 1, rate, rate * width, width, 8 * width, 0, b"data", len(data))
    return head + data + b"\0" * (len(data) & 1)


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """Law, rate and the bytes of the data chunk."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, law, rate = 12, 0, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            law, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif name == b"data":
            return law, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def payload_of(raw: bytes, unit: int = UNIT) -> bytes:
    """Padded by bytes 255 to a positive multiple of the unit."""
    return raw + b"\xff" * (-len(raw) % unit if raw else unit)


def resampled(mu: np.ndarray, rate: int) -> bytes:
    """A WAV file of the PCM at another rate."""
    return wav(resample(mu, rate, RATE).astype("<i2").tobytes(), PCM, rate)


def features(payloads: list[bytes], rate: int = 6000) -> list[tuple[str, int, str]]:
    """Of each payload: the feature (level, crossings and peak as mu-law, level as A-law, level as ADPCM blocks, level of
    the stored PCM of another rate), and the bytes and digest of that stored PCM."""
    if not payloads:
        return []
    data = np.frombuffer(b"".join(payloads), np.uint8)
    sizes = np.array([len(p) for p in payloads])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mu, a = expand(data, MULAW), expand(data, ALAW)
    power = lambda x, at: np.add.reduceat(x.astype(np.int64) ** 2, at)
    turn = np.zeros(len(data), np.int64)
    turn[1:] = (mu[1:] < 0) != (mu[:-1] < 0)
    turn[starts] = 0
    blocks_pcm = decode_adpcm(data.reshape(-1, UNIT))
    each = (blocks_pcm.astype(np.int64) ** 2).sum(axis=1)
    ad = np.add.reduceat(each, starts // UNIT)
    per = blocks_pcm.shape[1]
    peak = np.maximum.reduceat(np.abs(mu.astype(np.int32)), starts)
    mus, als, crossings = power(mu, starts), power(a, starts), np.add.reduceat(turn, starts)
    out = []
    for i, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        stored = resampled(mu[s : s + n], rate)
        back = np.frombuffer(unwav(stored)[2], "<i2").astype(np.int64)
        low = int((int((back**2).sum()) // len(back)) ** 0.5)
        feature = f"mu_rms={int((mus[i] // n) ** 0.5)};mu_zc={crossings[i]};mu_peak={peak[i]};a_rms={int((als[i] // n) ** 0.5)};adpcm_rms={int((ad[i] // (n // UNIT * per)) ** 0.5)};pcm_rms={low}"
        out.append((feature, len(stored), hashlib.sha256(stored).hexdigest()))
    return out


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def digests(batches):
    for batch in parts(batches, 1, CHUNK):
        ids, raw = batch.column(0), [utf8(t) for t in batch.column(1).to_pylist()]
        rows = []
        for lo, hi in blocks([len(r) + UNIT for r in raw], CHUNK):
            media = [wav(payload_of(r)) for r in raw[lo:hi]]
            back = [unwav(m)[2] for m in media]
            for r, m, p, f in zip(raw[lo:hi], media, back, features(back), strict=True):
                rows.append((len(r), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), *f))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def telephony(docs: DataFrame) -> DataFrame:
    """Store each text as a mu-law WAV file, read it back, and return its digests and features."""
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digests, SCHEMA)


def media_column(docs: DataFrame, law: int = MULAW) -> DataFrame:
    """doc_id and the WAV file itself, as a binary column."""

    def make(batches):
        for b in parts(batches, 1, CHUNK):
            files = pa.array([wav(payload_of(utf8(t)), law) for t in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), files], names=["doc_id", "media"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(make, "doc_id long, media binary")


def pcm_column(media: DataFrame, rate: int = 16000) -> DataFrame:
    """doc_id and the file expanded to PCM of another rate, again a WAV file; null for null."""

    def one(m: bytes | None) -> bytes | None:
        if m is None:
            return None
        law, was, data = unwav(m)
        pcm = np.frombuffer(data, "<i2") if law == PCM else expand(np.frombuffer(data, np.uint8), law)
        return wav(resample(pcm, rate, was).astype("<i2").tobytes(), PCM, rate)

    def make(batches):
        for b in parts(batches, 1, CHUNK):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(one, b.column(1).to_pylist())), pa.binary())], names=["doc_id", "media"])

    return small_batches(media).select(F.col("doc_id").cast("long"), F.col("media").cast("binary")).mapInArrow(make, "doc_id long, media binary")
