"""Language identification by averaged hashed subword embeddings and a linear softmax.

Subwords are the n-grams (2 to 4 bytes, lower-cased) of a word and its two borders. Each hashes to a
row of an embedding table; a text is the mean of its rows, a linear softmax gives probabilities.
Table and softmax are trained together by stochastic gradient descent in numpy on SAMPLE documents
(those of the smallest hash of doc_id among the rows to learn from) and on texts of no language made
from them: letters dealt anew within the text, and letters of random scripts. Those are a class of
their own, which is never predicted but takes chance from the languages.

A fifth of the sample calibrates: the temperature is that of the least log loss; the score below
which a prediction is rejected lies half-way (in log odds) between the score that all but REJECT of
the correct predictions reach, of each language, and the one that all but REJECT of the texts of no
language stay under; where these overlap, it is the former. For prediction, table and softmax
multiply out to one row of logits a bucket, so a text costs a lookup a subword.

Only text and lang of rows to learn from are used, never doc_id or source as an input.

Defined cases: a text that is null or has no letter is `und`, score 0, rejected; without rows to
learn from every text is; ties go to the smaller language; texts of any length are processed whole,
in bounded blocks; repeated rows stay repeated; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import blocks, joined, parts, small_batches, utf8

SAMPLE = 3000
BUCKETS = 1 << 15
WIDTH = 12
#: Shares of the sample that calibration may get wrong; bytes of a text of no language.
REJECT = 0.005
NOISE = 2000
CHUNK = 1 << 20
UNKNOWN = "und"
SIZES = (2, 3, 4)

_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[97:123] = _PLAIN[65:91] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def plain(data: np.ndarray) -> np.ndarray:
    """ASCII letters lower-cased, other ASCII to spaces; Latin-1 capitals of UTF-8 lower-cased."""
    out = _PLAIN[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[capital] += 0x20
    return out


def subwords(text: np.ndarray):
    """(start, bucket) arrays, one pair for each n-gram length, of a buffer from `plain`."""
    space = text == 32
    spaces = np.zeros(len(text) + 1, np.int32)
    np.cumsum(space, out=spaces[1:])
    wide = text.astype(np.uint32)
    for n in SIZES:
        count = len(text) - n + 1
        if count <= 0:
            continue
        value = np.full(count, n, np.uint32)
        for i in range(n):
            value = value * np.uint32(257) + wide[i : i + count]
        inner = spaces[n - 1 : n - 1 + count] - spaces[1 : 1 + count]
        keep = np.flatnonzero((inner == 0) & ~(space[:count] & space[n - 1 : n - 1 + count]))
        yield keep, ((value[keep] * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int32)


def framed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a border before and after each, and where each begins."""
    data, offsets = joined([b" " + t + b" " for t in texts])
    return plain(data), offsets


def pieces_of(data: np.ndarray):
    """(start, bucket) arrays of a buffer from `plain`, in blocks that overlap so that no n-gram is lost."""
    for lo in range(0, len(data), CHUNK):
        for start, bucket in subwords(data[lo : lo + CHUNK + max(SIZES) - 1]):
            own = np.searchsorted(start, CHUNK)
            yield start[:own] + lo, bucket[:own]


def counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(BUCKETS, np.int64)
    for _, bucket in pieces_of(plain(np.frombuffer(b" " + raw + b" ", np.uint8))):
        total += np.bincount(bucket, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def no_language(text: str, seed: int) -> str:
    """A text of no language, of about NOISE bytes at most: letters of the text dealt anew, or those of random scripts in their places."""
    rng = np.random.default_rng(seed)
    code = np.frombuffer(text[:NOISE].encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letter = np.flatnonzero(np.array([chr(c).isalpha() for c in code.tolist()], bool))
    if seed % 2:
        code[letter] = code[rng.permutation(letter)] if rng.random() < 0.5 else rng.integers(97, 123, len(letter))
    else:
        low = int(rng.integers(0x0370, 0xD000))
        code[letter] = rng.integers(low, low + int(rng.integers(30, 2000)), len(letter))
    return "".join(map(chr, code.tolist()))


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[np.ndarray, np.ndarray]], labels: list[str | None], epochs: int = 4, rate: float = 0.5) -> Model:
    """Fit on the samples; None labels those of no language, the last class."""
    languages = sorted({x for x in labels if x is not None})
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 1.0)
    classes = len(languages) + 1
    target = np.array([classes - 1 if x is None else languages.index(x) for x in labels])
    rng = np.random.default_rng(0)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, classes)), np.zeros(classes)
    order = rng.permutation(len(samples))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    steps, done = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            bucket, count = samples[i]
            if not len(bucket):
                continue
            share = count / count.sum()
            mean = share @ table[bucket]
            error = softmax(mean @ weights + bias)
            error[target[i]] -= 1
            step = rate * (1 - done / steps)
            back = weights @ error
            weights -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            # the mean's gradient is shared out; scaled up, as each of many buckets has a small share
            table[bucket] -= step * np.outer(np.minimum(share * 20, 1.0), back)
            done += 1
    logits = table @ weights
    z = np.array([(samples[i][1] / max(1, samples[i][1].sum())) @ logits[samples[i][0]] + bias for i in held]) if len(held) else np.zeros((0, classes))
    temperature, threshold = calibrate(z, target[held])
    return Model(languages, logits.astype(np.float32), bias, temperature, threshold)


def calibrate(z: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the score below which a prediction is rejected."""
    none = z.shape[1] - 1
    if not (target < none).any():
        return 1.0, 0.0
    grid = np.geomspace(0.0005, 20, 200)
    loss = [-np.log(softmax(z / t)[np.arange(len(z)), target] + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(z / t)[:, :none]
    best, score = p.argmax(axis=1), p.max(axis=1)
    right = [np.quantile(score[(target == c) & (best == c)], REJECT, method="lower") for c in range(none) if ((target == c) & (best == c)).any()]
    low = float(min(right, default=0.0))
    high = float(np.quantile(score[target == none], 1 - REJECT, method="higher")) if (target == none).any() else low
    if high >= low:
        return t, low
    odds = np.log(np.clip([low, high], 1e-9, 1 - 1e-9)) - np.log1p(-np.clip([low, high], 1e-9, 1 - 1e-9))
    return t, float(1 / (1 + np.exp(-odds.mean())))


def learn(docs: DataFrame, learnable: Column, sample: int = SAMPLE, seed: int = 7) -> Model:
    """Fit on `sample` rows at most; executors count subwords, so a row to the driver is bounded."""
    rows = small_batches(docs).filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    ids = [r[0] for r in rows.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).collect()]
    chosen = rows.filter(F.col("doc_id").isin(list(set(ids)))).select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string")) if ids else None

    def count(batches):
        for b in parts(batches, 2, CHUNK):
            ids, texts = b.column(0).to_pylist(), b.column(2).to_pylist()
            # every row has a text, every other one a text of no language beside it
            rows = [(i, lang, counts(utf8(t))) for i, lang, t in zip(ids, b.column(1).to_pylist(), texts, strict=True)]
            seeds = [xxhash.xxh64_intdigest(f"{i}/{len(t)}") for i, t in zip(ids, texts, strict=True)]
            rows += [(i, None, counts(utf8(no_language(t, s >> 1)))) for i, t, s in zip(ids, texts, seeds, strict=True) if s & 1 and has_letter(t)]
            columns = [pa.array([r[2][i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), *columns], names=["doc_id", "lang", "bucket", "times"])

    got = chosen.mapInArrow(count, "doc_id long, lang string, bucket array<int>, times array<int>").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "lang", F.size("bucket")).limit(2 * sample).toArrow() if ids else None
    if got is None:
        return train([], [])
    pairs = [(np.asarray(b.values), np.asarray(t.values)) for b, t in zip(got["bucket"], got["times"], strict=True)]
    return train(pairs, got["lang"].to_pylist())


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and its calibrated probability of each text."""
    raw = [utf8(t) for t in texts]
    best, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
    n = len(model.languages)  # the class of no language comes after them
    for lo, hi in blocks([len(r) + 2 for r in raw], CHUNK):
        data, offsets = framed(raw[lo:hi])
        total, size = np.zeros((hi - lo, model.logits.shape[1])), np.zeros(hi - lo)
        for start, bucket in pieces_of(data):
            if not len(start):
                continue
            doc = np.searchsorted(offsets, start, side="right") - 1
            cuts = np.flatnonzero(np.diff(doc, prepend=-1))
            total[doc[cuts]] += np.add.reduceat(model.logits[bucket], cuts, axis=0)
            size[doc[cuts]] += np.diff(cuts, append=len(doc))
        for i in range(hi - lo):
            if n and has_letter(texts[lo + i]):
                p = softmax((total[i] / max(1, size[i]) + model.bias) / model.temperature)[:n]
                best[lo + i], score[lo + i] = model.languages[int(p.argmax())], p.max()
    return best, score


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row."""

    def run(batches):
        for b in parts(batches, 1, CHUNK):
            best, score = predict(model, b.column(1).to_pylist())
            sure = [x != UNKNOWN and s >= model.threshold for x, s in zip(best, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose language is accepted, all columns as they are."""

    @F.pandas_udf("boolean")
    def sure(text: pd.Series) -> pd.Series:
        each = [predict(model, list(text[lo:hi])) for lo, hi in blocks([len(t) if t else 0 for t in text], CHUNK)]
        best = [x for b, _ in each for x in b]
        score = np.concatenate([np.zeros(0), *[s for _, s in each]])
        return pd.Series([x != UNKNOWN and s >= model.threshold for x, s in zip(best, score.tolist(), strict=True)], dtype=bool)

    return small_batches(docs).filter(sure(F.col("text").cast("string")))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
