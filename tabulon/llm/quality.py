"""Quality classification without labels: a weak-label model and a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over all
documents estimates how often each labeller gives each vote to good and to bad documents, and so
each document's posterior. It needs the count of each combination of votes alone: at most
3 ** (number of labellers) rows, summed before they reach the driver. The posteriors of SAMPLE
documents (those of the smallest hash of doc_id) then train a logistic scorer by stochastic
gradient descent on hashed shape n-grams of the text, so it judges more than the heuristics see.
A document is kept if the scorer and the posterior together find it good.

Defined cases: a null or blank text has posterior and score 0 and is rejected; short texts make most
labellers abstain; texts are processed whole, in blocks of bytes that hold one text at least, so memory
grows with the longest text alone; repeated rows stay
repeated; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import Rolling, blocks, joined, parts, small_batches, utf8

SAMPLE = 4000
BUCKETS = 1 << 14
CHUNK = 1 << 20
#: Share of its votes that a labeller is taken to give at random, so that no single vote decides alone.
SMOOTHING = 0.0002
#: A bad vote is at least so many times as likely on a bad document as on a good one.
ADVANTAGE = 50
NAMES = ("symbols", "capitals", "shouting", "table", "repetition", "letters", "word_length", "function_words")

_SHAPE = np.full(256, ord("a"), np.uint8)
_SHAPE[:128] = np.arange(128)
_SHAPE[65:91], _SHAPE[97:123], _SHAPE[48:58] = ord("A"), ord("a"), ord("0")
_SHAPE[[9, 10, 11, 12, 13]] = 32
_UPPER, _LETTER, _SPACE, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[]^_`{}~\\"]] = True


class Stats:
    """Counts of each text of a block, and the places of its words."""

    def __init__(self, raw: list[bytes]):
        self.data, self.offsets = joined([t + b" " for t in raw])
        d, cut = self.data, self.offsets[:-1]
        add = lambda flags: np.add.reduceat(flags.astype(np.int64), cut)
        space = _SPACE[d]
        first = ~space & np.concatenate([[True], space[:-1]])
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
        self.doc = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.words = np.maximum(1, np.bincount(self.doc, minlength=len(raw)))
        self.empty = np.bincount(self.doc, minlength=len(raw)) == 0
        self.visible = np.maximum(1, add(~space))
        ascii_letters = add(_LETTER[d] & (d < 128))
        self.upper = add(_UPPER[d]) / np.maximum(1, ascii_letters)
        self.letters = add(_LETTER[d]) / self.visible
        self.symbols = add(_SYMBOL[d]) / self.words
        bang, bar = d == ord("!"), d == ord("|")
        self.bangs = add(bang & np.concatenate([[False], bang[:-1]])) / self.words
        self.bars = add(bar) / self.words
        hashes = Rolling(d).slices(self.start, self.end)
        self.again = np.concatenate([[False], (hashes[1:] == hashes[:-1]) & (self.doc[1:] == self.doc[:-1])]) if len(hashes) else np.zeros(0, bool)
        self.repeats = np.bincount(self.doc[self.again], minlength=len(raw)) / self.words
        self.length = self.visible / self.words
        short = np.bincount(self.doc[(self.end - self.start <= 3) & _LETTER[d[self.start]]], minlength=len(raw))
        self.short = short / self.words

    def votes(self) -> np.ndarray:
        """One row a text, one column a labeller: 1 good, -1 bad, 0 nothing."""
        bad_good = (
            (self.symbols > 0.5, None),
            (self.upper > 0.5, None),
            (self.bangs > 0.1, None),
            (self.bars > 0.15, None),
            (self.repeats > 0.2, None),
            (self.letters < 0.5, self.letters > 0.7),
            ((self.length > 20) | (self.length < 2), (self.length > 3) & (self.length < 12)),
            (None, (self.short > 0.1) & (self.repeats < 0.1) & (self.words >= 8)),
        )
        out = np.zeros((len(self.words), len(NAMES)), np.int8)
        for k, (bad, good) in enumerate(bad_good):
            if good is not None:
                out[good, k] = 1
            if bad is not None:
                out[bad & (self.words >= 8), k] = -1
        out[self.empty] = 0
        return out

    def features(self):
        """(document, bucket) of each token: shape n-grams, and a mark for each repeated word."""
        shape = _SHAPE[self.data].astype(np.uint32)
        for n in (2, 4):
            count = len(shape) - n + 1
            if count <= 0:
                continue
            value = np.full(count, n, np.uint32)
            for i in range(n):
                value = value * np.uint32(131) + shape[i : i + count]
            doc = np.searchsorted(self.offsets, np.arange(count), side="right") - 1
            own = np.flatnonzero(np.arange(n, count + n) <= self.offsets[doc + 1])  # not into the next text
            yield doc[own], ((value[own] * np.uint32(0x9E3779B1)) >> np.uint32(18)).astype(np.int32)
        yield np.repeat(self.doc[self.again], 8), np.zeros(8 * int(self.again.sum()), np.int32)


def coded(votes: np.ndarray) -> list[str]:
    return ["".join(map("+0-".__getitem__, 1 - r)) for r in votes]


@dataclass
class WeakLabels:
    prior: float
    good: np.ndarray  # labeller x vote (good, nothing, bad): chance on a good document
    bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance that each row's document is good. Abstentions say nothing: short texts cause most."""
        at = 1 - votes
        cols = np.arange(votes.shape[1])
        up = np.log(self.prior) + (np.log(self.good[cols, at]) * (votes != 0)).sum(axis=1)
        down = np.log(1 - self.prior) + (np.log(self.bad[cols, at]) * (votes != 0)).sum(axis=1)
        return 1 / (1 + np.exp(np.clip(down - up, -500, 500)))


def maximise(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, advantage: float = ADVANTAGE) -> WeakLabels:
    """Expectation-maximisation from the start that a bad vote is right nine times in ten."""
    k = patterns.shape[1]
    start = np.where((patterns < 0).any(axis=1), 0.1, 0.95)
    model, p = None, start
    at = 1 - patterns
    for _ in range(rounds):
        w = counts * p
        v = counts * (1 - p)
        prior = float(np.clip((w.sum() + 1) / (counts.sum() + 2), 0.02, 0.98))
        tally = lambda weight: np.stack([np.bincount(at[:, j], weight, 3) for j in range(k)])
        good, bad = (x + 1 + SMOOTHING * x.sum(axis=1, keepdims=True) for x in (tally(w), tally(v)))
        good[:, 2] = np.minimum(good[:, 2], good.sum(axis=1) * bad[:, 2] / bad.sum(axis=1) / advantage)
        model = WeakLabels(prior, good / good.sum(axis=1, keepdims=True), bad / bad.sum(axis=1, keepdims=True))
        new = model.posterior(patterns)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, epochs: int = 12, rate: float = 1.0) -> Scorer:
    """Logistic loss on soft labels, both classes of equal weight; steps scaled by coordinate."""
    weights, bias = np.zeros(BUCKETS), 0.0
    seen = np.full(BUCKETS, 1e-4)
    rng = np.random.default_rng(0)
    share = float(np.clip(target.mean() if len(target) else 0.5, 0.05, 0.95))
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            bucket, count = rows[i]
            if not len(bucket):
                continue
            x = count / count.sum()
            p = 1 / (1 + np.exp(-np.clip(x @ weights[bucket] + bias, -50, 50)))
            g = (p - target[i]) * (target[i] * 0.5 / share + (1 - target[i]) * 0.5 / (1 - share))
            seen[bucket] += (g * x) ** 2
            weights[bucket] -= rate * g * x / np.sqrt(seen[bucket])
            bias -= 0.05 * g
    return Scorer(weights.astype(np.float32), bias)


@dataclass
class Model:
    labels: WeakLabels
    scorer: Scorer


def each_block(batch: pa.RecordBatch):
    raw = [utf8(t) for t in batch.column(1).to_pylist()]
    for lo, hi in blocks([len(r) + 1 for r in raw], CHUNK):
        yield lo, hi, Stats(raw[lo:hi])


def columns_of(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def learn(docs: DataFrame, sample: int = SAMPLE, seed: int = 11) -> Model:
    """Labellers' accuracies from all rows, and a scorer from `sample` of them at most; an empty table gives a scorer of zeros."""
    def vote(batches):
        for b in parts(batches, 1, CHUNK):
            votes = [v for _, _, s in each_block(b) for v in coded(s.votes())]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.string())], names=["votes"])

    tally = columns_of(docs).mapInArrow(vote, "votes string").groupBy("votes").count().orderBy("votes").collect()
    if not tally:
        return Model(maximise(np.zeros((1, len(NAMES)), np.int8), np.ones(1)), Scorer(np.zeros(BUCKETS, np.float32), 0.0))
    unpack = lambda texts: np.array([["+0-".index(c) for c in t] for t in texts], np.int8).reshape(-1, len(NAMES))
    labels = maximise(1 - unpack([r["votes"] for r in tally]), np.array([r["count"] for r in tally], float))
    ids = [r[0] for r in docs.select("doc_id").filter(F.col("doc_id").isNotNull()).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).collect()]

    def count(batches):
        for b in parts(batches, 1, CHUNK):
            out: list[tuple] = []
            for lo, hi, s in each_block(b):
                table = np.concatenate([d.astype(np.int64) * BUCKETS + k for d, k in s.features()])
                keys, times = np.unique(table, return_counts=True)
                bounds = np.searchsorted(keys, np.arange(hi - lo + 1) * BUCKETS)
                for i, v in enumerate(coded(s.votes())):
                    own = slice(bounds[i], bounds[i + 1])
                    out.append((v, (keys[own] % BUCKETS).astype(np.int32), times[own].astype(np.int32)))
            kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([o[i] for o in out], kinds[i]) for i in range(3)]], names=["doc_id", "votes", "bucket", "times"])

    chosen = columns_of(docs.filter(F.col("doc_id").isin(list(set(ids)))))
    got = chosen.mapInArrow(count, "doc_id long, votes string, bucket array<int>, times array<int>").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "votes").limit(sample).toArrow()
    pairs = [(np.asarray(b.values), np.asarray(t.values)) for b, t in zip(got["bucket"], got["times"], strict=True)]
    target = labels.posterior(1 - unpack(got["votes"].to_pylist())) if len(got) else np.zeros(0)
    return Model(labels, fit_scorer(pairs, target))


SCHEMA = "doc_id long, votes string, posterior double, score double, keep boolean"


def scores(model: Model, raw: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Votes, posterior and score of each text."""
    votes: list[str] = []
    posterior, score = [np.zeros(0)], [np.zeros(0)]
    for lo, hi in blocks([len(r) + 1 for r in raw], CHUNK):
        s = Stats(raw[lo:hi])
        v = s.votes()
        total, size = np.zeros(hi - lo), np.zeros(hi - lo)
        for doc, bucket in s.features():
            total += np.bincount(doc, model.scorer.weights[bucket], hi - lo)
            size += np.bincount(doc, minlength=hi - lo)
        z = total / np.maximum(1, size) + model.scorer.bias
        votes += coded(v)
        posterior.append(np.where(s.empty, 0.0, model.labels.posterior(v)))
        score.append(np.where(s.empty, 0.0, 1 / (1 + np.exp(-np.clip(z, -50, 50)))))
    return votes, np.concatenate(posterior), np.concatenate(score)


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, the votes, the posterior and score of being good, and whether it is kept."""

    def run(batches):
        for b in parts(batches, 1, CHUNK):
            votes, po, sc = scores(model, [utf8(t) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.string()), pa.array(po), pa.array(sc), pa.array((po + sc) / 2 > 0.5)], names=["doc_id", "votes", "posterior", "score", "keep"])

    return columns_of(docs).mapInArrow(run, SCHEMA)


def filtered(docs: DataFrame, model: Model) -> DataFrame:
    """The rows that are kept, all columns as they are."""

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        sizes = [len(t) if t else 0 for t in text]
        each = [scores(model, [utf8(t) for t in text[lo:hi]])[1:] for lo, hi in blocks(sizes, CHUNK)]
        return pd.Series([bool((p + s) / 2 > 0.5) for po, sc in each for p, s in zip(po, sc, strict=True)], dtype=bool)

    return small_batches(docs).filter(good(F.col("text").cast("string")))
