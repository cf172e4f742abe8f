"""Whitening of embeddings by cyclic Jacobi rotations.

An entry c becomes the whole number x = floor(SCALE * c) + SHIFT. Three passes over the vectors: how
many there are and their sums by dimension, in whole numbers; the scatter of what is left when the
mean is taken away; the spread of the whitened vectors, which says how far they are from the identity.
Entries are large beside their spread, so the mean is taken away before anything is multiplied: first
a whole number near it, exactly, then its fraction. Each task sums what it has to one matrix, a few
tasks merge those, and the driver gets one matrix, whose size is that of a vector squared.

The driver turns it by Jacobi rotations: a sweep goes through all pairs of dimensions in rounds of
disjoint ones, and sweeps go on until each entry beside the diagonal vanishes against the two diagonal
ones that it stands between. That, and not a bound against the largest one, makes small eigenvalues as
exact as large ones. Eigenvectors in falling order, over the roots of their eigenvalues, are the
whitening matrix; tasks get it with their code. A vector's sign is such that its largest entry in
size, the first of equals, is positive.

Defined cases: vectors that are null, empty, hold a null or non-finite entry or one beyond 2**50 in
size are left out, as are those of another length than most (of equal counts, the longer one); repeated
rows and ids, and null ids, are rows of their own; a component without spread (an eigenvalue within
rounding of zero) has a null `whitened`, counts in no `identity_error` and has its `explained`; vectors
of fewer entries than components asked for have fewer; a deviation beyond a long is null; an empty
table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import shuffled

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LIMIT = float(1 << 50)
SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # a row each
    trace: float
    identity_error: float = 0.0

    @property
    def size(self) -> int:
        return len(self.sums)

    @property
    def sound(self) -> np.ndarray:
        """Components with spread."""
        return self.values > max(self.values[0], 0.0) * self.size * np.finfo(float).eps if self.size else np.zeros(0, bool)

    def centre(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The whole number next to each mean, the rest times n, and the rest."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        rest = [s - self.n * w for s, w in zip(self.sums, whole, strict=True)]
        return np.array(whole, np.int64), np.array(rest, np.int64), np.array([r / self.n for r in rest])

    def matrix(self, components: int) -> np.ndarray:
        """The whitening matrix of sound components; rows of others are zero."""
        k = min(components, self.size)
        root = np.where(self.sound[:k], np.sqrt(np.maximum(self.values[:k], np.finfo(float).tiny)), np.inf)
        return self.vectors[:k] / root[:, None]


def jacobi(a: np.ndarray, most_sweeps: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, and eigenvectors as rows, of a symmetric matrix."""
    a, size = np.array(a, float), len(a)
    turn, eps = np.eye(size), np.finfo(float).eps
    seats = np.arange(size + size % 2)
    for _ in range(most_sweeps if size > 1 else 0):
        still = True
        for _ in range(len(seats) - 1):  # a round: each dimension meets another one
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            p, q = np.minimum(p, q), np.maximum(p, q)
            p, q = p[q < size], q[q < size]
            off, floor = a[p, q], eps * np.abs(a.diagonal()).max()
            live = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(a[p, p] * a[q, q])), floor * eps)
            p, q, off = p[live], q[live], off[live]
            if len(p):
                still = False
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(half, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                dp, dq = a[p, p] - t * off, a[q, q] + t * off
                for m in (a, turn):
                    x, y = m[p].copy(), m[q].copy()
                    m[p], m[q] = c[:, None] * x - s[:, None] * y, s[:, None] * x + c[:, None] * y
                x, y = a[:, p].copy(), a[:, q].copy()
                a[:, p], a[:, q] = c * x - s * y, s * x + c * y
                a[p, p], a[q, q], a[p, q], a[q, p] = dp, dq, 0.0, 0.0
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if still:
            break
    order = np.argsort(-a.diagonal(), kind="stable")
    values, vectors = a.diagonal()[order].copy(), turn[order]
    largest = np.abs(vectors).argmax(axis=1) if size else np.empty(0, int)
    return values, vectors * np.where(vectors[np.arange(size), largest] < 0, -1.0, 1.0)[:, None]


def sound(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, v): the vectors that take part, but for their length, as doubles."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v"))
    # NaN is larger than any number
    bad = F.exists("v", lambda c: c.isNull() | (F.abs(c) > LIMIT))
    return rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))


def whole(column: pa.ListArray, size: int) -> np.ndarray:
    """Vectors of a batch as whole numbers."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size) * SCALE).astype(np.int64) + SHIFT


def merged(df: DataFrame, width: int) -> list[tuple[int, np.ndarray]]:
    """Sums of arrays of doubles by number: (i, part) rows, one of each number a task, merged by a few tasks and then by number."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            parts = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for i, part in zip(b.column(0).to_pylist(), parts, strict=True):
                total[i] = total[i] + part if i in total else part.copy()
        if total:
            yield rows_of(np.array(list(total)), np.stack(list(total.values())))

    few = df.repartition(max(1, int(shuffled(df.sparkSession) ** 0.5))).mapInArrow(run, df.schema)
    each = few.select("i", F.posexplode("part").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value"))
    out: dict[int, np.ndarray] = {}
    for i, j, value in each.collect():
        out.setdefault(i, np.zeros(width))[j] = value
    return sorted(out.items(), key=lambda x: x[0])


def rows_of(numbers: np.ndarray, parts: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(parts.reshape(-1))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(parts) + 1, dtype=np.int32) * parts.shape[1]), flat)
    return pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), lists], names=["i", "part"])


def scatter(rows: DataFrame, size: int, of, width: int) -> np.ndarray:
    """Sum of outer products of what `of` makes of a batch's whole numbers."""

    def run(batches):
        total = np.zeros((width, width))
        for b in batches:
            y = of(whole(b.column(1), size))
            total += y.T @ y
        yield rows_of(np.arange(width), total)

    found = merged(rows.mapInArrow(run, "i int, part array<double>"), width)
    return np.stack([part for _, part in found]) if found else np.zeros((width, width))


def fit(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> Whitening:
    """The whitening of all vectors that take part."""
    good = sound(vectors, key, column)
    most = good.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if most is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    size, n = most["size"], most["count"]
    rows = good.filter(F.size("v") == size)

    def halves(batches):
        high, low = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            x = whole(b.column(1), size)
            high += (x >> 20).sum(axis=0)
            low += (x & 0xFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(high), pa.array(low)], names=["i", "high", "low"])

    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = {i: (int(h) << 20) + int(low) for i, h, low in rows.mapInArrow(halves, "i int, high long, low long").groupBy("i").agg(exact("high"), exact("low")).collect()}
    found = Whitening(n, [sums[i] for i in range(size)], np.zeros(size), np.eye(size), 0.0)
    near, _, rest = found.centre()
    spread = scatter(rows, size, lambda x: (x - near) - rest, size) / n
    found.values, found.vectors = jacobi((spread + spread.T) / 2)
    found.trace = float(np.trace(spread))
    matrix = found.matrix(components)
    live = np.flatnonzero(found.sound[: len(matrix)])
    if len(live):
        matrix = matrix[live]
        found.identity_error = float(np.abs(scatter(rows, size, lambda x: ((x - near) - rest) @ matrix.T, len(live)) / n - np.eye(len(live))).max())
    return found


def deviations(z: np.ndarray, n: int, rest: np.ndarray) -> list[int | None]:
    """Sum over dimensions of (n * z - rest)**2, exactly; null beyond a long."""
    most = (1 << 63) - 1
    if n * (int(np.abs(z).max(initial=0)) + 1) < 1 << 62:
        v = n * z - rest
        about = (v.astype(float) ** 2).sum(axis=1)
        # Sums of whole numbers modulo 2**64 are right where the sum itself fits.
        out = (v * v).sum(axis=1).tolist()
        unsure = np.flatnonzero(about > 0.99 * most)
    else:
        out, unsure = [None] * len(z), np.arange(len(z))
    for i in unsure.tolist():
        true = sum((n * a - r) ** 2 for a, r in zip(z[i].tolist(), rest.tolist(), strict=True))
        out[i] = true if true <= most else None
    return out


def apply(vectors: DataFrame, found: Whitening, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A row for each vector that takes part and each component."""
    size = found.size
    rows = sound(vectors, key, column).filter(F.size("v") == size)
    matrix = found.matrix(components)
    k, live = len(matrix), found.sound[: len(matrix)]
    near, times, rest = found.centre() if found.n else (np.zeros(0, np.int64),) * 3
    share = found.values[:k] / found.trace if found.trace > 0 else np.zeros(k)

    def run(batches):
        for b in batches:
            if not len(b) or not size:
                continue
            z = whole(b.column(1), size) - near
            w = (z - rest) @ matrix.T
            rows, ids = len(z), b.column(0)
            each = np.repeat(np.arange(rows), k)
            full = lambda x, kind: pa.array(np.full(rows * k, x), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), full(found.n, pa.int64()),
                    pa.array(deviations(z, found.n, times), pa.int64()).take(pa.array(each)), pa.array(w.reshape(-1), mask=np.tile(~live, rows)),
                    pa.array(np.tile(share, rows)), full(found.identity_error, pa.float64()),
                ],
                names=["vec_id", *[f.split()[0] for f in SCHEMA.split(", ")]],
            )

    return rows.mapInArrow(run, f"vec_id long, {SCHEMA}")


def whitened(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Fit on all vectors, and apply to all."""
    return apply(vectors, fit(vectors, components, key, column), components, key, column)
