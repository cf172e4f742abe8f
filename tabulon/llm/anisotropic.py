"""Maximum inner product search by score-aware (anisotropic) quantisation.

A vector is cut into pairs of components; each pair is coded by one of 16 centroids, so four bits.
Codes and centroids minimise a loss that weighs the residual parallel to the vector `eta` times as
much as the rest, as that part moves large inner products. Coded is a vector's direction; its length
stays as it is. A query's table of 16 inner products a pair scans the codes (two pairs a byte), the
sums are multiplied by the lengths, and the best `rerank` of each block are scored exactly in double
precision, on the vectors as they are stored.

Equal vectors are one class with its k + 1 smallest ids (no query needs more of them), found by a
ranking that is limited before the shuffle. Classes are dealt to blocks of about BLOCK by hash,
queries to blocks of about QUERIES; each pair of blocks is one bounded group. The centroids are
fitted on SAMPLE rows, those of the smallest hash; every row is coded.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part; a repeated row counts once, and of rows of one id the nearest counts as a
candidate and the least as a query; ties go to the smaller vec_id; with k or fewer candidates all
are returned; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CENTROIDS = 16
BLOCK = 8192
QUERIES = 4096
SAMPLE = 16_384
THRESHOLD = 0.2


def eta(dim: int, threshold: float = THRESHOLD) -> float:
    """Weight of the parallel residual for inner products above `threshold`."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Codec:
    def __init__(self, centroids: np.ndarray, weight: float, dim: int):
        self.centroids, self.weight, self.dim = centroids, weight, dim

    def pairs(self, x: np.ndarray) -> np.ndarray:
        """Rows as (n, pairs, 2); an even number of pairs, filled up by zeros."""
        width = 2 * len(self.centroids)
        out = np.zeros((len(x), width), np.float32)
        out[:, : x.shape[1]] = x
        return out.reshape(len(x), -1, 2)

    def encode(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Coordinate descent from the nearest centroids; n rows of codes."""
        parts = self.pairs(x)
        unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
        n, m = parts.shape[:2]
        codes = np.empty((n, m), np.uint8)
        along = np.empty((n, m), np.float32)
        rows = np.arange(n)
        for j in range(m):
            codes[:, j] = self.gaps(parts, j)[1].argmin(axis=1)
            along[:, j] = ((parts[:, j] - self.centroids[j, codes[:, j]]) * unit[:, j]).sum(axis=1)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for j in range(m):
                gap, square = self.gaps(parts, j)
                part = gap[:, :, 0] * unit[:, j, 0, None] + gap[:, :, 1] * unit[:, j, 1, None]
                rest = total - along[:, j]
                codes[:, j] = (square + (self.weight - 1) * (rest[:, None] + part) ** 2).argmin(axis=1)
                along[:, j] = part[rows, codes[:, j]]
                total = rest + along[:, j]
        return codes

    def gaps(self, parts: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray]:
        gap = parts[:, j, None, :] - self.centroids[None, j]
        return gap, (gap**2).sum(axis=2)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centroids[np.arange(codes.shape[1])[None], codes].reshape(len(codes), -1)[:, : self.dim]

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Of one query: for each byte of a code, the inner product that its two pairs add."""
        t = np.einsum("jcd,jd->jc", self.centroids, self.pairs(q[None].astype(np.float32))[0])
        return (t[0::2, None, :] + t[1::2, :, None]).reshape(len(t) // 2, 256)


def fit(x: np.ndarray, rounds: int = 6, threshold: float = THRESHOLD) -> Codec:
    """Alternate between anisotropic codes and the centroids that are best for them."""
    dim = x.shape[1]
    pairs = 2 * -(-dim // 4)
    codec = Codec(np.zeros((pairs, CENTROIDS, 2), np.float32), eta(dim, threshold), dim)
    parts = codec.pairs(x)
    unit = parts / np.maximum(np.linalg.norm(x, axis=1), 1e-30)[:, None, None].astype(np.float32)
    rng = np.random.default_rng(0)
    codec.centroids = parts[rng.integers(0, len(x), (pairs, CENTROIDS)), np.arange(pairs)[:, None]].astype(np.float32)
    for r in range(rounds):
        codes = codec.encode(x, sweeps=1 if r else 0)
        left = parts - codec.centroids[np.arange(pairs)[None], codes]
        total = (left * unit).sum(axis=(1, 2))
        for j in range(pairs):
            u, p, c = unit[:, j].astype(np.float64), parts[:, j].astype(np.float64), codes[:, j]
            own = (left[:, j] * unit[:, j]).sum(axis=1)
            rest = total - own + (p * u).sum(axis=1)  # the parallel residual were the centroid zero
            w = codec.weight - 1
            add = lambda v: np.bincount(c, v, CENTROIDS)  # noqa: B023, E731
            a, b, d = add(1 + w * u[:, 0] ** 2), add(w * u[:, 0] * u[:, 1]), add(1 + w * u[:, 1] ** 2)
            e, f = add(p[:, 0] + w * rest * u[:, 0]), add(p[:, 1] + w * rest * u[:, 1])
            det = a * d - b * b
            used = det > 1e-12
            codec.centroids[j, used, 0] = ((d * e - b * f) / np.where(used, det, 1))[used]
            codec.centroids[j, used, 1] = ((a * f - b * e) / np.where(used, det, 1))[used]
            left[:, j] = parts[:, j] - codec.centroids[j, c]
            total = total - own + (left[:, j] * unit[:, j]).sum(axis=1)
    return codec


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, the first in the low half; a row for each byte of a code."""
    return np.ascontiguousarray((codes[:, 0::2] | codes[:, 1::2] << 4).T)


def scan(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = tables[0].take(codes[0])
    for t, c in zip(tables[1:], codes[1:], strict=True):
        out += t.take(c)
    return out


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; equal rows give equal values wherever they stand."""
    return (x.astype(np.float64) * q.astype(np.float64)).sum(axis=1)


def matrix(column, dim: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(c.flatten()).reshape(-1, dim)


def directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in single precision and the lengths in double; no component overflows on the way."""
    x = x.astype(np.float64)
    most = np.abs(x).max(axis=1)
    scaled = x / most[:, None]
    length = np.sqrt((scaled**2).sum(axis=1))
    with np.errstate(over="ignore"):
        return (scaled / length[:, None]).astype(np.float32), most * length


def valid(rows: DataFrame) -> DataFrame:
    """Rows that take part, their vectors as they are stored: of floats if they are floats, else of doubles."""
    e = F.col("embedding")
    sound = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0)
    kind = "array<float>" if rows.schema["embedding"].dataType.elementType.typeName() == "float" else "array<double>"
    return rows.select(F.col("vec_id").cast("long"), e.cast(kind)).filter(sound & F.col("vec_id").isNotNull())


RESULT = "query_id long, vec_id long, score double"


def search(rows: DataFrame, every: int = 20, k: int = 20, rerank: int = 96) -> DataFrame:
    """The k nearest rows of each query, a row whose vec_id is divisible by `every`."""
    good = valid(rows)
    sizes = good.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = sizes[0]["dim"], sizes[0]["count"]
    good = good.filter(F.size("embedding") == dim)
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    codec = fit(directions(matrix(sample.column(0), dim))[0])
    kind = good.schema["embedding"].dataType.simpleString()
    n_blocks, n_groups = -(-n // BLOCK), -(-n // (every * QUERIES))
    order = Window.partitionBy("embedding").orderBy("vec_id")
    classes = good.withColumn("place", F.dense_rank().over(order)).filter(F.col("place") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))

    def index(batches):
        for b in batches:
            codes = codec.encode(directions(matrix(b.column(1), dim))[0]) if len(b) else np.empty((0, 2), np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary())], names=["ids", "embedding", "codes"])

    coded = classes.select("ids", "embedding").mapInArrow(index, f"ids array<bigint>, embedding {kind}, codes binary")
    coded = coded.withColumn("block", F.pmod(F.xxhash64("embedding"), F.lit(n_blocks)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    queries = good.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = queries.withColumn("group", F.pmod(F.xxhash64("vec_id"), F.lit(n_groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(left) and len(right):
            x, q = matrix(left["embedding"], dim), matrix(right["embedding"], dim)
            ids = left["ids"].combine_chunks()
            starts, flat = np.asarray(ids.offsets), np.asarray(ids.values)
            length, aim = directions(x)[1], directions(q)[0]
            codes = packed(np.frombuffer(b"".join(left["codes"].to_pylist()), np.uint8).reshape(len(x), -1))
            for vec, unit, own in zip(q, aim, right["vec_id"].to_pylist(), strict=True):
                best = np.arange(len(x))
                if len(x) > rerank:
                    best = np.argpartition(scan(codec.tables(unit), codes) * length, -rerank)[-rerank:]
                score = exact(x[best], vec)
                reps = starts[best + 1] - starts[best]
                at = np.repeat(starts[best] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
                members, scores = flat[at], np.repeat(score, reps)
                keep = members != own
                members, scores = members[keep], scores[keep]
                first = np.lexsort((members, -scores))[: k + 1]
                out.append((np.full(len(first), own), members[first], scores[first]))
        parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int64()), pa.array(parts[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = coded.groupBy("block", "group").cogroup(queries.groupBy("block", "group")).applyInArrow(nearest, RESULT)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
