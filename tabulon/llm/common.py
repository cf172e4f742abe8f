"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multiplier of the rolling polynomial hash modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a temporary folder of this machine if it runs all tasks, else an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not where and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; it must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="checkpoint-"))
    return where or sc._jsc.sc().getCheckpointDir().get()


def fewer(df: DataFrame, partitions: int, share: int) -> DataFrame:
    """Small rows in fewer files: a `share`-th of the partitions, but one for each core at least."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, partitions // share))


def shuffled(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a batch that goes to Python, where rows are whole texts; Spark's own default is 10,000.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """Let texts go to Python in smaller batches, unless the session has a setting of its own."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    return df


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """A table that is used more than once, written to the shared folder and read again: narrower than a checkpoint."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/tables/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(max(n, 1), np.uint64)
    out[0], have = 1, 1
    while have < n:
        take = min(have, n - have)
        out[have : have + take] = out[:take] * np.uint64(pow(base, have, 1 << 64))
        have += take
    return out[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Prefix polynomial hashes of a byte buffer; hashes of any of its slices by two lookups."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = powers(BASE_INVERSE, n + 1)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=self.prefix[1:])

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k bytes that start at each position."""
        n = len(self.prefix) - k
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n]) if n > 0 else np.empty(0, np.uint64)


def blocks(sizes: list[int], most: int):
    """Consecutive index ranges of about `most` bytes; one item at least in each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def parts(batches, column: int, most: int):
    """Slices of Arrow batches whose texts in a column have about `most` bytes together; a row at least."""
    for b in batches:
        text = b.column(column)
        wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
        offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + len(b) + 1] if len(b) else np.zeros(1, np.int64)
        for lo, hi in blocks(np.diff(offsets).tolist(), most):
            yield b.slice(lo, hi - lo)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer and the offsets of each text in it."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), np.uint8), offsets


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
