"""Removal of passages that repeat anywhere in the corpus, by a run-length index.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere, in any document.

1. Every window of LENGTH bytes belongs to one anchor that its content picks (anchors.py), so equal
   windows belong to anchors of equal hash, at equal distances. A run of windows of one anchor is a
   span. Equal spans are one text of the index with its count, summed before and after the shuffle;
   a span that occurs twice is repeated as a whole.
2. Spans of one anchor hash of which some occur once are indexed together: their texts, aligned at
   the anchor, form a Burrows-Wheeler transform that is built from the last column to the first.
   It is kept by runs: in a column where the texts of a group are one run the order stands, and only
   at run ends are texts reordered and their common lengths taken anew, as minima between sampled
   run ends. The matching statistics stream out with the columns: a text's longest common length
   with a neighbour is its longest match with any text, and LENGTH or more marks a window.
   (Alignment is exact, not a heuristic: a repeated window has its anchor at the same place.)
3. A group of more than HOT different spans isn't held by one task: its windows are counted by hash
   over the cluster, which gives the same marks.
4. Marks come back to the documents by the texts' hashes, once for all copies of a text.

Defined cases: a null or empty text has no bytes and loses none; texts under LENGTH bytes lose none;
a passage that overlaps itself counts; texts are read whole, in blocks that hold one text at least; repeated rows
are copies; equal or null doc_ids don't mix rows; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.anchors import GRAM, anchors
from tabulon.llm.common import Rolling, joined, parts, saved, small_batches, utf8

LENGTH = 400
#: Different spans of one anchor hash that a task holds; rows that it indexes at a time.
HOT, ROWS = 16_384, 4_000
CHUNK = 1 << 20


def keyed(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows with two hashes of their text, which stand for the text in joins."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return small_batches(docs).select(*keep, text.alias("text")).select("*", F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"))


SPANS = "doc_id long, k1 long, k2 int, lo int, hi int, h long, g long"


def spans(rows: DataFrame, length: int) -> DataFrame:
    """A row for each run of windows of one anchor: its first and last window, the anchor's hash and the text's."""

    def run(batches):
        for b in parts(batches, 3, CHUNK):
            data, offsets = joined([utf8(t) for t in b.column(3).to_pylist()])
            text, first, last, h = anchors(data, offsets, length)
            if not len(text):
                continue
            whole, digest = data.tobytes(), xxhash.xxh3_64_intdigest
            begin = offsets[text] + first
            g = np.fromiter((digest(whole[s:e]) for s, e in zip(begin.tolist(), (begin + last - first + length).tolist(), strict=True)), np.uint64, len(text))
            at = pa.array(text)
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(3)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(h.view(np.int64)), pa.array(g.view(np.int64))], names=[x.split()[0] for x in SPANS.split(", ")])

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(run, SPANS)


# --- the index ---------------------------------------------------------------------------------
def matching(symbols: np.ndarray, group: np.ndarray, length: int):
    """(column, rows) of each column, last first: rows with a match of `length` bytes or more from there.

    `symbols` has a row a text, aligned in columns, 256 where the text has no byte; `group` ascends.
    """
    n, width = symbols.shape
    order = np.arange(n)
    common = np.zeros(n + 1, np.int64)  # with the text before, in the order of the column
    for column in range(width - 1, -1, -1):
        symbol = symbols[order, column]
        key = group[order] * 512 + symbol
        if (key[1:] >= key[:-1]).all():
            common[1:n] += 1  # one run in each group, or runs in order: neighbours stay neighbours
        else:
            move = np.argsort(key, kind="stable")
            before, after = move[:-1], move[1:]
            apart = np.flatnonzero((after != before + 1) & (key[before] == key[after]))
            fresh = common[after] + 1
            if len(apart):
                cuts = np.stack([before[apart] + 1, after[apart] + 1], axis=1).ravel()
                fresh[apart] = np.minimum.reduceat(common, cuts)[::2] + 1
            common[1:n] = fresh
            order, key, symbol = order[move], key[move], symbol[move]
        common[1:n][(key[1:] != key[:-1]) | (symbol[1:] == 256)] = 0
        best = np.maximum(common[:n], common[1:])
        found = np.flatnonzero(best >= length)
        if len(found):
            yield column, order[found]


def indexed(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Marks of the texts of whole groups: runs of repeated windows."""
    h = np.asarray(rows["h"]).view(np.uint64)
    texts = rows["bytes"].to_pylist()
    data, offsets = joined(texts)
    grams = Rolling(data).grams(GRAM)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(grams)]
    hits = np.flatnonzero(grams == h[owner])
    anchor = hits[np.searchsorted(hits, offsets[:-1])] - offsets[:-1]
    sizes = np.diff(offsets)
    before = int(anchor.max())
    symbols = np.full((len(texts), before + int((sizes - anchor).max())), 256, np.uint16)
    shift = before - anchor
    symbols[np.repeat(np.arange(len(texts)), sizes), np.arange(len(data)) - np.repeat(offsets[:-1], sizes) + np.repeat(shift, sizes)] = data
    _, group = np.unique(h, return_inverse=True)
    by = np.argsort(group, kind="stable")
    single = np.asarray(rows["times"]) == 1
    out = [np.empty((3, 0), np.int64)]
    first, last = np.full(len(texts), -2), np.full(len(texts), -2)  # the run of marked columns that grows
    for column, found in matching(symbols[by], group[by].astype(np.int64), length):
        found = by[found]
        found = found[single[found]]
        ended = found[(first[found] != column + 1) & (first[found] >= 0)]
        out.append(np.stack([ended, first[ended], last[ended]]))
        fresh = found[first[found] != column + 1]
        last[fresh] = column
        first[found] = column
    open_runs = np.flatnonzero(first >= 0)
    row, lo, hi = np.concatenate([*out, np.stack([open_runs, first[open_runs], last[open_runs]])], axis=1)
    base = np.asarray(rows["lo"])[row] - shift[row]
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(rows["k1"])[row], pa.int64()), pa.array(np.asarray(rows["k2"])[row], pa.int32()), pa.array((lo + base).astype(np.int32)), pa.array((hi + base).astype(np.int32))], names=["k1", "k2", "lo", "hi"])


MARKS = "k1 long, k2 int, lo int, hi int"
TEXTS = "h long, k1 long, k2 int, lo int, times long, hot boolean, bytes binary"


def grouped(batches):
    """Tables of whole groups of h, from batches sorted by it; about ROWS rows, more only for one group."""
    held: list[pa.Table] = []
    for b in chain(batches, [None]):
        if b is not None:
            held.append(pa.Table.from_batches([b]))
            if sum(map(len, held)) < ROWS:
                continue
        if not held:
            return
        rows = pa.concat_tables(held).combine_chunks()
        h = np.asarray(rows["h"])
        ends = (np.flatnonzero(h[1:] != h[:-1]) + 1).tolist() + [len(h)] * (b is None and len(h) > 0)
        done = 0
        for end in ends:
            if end - done >= ROWS or end == ends[-1]:
                yield rows.slice(done, end - done)
                done = end
        held = [rows.slice(done)]


def unique(rows: pa.Table) -> pa.Table:
    """One of each span: copies of a document under one id bring it more than once."""
    columns = [np.asarray(rows[c]) for c in ("h", "k1", "k2", "lo")]
    by = np.lexsort(columns[::-1])
    new = np.zeros(len(by), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[by][1:] != c[by][:-1]
    return rows.take(pa.array(by[new]))


def marks(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """(k1, k2, lo, hi): windows lo to hi of the texts with these hashes are repeated."""
    found = saved(spans(docs, length)).withColumn("r", F.xxhash64("doc_id", "k1", "k2", "lo"))
    sums = found.groupBy("h", "g").agg(F.count("*").alias("times"), F.min("r").alias("r"))
    near = sums.groupBy("h").agg(F.count("*").alias("kinds"), F.sum((F.col("times") == 1).cast("int")).alias("single"), F.sum("times").alias("all")).filter("all > 1")
    judged = sums.join(near, "h").filter("times > 1 or kinds > 1").select("h", "g", "times", F.col("r").alias("chosen"), ((F.col("kinds") > 1) & (F.col("single") > 0)).alias("look"), (F.col("kinds") > hot).alias("hot"))
    kept = found.join(judged, ["h", "g"]).select("doc_id", "k1", "k2", "lo", "hi", "h", "times", "hot", (F.col("look") & (F.col("r") == F.col("chosen"))).alias("look"))
    kept = saved(kept.filter("times > 1 or look"))
    whole = kept.filter("times > 1").select("k1", "k2", "lo", "hi")
    item = F.struct("lo", "hi", "h", "times", "hot")
    wanted = kept.filter("look").groupBy("k1", "k2", "doc_id").agg(F.collect_list(item).alias("items"))
    withtext = docs.alias("d").join(wanted.alias("w"), (F.col("d.k1") == F.col("w.k1")) & (F.col("d.k2") == F.col("w.k2")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("d.k1", "d.k2", "d.text", "w.items")

    def cut(batches):
        for b in parts(batches, 2, 4 * CHUNK):
            out: list[tuple] = []
            size = 0
            for a1, a2, text, items in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                raw = utf8(text)
                out += [(x["h"], a1, a2, x["lo"], x["times"], x["hot"], raw[x["lo"] : x["hi"] + length]) for x in items]
                size += len(items)
                if size > 4096:
                    yield rows_of(out)
                    out, size = [], 0
            if out:
                yield rows_of(out)

    texts = withtext.mapInArrow(cut, TEXTS)

    def index(batches):
        for rows in grouped(batches):
            yield indexed(unique(rows), length)

    cold = texts.filter("not hot").repartition("h").sortWithinPartitions("h").mapInArrow(index, MARKS)

    if kept.filter("look and hot").isEmpty():
        return whole.unionByName(cold)

    def windows(batches):
        for b in batches:
            for i in range(len(b)):
                raw = np.frombuffer(b.column(6)[i].as_py(), np.uint8)
                w = Rolling(raw).grams(length).view(np.int64)
                n = len(w)
                row = pa.array(np.full(n, i))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in range(3)), pa.array((b.column(3)[i].as_py() + np.arange(n)).astype(np.int32)), b.column(4).take(row), pa.array(w)], names=["h", "k1", "k2", "lo", "times", "w"])

    many = texts.filter("hot").mapInArrow(windows, "h long, k1 long, k2 int, lo int, times long, w long").distinct()
    again = many.groupBy("h", "w").agg(F.count("*").alias("n")).filter("n > 1").select("h", "w")
    warm = many.join(again, ["h", "w"]).filter("times = 1").select("k1", "k2", "lo", F.col("lo").alias("hi"))
    return whole.unionByName(cold).unionByName(warm)


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*out, strict=True)), kinds, strict=True)], names=[x.split()[0] for x in TEXTS.split(", ")])


def removal(size: int, items: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal [start, end) ranges of bytes that go."""
    out: list[list[int]] = []
    for lo, hi in sorted((x["lo"], x["hi"] + length) for x in items or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, min(b, size)) for a, b in out]


def left(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in gone:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def marked(docs: DataFrame, keep: list[str], length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The columns `keep`, text, and marks (a list or null) of every row."""
    rows = keyed(docs, list(dict.fromkeys([*keep, "doc_id"])))
    lists = marks(rows, length, hot).groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "hi")).alias("marks"))
    return rows.join(lists, ["k1", "k2"], "left").select(*keep, "text", "marks")


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string, removed array<struct<start: long, end: long>>"


def digests(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Of each row: bytes, bytes and runs that go, digest of those that stay, the text of whole characters that they make, and the runs."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "removed"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    def run(batches):
        for b in parts(batches, 1, 4 * CHUNK):
            rows = []
            for doc, text, items in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = utf8(text)
                gone = removal(len(raw), items, length)
                rest = left(raw, gone) if gone else raw
                rows.append((doc, len(raw), sum(y - x for x, y in gone), len(gone), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore"), [{"start": x, "end": y} for x, y in gone]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(map(list, zip(*rows, strict=True)) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return marked(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"], length, hot).mapInArrow(run, DIGESTS)


def passages(raw: bytes, items: list[dict] | None, length: int, words: int) -> list[tuple[int, int]]:
    """The ranges that go which touch more than `words` words."""
    return [(a, b) for a, b in removal(len(raw), items, length) if not words or len(raw[a:b].split()) > words]


def trimmed(docs: DataFrame, length: int = LENGTH, hot: int = HOT, words: int = 0) -> DataFrame:
    """The documents without the bytes that go; a character that loses a byte goes too. Other columns and null texts stay.

    Of runs of repeated bytes only those of more than `words` words go, so `length` may be short."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    # A struct of its own around them, so that no input column can have the flag's name.
    packed = docs.select("doc_id", "text", F.struct(others.alias("others"), F.col("text").isNull().alias("text_is_null")).alias("row"))

    @F.pandas_udf("string")
    def rest(text: pd.Series, items: pd.Series) -> pd.Series:
        raw = [utf8(t) for t in text]
        return pd.Series([left(r, passages(r, None if m is None else list(m), length, words)).decode("utf-8", "ignore") for r, m in zip(raw, items, strict=True)], dtype=object)

    out = marked(packed, ["row"], length, hot)
    text = F.when(~F.col("row.text_is_null"), F.when(F.col("marks").isNull(), F.col("text")).otherwise(rest("text", "marks")))
    return out.select(*[(text if c == "text" else F.col(f"row.others.`{c}`")).alias(c) for c in docs.columns])
