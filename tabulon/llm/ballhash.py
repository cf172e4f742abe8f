"""Near duplicates by SimHash and meet-in-the-middle ball hashing.

Fingerprints link at `radius` or fewer differing bits. Every distinct fingerprint emits all
variants within half the radius; two fingerprints link exactly if they share a variant. As one
fingerprint has 2,081 of them at radius 4, variants are shuffled by their leading bits: a
fingerprint goes once to each value of those bits that one of its variants has, together with the
number of flips that are left, and there the variants with this value are generated, sorted and
deduplicated. So a shuffled row stands for up to 2,081 variants, and each variant meets all its
owners in one place. The number of leading bits follows from the number of fingerprints, and a
group of too many variants is dealt out again by further bits until it is small enough (a group by
all 64 bits has 2,081 owners at most), so groups are bounded whatever the skew.

Owners that share a variant are verified, and a group returns a spanning forest of its links, never
all pairs. Components come from alternating stars over checkpointed edges.

Defined cases: A-Z are lower-cased; fewer than `width` words are one shingle, none (null, empty or
blank text) gives fingerprint zero, which links like any other; texts of any length are hashed in
bounded chunks; repeated rows and copies share a fingerprint; unlike rows under one doc_id are one
node of the links; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import ascii_lower, cut, fewer, parts, saved, shuffled, small_batches, utf8
from tabulon.llm.components import components

SEED = 42
#: Variants that a group may have before it is dealt out again, and those it should have.
MOST_VARIANTS, USUAL_VARIANTS = 1 << 23, 1 << 20
CHUNK = 1 << 16
NAMELESS = 1 << 62


def fingerprint(text: str | None, width: int = 4) -> int:
    """The bits that more than half of the shingles' hashes have set; zero without a word."""
    words = utf8(text).lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, count, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - width + 1
    for lo in range(0, total, CHUNK):
        part = words[lo : lo + CHUNK + width - 1]
        data, n = b" ".join(part), len(part) - width + 1
        sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[:n].tolist()
        hashes = np.fromiter((digest(data[a:b], SEED) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
        count += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.flatnonzero(2 * count > total).astype(np.uint64)[:, None] == np.arange(64, dtype=np.uint64)).any(axis=0) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches):
        for b in parts(batches, 1, 1 << 22):
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


@lru_cache(maxsize=None)
def masks(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, flips) of all words of that many bits with `most` or fewer set."""
    return [(sum(1 << i for i in c), n) for n in range(most + 1) for c in combinations(range(bits), n)]


def ball(bits: int, most: int) -> int:
    return len(masks(bits, most)) if bits else 1


def leading_bits(n: int, half: int) -> int:
    return min(32, max(4, (n * ball(64, half) // USUAL_VARIANTS).bit_length()))


ROUTED = "depth int, key long, fp long, used int, node long"


def route(rows: DataFrame, bits: int, half: int) -> DataFrame:
    """Each row goes to the values of its next bits that its variants have."""

    def run(batches):
        table = masks(bits, half)
        for b in batches:
            depth, key, fp, used, node = (np.asarray(b.column(i)) for i in range(5))
            if not len(b):
                continue
            begin = int(depth[0])
            if (depth != begin).any():
                raise ValueError("rows of several depths")
            n = min(bits, 64 - begin)
            own = (fp.view(np.uint64) >> np.uint64(64 - begin - n)) & np.uint64((1 << n) - 1)
            for mask, flips in table:
                if mask >> n:
                    continue
                go = used + flips <= half
                if go.any():
                    keys = (key[go].view(np.uint64) << np.uint64(n)) | (own[go] ^ np.uint64(mask))
                    count = int(go.sum())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(count, begin + n, np.int32)), pa.array(keys.view(np.int64)), pa.array(fp[go]), pa.array((used[go] + flips).astype(np.int32)), pa.array(node[go])], names=["depth", "key", "fp", "used", "node"])

    return rows.mapInArrow(run, ROUTED)


def forest(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node that each node reaches by the links a[i] - b[i]."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def linker(radius: int, half: int):
    def link(group: pa.Table) -> pa.Table:
        begin = group["depth"][0].as_py()
        fp, used = np.asarray(group["fp"]).view(np.uint64), np.asarray(group["used"])
        node = np.asarray(group["node"])
        order = np.argsort(node, kind="stable")
        fp, used, node = fp[order], used[order], node[order]
        rest = 64 - begin
        low = fp & np.uint64((1 << rest) - 1)
        variants, owners = [], []
        for u in range(half + 1):
            at = np.flatnonzero(used == u)
            flips = np.array([m for m, _ in masks(rest, half - u)], np.uint64)
            variants.append((low[at, None] ^ flips).ravel())
            owners.append(np.repeat(at, len(flips)))
        v, o = np.concatenate(variants), np.concatenate(owners)
        by = np.argsort(v, kind="stable")
        v, o = v[by], o[by]
        same = np.flatnonzero(v[1:] == v[:-1])
        a, b = o[same], o[same + 1]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius  # sharing a variant implies it
        root = forest(len(fp), a[near], b[near])
        far = np.flatnonzero(root != np.arange(len(fp)))
        return pa.table([pa.array(node[far]), pa.array(node[root[far]])], names=["u", "v"])

    return link


def links(fps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """Edges (u, v) between nodes that connect just those whose fingerprints chains of links connect.

    fps: (fp, node), each once; an edge goes to the smaller node."""
    half = radius // 2
    cost = {(d, u): ball(64 - d, half - u) for d in range(65) for u in range(half + 1)}
    start = fps.select(F.lit(0).alias("depth"), F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("used"), "node")
    depth, out = leading_bits(n, half), []
    rows = route(start, depth, half)
    while True:
        weight = F.element_at(F.array(*[F.lit(cost[depth, u]) for u in range(half + 1)]), F.col("used") + 1)
        heavy = rows.groupBy("key").agg(F.sum(weight).alias("variants")).filter(F.col("variants") > MOST_VARIANTS).select("key") if depth < 64 else None
        heavy = heavy and cut(fewer(heavy, shuffled(fps.sparkSession), 32))
        rest = None if heavy is None or heavy.isEmpty() else heavy
        light = rows if rest is None else rows.join(rest, "key", "left_anti").select(*rows.columns)
        out.append(light.groupBy("depth", "key").applyInArrow(linker(radius, half), "u long, v long"))
        if rest is None:
            break
        more = min(8, 64 - depth)
        rows = route(rows.join(rest, "key", "left_semi").select(*rows.columns), more, half)
        depth += more
    edges = out[0]
    for e in out[1:]:
        edges = edges.unionByName(e)
    return edges


def classes(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the least doc_id reachable."""
    marked = saved(fingerprints(docs, width))  # hashed in as many tasks as the texts have; small files are read together
    # A fingerprint's node is its least doc_id, so a component's least node is its id; without any doc_id, a number past all.
    node = F.coalesce(F.min("doc_id"), F.lit(NAMELESS) + F.pmod(F.xxhash64("fp"), F.lit(1 << 40))).alias("node")
    distinct = cut(fewer(marked.groupBy("fp").agg(node), shuffled(docs.sparkSession), 32))
    roots = components(links(distinct, distinct.count(), radius)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    least = F.coalesce("root", "node")
    owned = distinct.join(roots, "node", "left").select("fp", F.when(least < NAMELESS, least).alias("component_id"))
    return marked.join(owned, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each component, that of the least doc_id; rows without a doc_id stay.

    Rows of one doc_id whose words differ are documents of their own: if their id is the least, each stays."""
    columns = docs.columns
    owned = classes(docs.filter(F.col("doc_id").isNotNull()), width, radius)
    least = owned.filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    words = F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), "[\\x20\\x09-\\x0D]+", " "))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(words).alias("h1"), F.hash(words).alias("h2"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    kept = rows.filter("id is not null").join(least, "id", "left_semi").dropDuplicates(["id", "h1", "h2"])
    return kept.unionByName(rows.filter("id is null")).select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
