"""Phrase collocations: phrases that occur far more often than their parts let expect.

Texts are cut into pieces at punctuation, and equal pieces of a language become one with its
multiplicity, so copies and shared lines are counted once. Phrases of 1, 2, .. words are then counted
in turn, weighted by multiplicity. A task turns the pieces it has into numbers of words and sums equal
phrases before anything is sent; phrases are dealt to hash buckets, and each bucket is summed by duckdb,
which spills to the task's scratch folder beyond a stated memory.

A phrase occurs at most as often as each phrase inside it, so a phrase of n words is only sent if both
its phrases of n - 1 words may be frequent: a bitmap of BITS bits says so, which each level's frequent
phrases set at their hashes. Its size is fixed. Where two phrases share a bit, one too many is sent and
then counted exactly, so results don't depend on it.

A candidate then asks for the counts of its parts: each request goes to where the part's count lies, by
a join on (language, part, salt). Parts of frequent phrases are frequent, so no request stays open.
Frequent words are asked for by many; counts are laid out under SALTS salts, and a phrase's requests
choose one by its hash.

Defined cases: a null text is empty, a null language is `und`; texts and pieces of any length are
counted whole; repeated rows count each; an empty table, or one without a frequent phrase, gives an
empty result; further columns are not looked at.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabulon.llm.common import ascii_lower, blocks, mix, saved, shuffled

LEAST, LONGEST, TOP = 30, 4, 2000
#: A candidate goes if a longer one around it has INNER hundredths of its count.
INNER, SCORE = 80, 2_000_000
BREAK = r"[.,;:!?\n-\r]"
#: Bits of the bitmap, as a power of two; bytes of pieces that a task sums together; memory of a bucket; salts.
BITS, CHUNK, MEMORY, SALTS = 27, 8 << 20, "192MB", 8
GRAMS = "lang string, phrase string, weight long"
COUNTS = "lang string, phrase string, weight long, bit long"
STEP = np.uint64(0x9E3779B97F4A7C15)


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, weight): the distinct pieces of texts with their multiplicities."""
    text = ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(text, BREAK)).alias("piece"))
    each = each.withColumn("piece", F.expr("trim(BOTH ' \t' FROM piece)")).filter("piece <> ''")
    return each.groupBy("lang", "piece").agg(F.count("*").alias("weight"))


class Words:
    """The words of some pieces as numbers, with the piece of each."""

    def __init__(self, langs: pa.Array, texts: pa.Array, weights: np.ndarray):
        tabs = pc.replace_substring(texts, "\t", " ")
        lists = pc.split_pattern(tabs, " ")
        flat = lists.flatten()
        real = pc.not_equal(pc.binary_length(flat), 0)
        piece = pc.list_parent_indices(lists).filter(real).to_numpy(zero_copy_only=False)
        words, by_lang = flat.filter(real).dictionary_encode(), langs.dictionary_encode()
        self.names, self.langs = words.dictionary, by_lang.dictionary
        self.word = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = by_lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[piece]
        self.piece, self.weight = piece, weights[piece]

    def hashes(self, size: int) -> np.ndarray:
        """Hash of the phrase of `size` words that starts at each place."""
        number = lambda names: np.array([xxhash.xxh64_intdigest(t.encode()) for t in names.to_pylist()], np.uint64)
        word, out = number(self.names)[self.word], number(self.langs)[self.lang]
        n = len(word) - size + 1
        out = out[:n]
        for j in range(size):
            out = mix(out * STEP + word[j : n + j])
        return out

    def summed(self, size: int, bitmap: np.ndarray | None):
        """(lang, phrase, weight) batches: equal phrases of `size` words summed."""
        n = len(self.word) - size + 1
        if n <= 0:
            return
        keep = self.piece[:n] == self.piece[size - 1 :]
        if bitmap is not None:
            bit = bits(self.hashes(size - 1))
            frequent = (bitmap[bit >> np.int64(3)] >> (bit & np.int64(7)).astype(np.uint8)) & 1
            keep &= (frequent[:n] & frequent[1 : n + 1]).astype(bool)
        at = np.flatnonzero(keep)
        if not len(at):
            return
        code, bound = self.lang[at], len(self.langs)
        for j in range(size):
            if bound * len(self.names) >= 1 << 62:
                known, code = np.unique(code, return_inverse=True)
                bound = len(known)
            code, bound = code * len(self.names) + self.word[at + j], bound * len(self.names)
        order = np.argsort(code, kind="stable")
        sorted_code = code[order]
        first = np.flatnonzero(np.concatenate([[True], sorted_code[1:] != sorted_code[:-1]]))
        weight = np.add.reduceat(self.weight[at][order], first)
        where = at[order[first]]
        parts = [self.names.take(pa.array(self.word[where + j])) for j in range(size)]
        phrase = pc.binary_join_element_wise(*parts, " ") if size > 1 else parts[0]
        yield pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[where])), phrase, pa.array(weight)], names=["lang", "phrase", "weight"])

    def totals(self):
        """(lang, null, weight): how many words each language has."""
        total = np.zeros(len(self.langs), np.int64)
        np.add.at(total, self.lang, self.weight)
        yield pa.RecordBatch.from_arrays([self.langs, pa.nulls(len(self.langs), pa.string()), pa.array(total)], names=["lang", "phrase", "weight"])


def bits(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def phrase_bits(langs: list[str], phrases: list[str | None]) -> np.ndarray:
    """The bit of each phrase; the same as Words.hashes gives; -1 for no phrase."""
    number = lambda t: np.uint64(xxhash.xxh64_intdigest(t.encode()))
    out = np.full(len(phrases), -1, np.int64)
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(phrases):
        if p is not None:
            by_size.setdefault(p.count(" ") + 1, []).append(i)
    for at in by_size.values():
        words = [phrases[i].split(" ") for i in at]
        h = np.array([number(langs[i]) for i in at], np.uint64)
        for column in zip(*words, strict=True):
            h = mix(h * STEP + np.array(list(map(number, column)), np.uint64))
        out[at] = bits(h)
    return out


def grams(cut: DataFrame, size: int, bitmap: np.ndarray | None) -> DataFrame:
    """Phrases of `size` words that may be frequent, as (lang, phrase, weight), summed by task and chunk."""
    held = cut.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def chunk(batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        langs, texts = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(0), table.column(1)))
        words = Words(langs, texts, table.column(2).to_numpy())
        if size == 1:
            yield from words.totals()
        yield from words.summed(size, held.value if held is not None else None)

    def run(batches):
        waiting, bytes_ = [], 0
        for b in batches:
            lengths = pc.binary_length(b.column(1)).to_pylist()
            for lo, hi in blocks(lengths, CHUNK):
                part = sum(lengths[lo:hi])
                if waiting and bytes_ + part > CHUNK:
                    yield from chunk(waiting)
                    waiting, bytes_ = [], 0
                waiting.append(b.slice(lo, hi - lo))
                bytes_ += part
        if waiting:
            yield from chunk(waiting)

    return cut.select("lang", "piece", "weight").mapInArrow(run, GRAMS)


def counted(found: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, weight, bit): phrases that occur `least` times at least, and totals (no phrase), summed by bucket."""
    sql = f"CREATE TEMP TABLE sums AS SELECT lang, phrase, CAST(sum(weight) AS BIGINT) AS weight FROM grams GROUP BY lang, phrase HAVING phrase IS NULL OR sum(weight) >= {int(least)}"
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("weight", pa.int64())])

    def run(batches):
        import duckdb

        with tempfile.TemporaryDirectory(prefix="phrases-") as scratch:  # this task's own; it goes with it
            con = duckdb.connect(config={"memory_limit": MEMORY, "threads": 1, "temp_directory": scratch, "preserve_insertion_order": False})
            try:
                con.register("grams", pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches)))
                con.execute(sql)  # reads all the bucket; only then are rows handed on
                for b in con.sql("FROM sums").to_arrow_reader(100_000):
                    bit = phrase_bits(b.column(0).to_pylist(), b.column(1).to_pylist())
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bit)], names=["lang", "phrase", "weight", "bit"])
            finally:
                con.close()

    return found.repartition(shuffled(found.sparkSession), "lang", "phrase").mapInArrow(run, COUNTS)


def bitmap_of(counts: DataFrame) -> np.ndarray:
    """The bits of phrases, as bytes: 2**BITS / 8 of them, whatever the corpus."""
    out = np.zeros(1 << BITS >> 3, np.uint8)
    rows = counts.filter("bit >= 0").groupBy(F.expr("bitmap_bucket_number(bit + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit + 1))").alias("map"))
    for r in rows.toLocalIterator():
        at = (r["bucket"] - 1) * len(r["map"])
        out[at : at + len(r["map"])] = np.frombuffer(r["map"], np.uint8)
    return out


def frequent(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases of up to `longest` words that occur often, and (lang, n): the words of each language."""
    cut, bitmap = saved(pieces(docs)), None
    levels = []
    for size in range(1, longest + 1):
        counts = saved(counted(grams(cut, size, bitmap), least))
        levels.append(counts.filter("phrase IS NOT NULL").select("lang", "phrase", F.lit(size).alias("size"), F.col("weight").alias("f")))
        if size == 1:
            totals = counts.filter("phrase IS NULL").groupBy("lang").agg(F.sum("weight").alias("n"))
        bitmap = bitmap_of(counts) if size < longest else None
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return every, totals


def words_of(first: Column | int, count: Column | int) -> Column:
    return F.array_join(F.slice("words", first, count), " ")


def scored(every: DataFrame) -> DataFrame:
    """Candidates with a, and l, r and score of their lowest-scoring cut."""
    salt = F.pmod(F.xxhash64("lang", "phrase"), F.lit(SALTS))
    candidates = every.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"), salt.alias("salt"))
    # Request 2k asks for the first k words, request 2k + 1 for the rest.
    wanted = F.transform(F.sequence(F.lit(2), 2 * F.col("size") - 1), lambda j: F.struct(j.alias("j"), F.when(j % 2 == 0, words_of(F.lit(1), (j / 2).cast("int"))).otherwise(words_of((j / 2).cast("int") + 1, F.col("size"))).alias("part")))
    requests = candidates.withColumn("request", F.explode(wanted)).select("lang", "phrase", "size", "a", "salt", "request.j", "request.part")
    held = every.select("lang", F.col("phrase").alias("part"), "f", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(SALTS)])).alias("salt"))
    answers = requests.join(held, ["lang", "part", "salt"]).groupBy("lang", "phrase", "size", "a").agg(F.map_from_entries(F.collect_list(F.struct("j", "f"))).alias("parts"))
    exact = lambda c: c.cast("decimal(19,0)")
    a = exact(F.col("a"))

    def cut(k: Column) -> Column:
        left, right = F.element_at("parts", 2 * k), F.element_at("parts", 2 * k + 1)
        return F.struct(F.floor(F.lit(SCORE).cast("decimal(7,0)") * a / (exact(left) + exact(right))).cast("bigint").alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    cuts = answers.withColumn("cut", F.array_min(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)))
    return cuts.select("lang", "phrase", "size", "a", "cut.l", "cut.r", "cut.score")


def outer(every: DataFrame) -> DataFrame:
    """(lang, phrase, around): the most that a longer phrase around each phrase occurs."""
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: words_of(i, n))))
    longer = every.filter("size > 2").withColumn("words", F.split("phrase", " "))
    return longer.select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score."""
    every, totals = frequent(docs, least, longest)
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    kept = scored(every).join(outer(every), ["lang", "phrase"], "left").filter(F.col("around").isNull() | (wide("around") * 100 < wide("a") * INNER))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
