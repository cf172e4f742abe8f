"""Harmonic packing of token sequences.

A sequence holds C tokens. Lengths fall into reciprocal-capacity classes: class j is (C/(j+1), C/j].
As documents may be cut, a length of class j gives one piece of exactly floor(C/(j+1)) tokens and a
rest, which is classed again and is much shorter each time (at most C/(j(j+1))). So every class has
one piece length s, and each of its bins is filled with a fixed count of pieces, floor(C/s), by each
task independently: nothing is shuffled, and a task holds only its open bins (a bound that C gives).
At its end a task lays the pieces of its open bins end to end, cuts them at C, and cuts the tail
into powers of two, which need no padding.

Tokens come from the `tokenizers` library. Words repeat, so a text of Latin-1 characters is split
into words here (by the pattern of the tokenizer file) and only words not met before are encoded;
other texts are encoded whole.

Defined cases: a null or empty text is the end token alone; texts of any length are cut; repeated
rows are packed each; an empty table gives an empty result; other columns are passed over.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import parts, small_batches

CAPACITY = 4096
END = 2
#: Words whose tokens a task remembers.
MOST_WORDS = 300_000
CHUNK = 2 << 20

# The pre-tokenizer's pattern, restricted to Latin-1.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼½¾"
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokens:
    """Token ids of texts, exactly as the tokenizer file gives them, with a memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.special = [s.content for s in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def learn(self, words: list[str]) -> None:
        """Encode new words together and split their tokens where words end."""
        for at in range(0, len(words), 4096):
            some = words[at : at + 4096]
            ids = self.whole(" ".join(some))
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                each = [self.whole(w) for w in some]
                ids, cuts = np.concatenate(each), np.cumsum([len(e) for e in each])
            base = self.starts[-1][-1]
            self.flat.append(ids)
            self.starts.append(cuts + base)
            for w in some:
                self.known[w] = len(self.known)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > MOST_WORDS:
            self.forget()
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, lists = [], []
        for i, t in enumerate(texts):
            try:
                t.encode("latin-1")
            except UnicodeEncodeError:
                out[i] = self.whole(t)
                continue
            if any(s in t for s in self.special):
                out[i] = self.whole(t)
                continue
            plain.append(i)
            lists.append(WORDS.findall(t.lower()))
        self.learn(list(dict.fromkeys(w for ws in lists for w in ws if w not in self.known)))
        self.flat, self.starts = [np.concatenate(self.flat)], [np.concatenate(self.starts)]
        flat, starts = self.flat[0], self.starts[0]
        known = self.known
        for i, ws in zip(plain, lists, strict=True):
            at = np.fromiter((known[w] for w in ws), np.int64, len(ws))
            a, n = starts[at], starts[at + 1] - starts[at]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out[i] = flat[np.repeat(a - ends + n, n) + np.arange(total)]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordTokens:
    return WordTokens(path)


def piece_length(rest: int, capacity: int = CAPACITY) -> int:
    """The next piece of a rest: the capacity, a length that fills its bin evenly, or the slot below."""
    if rest >= capacity:
        return capacity
    share = capacity // rest
    return rest if capacity % rest == 0 or rest <= share else capacity // (share + 1)


def pieces(length: int, capacity: int = CAPACITY) -> list[int]:
    out = []
    while length:
        out.append(piece_length(length, capacity))
        length -= out[-1]
    return out


class Packer:
    """Open bins of one task. A piece is (document, its ids, start, length, its document's tokens)."""

    def __init__(self, first: int, capacity: int = CAPACITY):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple]] = {}

    def bin(self, members: list[tuple]):
        offset = 0
        for doc, ids, start, length, total in members:
            yield doc, start, length, zlib.crc32(ids.tobytes()), total, self.next, offset
            offset += length
        self.next += 1

    def put(self, doc, ids: np.ndarray):
        start = 0
        for n in pieces(len(ids), self.capacity):
            held = self.open.setdefault(n, [])
            held.append((doc, ids[start : start + n], start, n, len(ids)))
            start += n
            if len(held) == self.capacity // n:
                yield from self.bin(self.open.pop(n))

    def close(self):
        """Pieces of open bins end to end: full sequences, then powers of two."""
        left = [p for n in sorted(self.open, reverse=True) for p in self.open[n]]
        self.open = {}
        total = sum(p[3] for p in left)
        room = self.capacity
        members: list[tuple] = []
        for doc, ids, start, length, whole in left:
            while length:
                if not members:
                    room = min(self.capacity, 1 << (total.bit_length() - 1))
                n = min(length, room)
                members.append((doc, ids[:n], start, n, whole))
                ids, start, length, room, total = ids[n:], start + n, length - n, room - n, total - n
                if not room:
                    yield from self.bin(members)
                    members = []


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def arrow(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (map(list, zip(*rows, strict=True)) if rows else [[]] * 7)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece; a sequence's id is the task's number and a count within it."""

    def run(batches):
        words = encoder(path or tokenizer_path())
        packer = Packer(TaskContext.get().partitionId() << 40, capacity)
        rows: list[tuple] = []
        for b in parts(batches, 1, CHUNK):
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc, tokens in zip(b.column(0).to_pylist(), words.encode(texts), strict=True):
                rows += packer.put(doc, np.append(tokens, np.uint32(END)))
            if len(rows) >= 20_000:
                yield arrow(rows)
                rows = []
        rows += packer.close()
        yield arrow(rows)

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
