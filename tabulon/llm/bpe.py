"""BPE encoding and decoding by backtracking over longest matches.

A word is a row of symbols: its bytes, the last one marked as a word's end. An Aho-Corasick automaton
gives the longest token that starts at each place. The encoder takes the longest one that is
*compatible* with the token before it, shortens it to its longest prefix that is a token if it is
not, and steps back where none fits; a place that was left is not entered again, so the work is linear
in the word. Two tokens are compatible if merging by rank would leave the cut between them: undoing
their merges, the latest first, never meets a pair across the cut that would have been merged before.
Answers are kept in a table of pairs. The result is exactly that of applying merges by rank.

Symbols and tokens are numbered in the order of merges here; ids are those of the tokenizer file.
Texts are normalised and split as the file says. Where all characters are below U+0250 or common
punctuation that is done here; else by the library's normaliser and splitter, as other libraries know
other versions of Unicode. No word spans white space, so what white space parts is split and encoded
once while a worker remembers it.

Decoding looks ids up in an offset table: the bytes of all tokens end to end, and where each starts.
As the file has no decoder, tokens are parted by a space.

Defined cases: a null or empty text has no token and decodes to the empty text; a special token's
string inside a text is that token; texts of any length go through in slices cut at white space, words
of any length whole; repeated rows are encoded each; an empty table gives an empty result; further
columns are not looked at. Ids outside the vocabulary, and null ids, decode to nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import parts, small_batches
from tabulon.llm.packing import tokenizer_path

#: Bytes of texts that are encoded together, characters of a slice, and words that a worker remembers.
CHUNK, SLICE, MOST_WORDS, MOST_PAIRS = 2 << 20, 1 << 20, 300_000, 2_000_000

# The splitter's pattern, for characters below U+0250 and punctuation from U+2010 to U+205E.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
NUMBER = "0-9²³¹¼½¾"
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^{SPACE}{LETTER}{NUMBER}]+")
GAP = re.compile(f"[{SPACE}]")
#: Characters of plain texts: not the control characters that lists of white space disagree on.
PLAIN = re.compile("[\x00-\x1b\x20-ɏ‐-‧‰-⁞]*")


class Offsets:
    """An offset table: byte strings end to end, and where each starts."""

    def __init__(self, strings: list[bytes]):
        self.starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

    def of(self, which: np.ndarray) -> bytes:
        which = which[(which >= 0) & (which < len(self.starts) - 1)]
        start = self.starts[which]
        n = self.starts[which + 1] - start
        ends = np.cumsum(n)
        return self.bytes[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class Vocabulary:
    """Tokens by number, how each was merged, and the automaton of all of them."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        end, vocab = model["end_of_word_suffix"], model["vocab"]
        shown = byte_characters()
        names = [shown[b] for b in range(256)] + [shown[b] + end for b in range(256)]
        number = {t: i for i, t in enumerate(names)}
        text = [chr(i) for i in range(512)]  # a token as symbols: bytes, and bytes at a word's end from 256 on
        self.left, self.right = list(range(512)), list(range(512))
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = number[a], number[b]
            name = a.removesuffix(end) + b
            if (x, y) in self.merged or name in number:
                raise ValueError(f"two merges make {name}")
            number[name] = self.merged[x, y] = len(names)
            names.append(name)
            text.append(text[x] + text[y])
            self.left.append(x)
            self.right.append(y)
        self.ids = [vocab[n] for n in names]
        self.length = [len(t) for t in text]
        self.pairs: dict[int, bool] = {}
        known = {t: i for i, t in enumerate(text) if i < 512 or self.compatible(self.left[i], self.right[i], i)}
        self.known = known
        self.shorter = [next((known[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in known), -1) for t in text]
        self.automaton = ahocorasick.Automaton()
        for t, i in known.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        # The offset table of decoding: a token's bytes and the space after it.
        size = max([*vocab.values(), *self.special.values()]) + 1
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = Offsets([f"{by_id[i]} ".encode() if i in by_id else b"" for i in range(size)])
        self.decimals = Offsets([f"{i} ".encode() for i in range(size)])
        self.words: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, tuple[int, ...]] = {}

    def compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Would merging by rank (by merges before a number) leave the cut between two tokens?"""
        bound = before if before is not None else len(self.left)
        while True:
            made = self.merged.get((left, right))
            if made is not None and made < bound:
                return False
            if left > right:  # the left one was merged last: the cut was there just before
                bound, left = left, self.right[left]
            elif right >= 512:  # of two merges of a number the left one comes first
                bound, right = right + 1, self.left[right]
            else:
                return True
            if bound < 512:
                return True

    def fits(self, left: int, right: int) -> bool:
        """Are two tokens compatible? The table of pairs is looked up first."""
        if len(self.pairs) > MOST_PAIRS:
            self.pairs.clear()
        known = self.pairs[left << 32 | right] = self.compatible(left, right)
        return known

    def symbols(self, symbols: str) -> list[int]:
        """Token numbers of a row of symbols."""
        if (whole := self.known.get(symbols)) is not None:
            return [whole]
        size = len(symbols)
        longest = [-1] * (size + 1)
        for end, (n, token) in self.automaton.iter(symbols):
            longest[end - n + 1] = token  # later ends are longer
        length, shorter, pair, fits = self.length, self.shorter, self.pairs.get, self.fits
        left_at = bytearray(size + 1)
        out: list[int] = []
        place, token, last = 0, longest[0], -1
        while place < size:
            while token >= 0:
                if not left_at[place + length[token]]:
                    if last < 0:
                        break
                    good = pair(last << 32 | token)
                    if fits(last, token) if good is None else good:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                place += length[token]
                last, token = token, longest[place]
            else:  # no token fits here: this place is left for good, and the token before is shortened
                left_at[place] = 1
                token = out.pop()
                place -= length[token]
                last = out[-1] if out else -1
        return out

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        got = self.words.get(word)
        if got is None:
            if len(self.words) > MOST_WORDS:
                self.words.clear()
            raw = word.encode().decode("latin-1")
            got = tuple([self.ids[t] for t in self.symbols(raw[:-1] + chr(ord(raw[-1]) + 256))])
            if len(word) < 256:
                self.words[word] = got
        return got

    def run(self, run: str) -> tuple[int, ...]:
        """Ids of a run of characters without white space, normalised already."""
        if PLAIN.fullmatch(run):
            words = WORDS.findall(run)
            if len(words) == 1:
                return self.word(run)
        else:
            value = byte_values()
            words = [bytes(value[c] for c in w).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(run)]
        return tuple(chain.from_iterable(map(self.word, words)))

    def normalised(self, text: str) -> tuple[str, str | None]:
        """The text as words are looked for in it, and what parts its runs: any white space, or spaces alone."""
        return (text.lower(), None) if PLAIN.fullmatch(text) else (self.library.normalizer.normalize_str(text), " ")

    def encode(self, text: str | None) -> Iterator[np.ndarray]:
        """Ids of a text, slice by slice."""
        if not text:
            return
        at = 0
        for found in self.at_special.finditer(text):
            yield from self.ordinary(text[at : found.start()])
            yield np.array([self.special[found.group()]], np.int64)
            at = found.end()
        yield from self.ordinary(text[at:])

    def ordinary(self, text: str) -> Iterator[np.ndarray]:
        (text, gap), start = self.normalised(text), 0
        while start < len(text):
            found = GAP.search(text, start + SLICE) if gap is None else text.find(gap, start + SLICE)
            end = (found.start() if found else len(text)) if gap is None else found if found >= 0 else len(text)
            runs = text[start:end].split(gap)
            if len(self.runs) > MOST_WORDS:
                self.runs.clear()
            known = self.runs
            for r in set(runs).difference(known):
                known[r] = self.run(r)
            yield np.fromiter(chain.from_iterable(map(known.__getitem__, runs)), np.int64)
            start = end

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of tokens, a space after each."""
        return self.tokens.of(ids)


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary files: itself if it is printable, else the next free one from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [chr(b) for b in range(256)], 256
    for b in sorted(set(range(256)) - set(printable)):
        out[b] = chr(free)
        free += 1
    return out


@lru_cache(maxsize=1)
def byte_values() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_characters())}


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def texts_of(docs: DataFrame, key: str, column: str) -> DataFrame:
    return small_batches(docs).select(F.col(key).alias("doc_id"), F.col(column).cast("string").alias("text"))


def encoded(docs: DataFrame, key: str = "doc_id", column: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of each text."""
    path = path or tokenizer_path()

    def run(batches):
        v = vocabulary(path)
        for b in parts(batches, 1, CHUNK):
            each = [np.concatenate([np.empty(0, np.int64), *v.encode(t)]) for t in b.column(1).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *each]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    rows = texts_of(docs, key, column)
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decoded(tokens: DataFrame, key: str = "doc_id", column: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text): the text of each row of token ids; null ids are passed over, a null row is the empty text."""
    path = path or tokenizer_path()

    def run(batches):
        v = vocabulary(path)
        for b in batches:
            lists = b.column(1)
            texts = [v.decode(np.array([-1 if i is None else i for i in row or ()], np.int64))[:-1].decode("utf-8", "replace") for row in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = small_batches(tokens).select(F.col(key).alias("doc_id"), F.col(column).cast("array<bigint>").alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, text string")


def digest(v: Vocabulary, text: str | None) -> tuple[int, str, str]:
    """How many tokens a text has, and digests of its ids and of what they decode to."""
    n, ids_digest, text_digest = 0, hashlib.sha256(), hashlib.sha256()
    for ids in v.encode(text):
        if len(ids):
            # The space after the last token of a slice is what parts it from the next one.
            for hashed, raw in ((ids_digest, v.decimals.of(ids)), (text_digest, v.decode(ids))):
                hashed.update(b" " if n else b"")
                hashed.update(memoryview(raw)[:-1])
            n += len(ids)
    return n, ids_digest.hexdigest(), text_digest.hexdigest()


def digests(docs: DataFrame, key: str = "doc_id", column: str = "text", path: str | None = None) -> DataFrame:
    """n_tokens, ids_sha256 (decimal ids, a space between) and decoded_sha256 of each whole text."""
    path = path or tokenizer_path()

    def run(batches):
        v = vocabulary(path)
        for b in parts(batches, 1, CHUNK):
            found = [digest(v, t) for t in b.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) if found else [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = texts_of(docs, key, column)
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
