"""SentencePiece encoding and decoding with sampled segmentations.

A text's lattice has an edge for each vocabulary piece that matches at a place; a character that no
piece covers is spelt by byte pieces. Pieces have the weight -log(rank + OFFSET) / temperature, so a
segmentation's chance is a softmax over the lattice. `samples` returns k distinct segmentations of
each text drawn without replacement: each segmentation has a Gumbel-perturbed log chance, and a
best-first (A*) search hands them out in falling order. A search node is a prefix of the path
together with the edges there that are handed out already; its bound is the maximum of the perturbed
log chances below it, drawn top-down from its parent's, so the search is exact.

Pieces do not cross the start of a word (a run of spaces and what follows it), so the lattice of a
text is a chain of small ones. What leads to a place in a word depends on the characters before it
alone, so words share the places of their common beginnings, in a tree that is kept with its forward
log sums. The search of all texts of a batch goes in rounds: a round takes the best node of each text, walks the rest of its
path through all words of all texts at once, and bounds the ways that the walk passes by. Ways that
leave the path after its first HEAD places are one node with their summed chance, which is parted
into its places only if it becomes the best.

A sample's inclusion score is the chance that its perturbed log chance exceeds the threshold, the
k+1-st largest one: 1 - exp(-exp(log p - threshold)); it is 1 if there are no more than k
segmentations. Random numbers are hashes of the row's key, the round, the word's place and the step,
so a row's samples depend on neither its task nor its batch.

Decoding gives back the text exactly, whatever it holds: the word-start mark itself and characters
outside the vocabulary are spelt in bytes.

Defined cases: a null or empty text has one empty segmentation; texts and words of any length are
processed whole; repeated rows get the same samples; an empty table gives an empty result; further
columns are not looked at.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import joined, mix, parts, shuffled, small_batches, utf8

SAMPLES = 3
TEMPERATURE = 3.0
OFFSET = 100
MARK = "▁"
#: Bytes of texts that are sampled together, and places of words that a worker remembers.
CHUNK, MOST_NODES = 1 << 19, 1_000_000
#: Bits of a code point in the keys of trees.
CODE = np.int64(21)
#: Places of words that are looked for among the places of other words.
SHARED = 48


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, .. of count[i] numbers, for each i in turn."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Table:
    """A hash table of numbers with linear probing; empty slots have the key -1."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1), np.zeros(1 << bits, np.int32)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of these keys, or -1."""
        at, last = self.slots(keys), len(self.keys) - 1
        held = self.keys[at]
        moved = np.flatnonzero((held != keys) & (held >= 0))
        while len(moved):
            at[moved] = (at[moved] + 1) & last
            held[moved] = other = self.keys[at[moved]]
            moved = moved[(other != keys[moved]) & (other >= 0)]
        return np.where(held == keys, self.values[at], -1)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Different keys that the table doesn't hold yet."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            held = np.flatnonzero(self.keys >= 0)
            keys, values = np.concatenate([self.keys[held], keys]), np.concatenate([self.values[held], values])
            self.__init__((2 * len(keys)).bit_length())
        self.size += len(keys)
        at = self.slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            self.keys[at[free]] = keys[free]  # of several for one slot one stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            left = np.flatnonzero(~won)
            keys, values, at = keys[left], values[left], (at[left] + 1) & (len(self.keys) - 1)


class Column:
    """An array that grows at its end."""

    def __init__(self, kind: type):
        self.data, self.size = np.empty(1 << 12, kind), 0

    def append(self, new: np.ndarray) -> None:
        if self.size + len(new) > len(self.data):
            wider = np.empty(max(2 * len(self.data), self.size + len(new)), self.data.dtype)
            wider[: self.size] = self.data[: self.size]
            self.data = wider
        self.data[self.size : self.size + len(new)] = new
        self.size += len(new)


class Pieces:
    """Vocabulary, weights, and the lattices of the words met, which share their beginnings."""

    def __init__(self, path: str, temperature: float = TEMPERATURE):
        from sentencepiece import SentencePieceProcessor

        self.model = model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(self.size)]
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.value = {i: b for b, i in self.bytes.items()}
        self.ids = {self.text[i]: i for i in range(self.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.weight = [-math.log(i + OFFSET) / temperature for i in range(self.size)]
        self._weights = np.array(self.weight)
        self._byte_id = np.array([self.bytes[b] for b in range(256)])
        # The tree of all ends of pieces, read backwards: from (state, code point) to states, and the states' pieces.
        states, ends = {"": 0}, {}
        for text, i in self.ids.items():
            for n in range(1, len(text) + 1):
                states.setdefault(text[::-1][:n], len(states))
            ends[states[text[::-1]]] = i
        self._ends = Table()
        self._ends.add(np.array([states[t[:-1]] << int(CODE) | ord(t[-1]) for t in states if t], np.int64), np.arange(1, len(states)))
        self._piece = np.array([ends.get(s, -1) for s in range(len(states))])
        # What each piece stands for, as bytes.
        self.raws = [bytes([self.value[i]]) if i in self.value else t.replace(MARK, " ").encode() for i, t in enumerate(self.text)]
        self._raw = pa.array(self.raws, pa.large_binary())
        self.forget()

    def forget(self) -> None:
        # The tree of the beginnings of words: a node's number is above its parent's, 0 is a word's start. The table has
        # nodes by parent and code point. A node's edges are those that end there, whatever follows: words share them.
        self.tree = Table()
        # Of each node: parent, code point, in how many batches it was met, log sum of its ways, its first edge and their number.
        self.nodes = {"parent": Column(np.int32), "letter": Column(np.int32), "uses": Column(np.int32), "log": Column(np.float64), "first": Column(np.int32), "degree": Column(np.int8)}
        # Edges: the node they come from (-1 for a word's start), the piece (or -1 - code point), log chance (0 if it is the only one), the sum of chances up to it.
        self.ways = {"source": Column(np.int32), "code": Column(np.int32), "chance": Column(np.float64), "upto": Column(np.float64)}
        self.append(self.nodes, ([-1], [0], [1 << 30], [0.0], [0], [0]))
        self.append(self.ways, ([], [], [], []))

    def append(self, columns: dict[str, Column], values: tuple) -> None:
        for (name, column), new in zip(columns.items(), values, strict=True):
            column.append(np.asarray(new))
            setattr(self, name, column.data[: column.size])

    def keep_frequent(self) -> None:
        """Drop the nodes that were met least often, half of all at least. A parent is met as often as its children, and precedes them."""
        by = np.argsort(-self.uses, kind="stable")[: max(1, MOST_NODES // 2)]
        own = np.sort(by[self.uses[by] > 1])
        number = np.zeros(len(self.first), np.int64)
        number[own] = np.arange(len(own))
        degree = self.degree[own].astype(np.int64)
        way = spread(self.first[own].astype(np.int64), degree)
        parent, letter = number[self.parent[own[1:]]], self.letter[own[1:]]
        nodes = (parent, letter, self.uses[own[1:]] // 2, self.log[own[1:]], (np.cumsum(degree) - degree)[1:], degree[1:])
        source = self.source[way]
        ways = (np.where(source < 0, -1, number[source]), self.code[way], self.chance[way], self.upto[way])
        self.forget()
        self.append(self.nodes, nodes)
        self.append(self.ways, ways)
        self.tree.add(parent << CODE | letter, np.arange(1, len(own)))

    def learn(self, letters: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The end nodes of words, given the code points of all and their numbers; new nodes get their edges."""
        if len(self.first) > MOST_NODES:
            self.keep_frequent()
        old, begin = len(self.first), np.cumsum(sizes) - sizes
        out, here, active, levels = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.arange(len(sizes)), [old]
        for place in range(SHARED):
            keys = here << CODE | letters[begin[active] + place]
            here = self.tree.find(keys).astype(np.int64)
            missing = np.flatnonzero(here < 0)
            if len(missing):
                fresh, which = np.unique(keys[missing], return_inverse=True)
                here[missing] = len(self.parent) + which
                self.tree.add(fresh, len(self.parent) + np.arange(len(fresh)))
                self.begin(fresh >> CODE, fresh & ((1 << CODE) - 1))
                levels.append(len(self.parent))
            self.uses[here] += 1
            out[active] = here
            go = np.flatnonzero(sizes[active] > place + 1)
            active, here = active[go], here[go]
            if not len(active):
                break
        else:
            # What follows in longer words is not shared: nodes of its own, by place, so that all advance together.
            rest = sizes[active] - SHARED
            ends = np.cumsum(rest)
            place = np.arange(ends[-1]) - np.repeat(ends - rest, rest)
            own = np.empty(len(place), np.int64)
            by = np.argsort(place, kind="stable")
            own[by] = len(self.parent) + np.arange(len(by))
            parent = np.concatenate([[0], own[:-1]])
            parent[ends - rest] = here
            out[active] = own[ends - 1]
            levels += (len(self.parent) + np.cumsum(np.bincount(place))).tolist()
            self.begin(parent[by], letters[spread(begin[active] + SHARED, rest)][by])
            self.uses[int(own.min()) :] = 1
        if len(self.parent) > old:
            self.grow(old, levels)
        return out

    def begin(self, parent: np.ndarray, letter: np.ndarray) -> None:
        """New nodes, which have no edges yet."""
        for name, new in (("parent", parent), ("letter", letter), ("uses", np.zeros(len(parent)))):
            self.append({name: self.nodes[name]}, (new,))

    def rest(self, edges: np.ndarray) -> np.ndarray:
        """Log chances that another edge than these is taken at their nodes."""
        chance = self.chance[edges]
        return np.where(chance == 0, -np.inf, np.log(np.maximum(-np.expm1(chance), 1e-300)))

    def edges(self, old: int):
        """(from, to, code, weight) of all edges that end at the nodes from `old` on; the edges of a node have falling lengths."""
        end = here = np.arange(old, len(self.parent))
        state = np.zeros(len(end), np.int64)
        single = np.zeros(len(end), bool)
        found = []
        while len(end):
            letter = self.letter[here]
            shown = np.where(letter == ord(MARK), 0, np.where(letter == 32, ord(MARK), letter))
            state = self._ends.find(state << CODE | shown)
            go = np.flatnonzero(state >= 0)
            end, here, state = end[go], self.parent[here[go]], state[go].astype(np.int64)
            piece = self._piece[state]
            full = np.flatnonzero(piece >= 0)
            if not found:
                single[end[full] - old] = True
            found.append((here[full], end[full], piece[full], self._weights[piece[full]]))
            more = np.flatnonzero(here > 0)
            end, here, state = end[more], here[more], state[more]
        spelt = np.flatnonzero(~single) + old
        values, which = np.unique(self.letter[spelt], return_inverse=True)
        cost = np.array([sum(self.weight[i] for i in self.spell(int(c))) for c in values])
        found.insert(0, (self.parent[spelt], spelt, -1 - self.letter[spelt], cost[which] if len(values) else np.empty(0)))
        count = np.zeros(len(self.parent) - old, np.int64)
        for _, end, _, _ in found:
            count[end - old] += 1
        free = np.cumsum(count) - count
        out = [np.empty(int(count.sum()), c.dtype) for c in (*found[0][:3], self._weights)]
        for columns in reversed(found):
            at = free[columns[1] - old]
            free[columns[1] - old] += 1
            for o, column in zip(out, columns, strict=True):
                o[at] = column
        return out, count

    def spell(self, letter: int) -> list[int]:
        return [self.bytes[b] for b in chr(letter).encode("utf-8", "surrogatepass")]

    def grow(self, old: int, levels: list[int]) -> None:
        """The edges of the nodes from `old` on. Nodes go by place, so that all words advance together: levels[i] to levels[i + 1]."""
        (source, _, code, weight), count = self.edges(old)
        new = np.cumsum(count) - count  # first edges of nodes
        self.append({"log": self.nodes["log"]}, (np.zeros(len(count)),))
        chance, share = np.empty(len(source)), np.empty(len(source))
        heads = [*new.tolist(), len(source)]
        for a, b in zip(levels[:-1], levels[1:], strict=True):
            lo, hi = heads[a - old], heads[b - old]
            value = self.log[source[lo:hi]] + weight[lo:hi]
            cut, times = new[a - old : b - old] - lo, count[a - old : b - old]
            most = np.maximum.reduceat(value, cut)
            part = np.exp(value - np.repeat(most, times))
            total = np.add.reduceat(part, cut)
            self.log[a:b] = whole = most + np.log(total)
            chance[lo:hi] = value - np.repeat(whole, times)
            share[lo:hi] = part / np.repeat(total, times)
        only = np.repeat(count == 1, count)
        chance = np.where(only, 0.0, np.minimum(chance, -1e-300))
        share[only] = 1.0
        # Sums of shares within a node, by their place in it: a node has as many edges as pieces have lengths at most.
        upto = share
        for i in range(1, int(count.max(initial=0))):
            at = new[count > i] + i
            upto[at] += upto[at - 1]
        upto[new + count - 1] = 2.0  # the last edge takes what rounding leaves
        for name, column in (("first", new + len(self.source)), ("degree", count)):
            self.append({name: self.nodes[name]}, (column,))
        self.append(self.ways, (np.where(source == 0, -1, source), code, chance, upto))

    def spelling(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges in turn, and their number by edge."""
        count = np.ones(len(codes), np.int64)
        odd = np.flatnonzero(codes < 0)
        if not len(odd):
            return codes, count
        letters, which = np.unique(-1 - codes[odd], return_inverse=True)
        spelt = [self.spell(int(c)) for c in letters]
        size = np.array([len(s) for s in spelt])
        count[odd] = size[which]
        flat = np.concatenate([np.array(s) for s in spelt])
        out = np.repeat(codes, count)
        begin = np.cumsum(count) - count
        out[spread(begin[odd], count[odd])] = flat[spread((np.cumsum(size) - size)[which], size[which])]
        return out, count

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation, without the space that encoding puts in front."""
        return b"".join(map(self.raws.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    # --- walks ---------------------------------------------------------------------------------
    def walk(self, nodes: np.ndarray, seeds: np.ndarray):
        """From each node back to its word's start: the edges, in the order of nodes, and the steps by node."""
        active, t, taken = np.arange(len(nodes)), 0, []
        here, steps = nodes, np.zeros(len(nodes), np.int64)
        while len(active):
            u = uniform(seeds + np.uint64((t * STEP) & MASK))
            pick = self.first[here]
            open_ = np.flatnonzero(u > self.upto[pick])
            while len(open_):
                pick[open_] = after = pick[open_] + 1
                open_ = open_[u[open_] > self.upto[after]]
            taken.append((active, pick))
            here, t = self.source[pick], t + 1
            steps[active[here < 0]] = t
            go = np.flatnonzero(here >= 0)
            active, here, seeds = active[go], here[go], seeds[go]
        begin = np.cumsum(steps) - steps
        edges = np.empty(int(steps.sum()), np.int64)
        for t, (a, p) in enumerate(taken):
            edges[begin[a] + t] = p
        return edges, steps


#: Places of a path, from the text's end, that have bounds of their own; those after it share one until it is the best.
HEAD = 64
NONE = np.empty(0, np.int64)
STEP, ITEM, MASK = 0xD1342543DE82EF95, 0x9E3779B97F4A7C15, (1 << 64) - 1


def uniform(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) of hashed words."""
    bits = mix(x)
    bits >>= np.uint64(11)
    out = bits.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def below(location: np.ndarray, top, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers of these locations, given that they are below `top`."""
    e = -np.log(u)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        shifted = e * np.exp(np.minimum(top - location, 700.0))
        out = np.where((top - location < 700) & (shifted < 1e300), top - np.log1p(shifted), location - np.log(e))
    return np.where(location == -np.inf, -np.inf, out)


class Search:
    """The search of one text: its words' ends from the last to the first, its paths and its frontier."""

    __slots__ = ("frontier", "lasts", "out", "paths", "seed", "ties")

    def __init__(self, lasts: np.ndarray, seed: int):
        # A path is (edges up to where it left an older one, its own edges, their log sums, its first word, where its words end).
        self.lasts, self.seed, self.frontier, self.out, self.paths, self.ties = lasts, seed, [], [], [], 0

    def push(self, bound: float, path: int, place: int, gone: tuple) -> None:
        if bound > -math.inf:
            heapq.heappush(self.frontier, (-bound, self.ties, path, place, gone))
            self.ties += 1

    def pop(self, pieces: Pieces, need: int) -> tuple:
        """The best node, (bound, path, place, edges gone); a node of a whole tail is first parted into those of its places."""
        while True:
            value, _, path, place, gone = heapq.heappop(self.frontier)
            if place >= 0:
                return -value, path, place, gone
            _, edges, logs, _, _ = self.paths[path]
            at = logs[HEAD:] - pieces.chance[edges[HEAD:]] + pieces.rest(edges[HEAD:])
            u = uniform(mix(np.array([self.seed], np.uint64)) + np.arange(1, len(at) + 2, dtype=np.uint64) * np.uint64(STEP) + np.uint64(path * ITEM & MASK))
            share = np.cumsum(np.exp(at - at.max()))
            best = min(int(np.searchsorted(share, u[-1] * share[-1])), len(at) - 1)
            bounds = below(at, -value, u[:-1])
            bounds[best] = -value
            for j in np.argsort(-bounds, kind="stable")[: need + 1].tolist():
                self.push(float(bounds[j]), path, HEAD + j, (int(edges[HEAD + j]),))


def round_of(pieces: Pieces, searches: list[Search], number: int, k: int) -> None:
    """One more segmentation of each text, from the best node of its frontier."""
    need = k - number
    own = mix(np.array([s.seed for s in searches], np.uint64) + np.uint64((number + 1) * ITEM & MASK))
    begun: list[tuple] = []  # of each text: bound, log chance of the prefix, prefix, first word
    if not number:
        begun = [(top, 0.0, NONE, 0) for top in (-np.log(-np.log(uniform(own)))).tolist()]
        nodes = [s.lasts for s in searches]
    else:
        nodes = []
        chances = uniform(own[:, None] + np.arange(1, 3, dtype=np.uint64) * np.uint64(STEP))
        for s, u in zip(searches, chances, strict=True):
            top, path, place, gone = s.pop(pieces, need)
            before, edges, logs, word, ends = s.paths[path]
            old = int(edges[place])
            log = float(logs[place]) - float(pieces.chance[old])
            # Of the edges that are left at the node one takes its maximum, by chance; the others stay.
            low = high = old
            while low and pieces.upto[low - 1] < 1.5:
                low -= 1
            while pieces.upto[high] < 1.5:
                high += 1
            left = [e for e in range(low, high + 1) if e not in gone]
            share = np.exp(pieces.chance[left])
            pick = left[min(int(np.searchsorted(np.cumsum(share), u[0] * share.sum())), len(left) - 1)]
            if len(left) > 1:
                others = float(sum(x for e, x in zip(left, share.tolist(), strict=True) if e != pick))
                s.push(float(below(np.array([log + math.log(max(others, 1e-300))]), top, u[1:])[0]), path, place, (*gone, pick))
            word += int(np.searchsorted(ends, place, side="right"))
            at = int(pieces.source[pick])
            partial = at >= 0
            nodes.append(np.concatenate([[at], s.lasts[word + 1 :]]) if partial else s.lasts[word + 1 :])
            begun.append((top, log + float(pieces.chance[pick]), np.concatenate([before, edges[:place], [pick]]), word if partial else word + 1))
    sizes = np.fromiter(map(len, nodes), np.int64, len(nodes))
    turn = spread(np.ones(len(nodes), np.int64), sizes).astype(np.uint64)
    seeds = mix(np.repeat(own, sizes) + turn * np.uint64(ITEM))
    edges, steps = pieces.walk(np.concatenate(nodes), seeds)
    chance = pieces.chance[edges]
    ends = np.cumsum(steps)
    item = np.concatenate([[0], np.cumsum(sizes)])
    at = np.concatenate([[0], ends])[item]
    logs = np.empty(len(edges))
    for (_, log, _, _), a, b in zip(begun, at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b > a:
            np.cumsum(chance[a:b], out=logs[a:b])
            logs[a:b] += log
    # Bounds of the ways that leave the path at its first HEAD places, and of all that leave it later.
    count = np.minimum(np.diff(at), HEAD)
    near = spread(at[:-1], count)
    tops, offset = np.array([b[0] for b in begun]), np.concatenate([[0], np.cumsum(count)])
    place = near - np.repeat(at[:-1], count)
    bounds = below(logs[near] - chance[near] + pieces.rest(edges[near]), np.repeat(tops, count), uniform(np.repeat(own, count) + (place + 3).astype(np.uint64) * np.uint64(STEP)))
    long_ = np.flatnonzero(np.diff(at) > HEAD)
    last, bend = logs[at[1:][long_] - 1], logs[at[:-1][long_] + HEAD - 1]
    with np.errstate(divide="ignore"):
        later = below(bend + np.log(-np.expm1(last - bend)), tops[long_], uniform(own[long_] + np.uint64((HEAD + 4) * STEP & MASK)))
    tails = dict(zip(long_.tolist(), later.tolist(), strict=True))
    for i, (s, (top, log, prefix, word)) in enumerate(zip(searches, begun, strict=True)):
        a, b, lo = int(at[i]), int(at[i + 1]), int(offset[i])
        path = len(s.paths)
        s.paths.append((prefix, edges[a:b], logs[a:b], word, ends[item[i] : item[i + 1]] - a))
        s.out.append((path, float(logs[b - 1]) if b > a else log, top))
        mine = bounds[lo : int(offset[i + 1])]
        for j in np.argsort(-mine)[:need].tolist():
            s.push(float(mine[j]), path, j, (int(edges[a + j]),))
        if i in tails:
            s.push(tails[i], path, -1, ())


def words_of(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of texts with a space in front, each with its spaces, as numbers of different words; where each text begins."""
    data, offsets = joined([b" " + t for t in texts])
    space = data == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[offsets[:-1]] = True
    at = np.append(np.flatnonzero(begins), len(data))
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data)])
    return words.dictionary_encode(), np.searchsorted(at, offsets)


def letters_of(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all words, and their numbers by word."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1]
    data = words.buffers()[2].slice(0, int(offsets[-1])).to_pybytes()
    first = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    letters = np.frombuffer(data.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    return letters.astype(np.int64), np.add.reduceat(first, offsets[:-1], dtype=np.int64)


def samples(pieces: Pieces, texts: list[str | None], k: int, seeds: list[int]):
    """Of each text a list of k segmentations at most, best first: (ids, log chance, perturbed log chance, inclusion score)."""
    out: list[list] = [[(np.empty(0, np.int64), 0.0, 0.0, 1.0)] for _ in texts]
    full = [i for i, t in enumerate(texts) if t]
    if not full:
        return out
    words, size = words_of([utf8(texts[i]) for i in full])
    lasts = pieces.learn(*letters_of(words.dictionary))[np.asarray(words.indices)]
    searches = [Search(lasts[a:b][::-1], seeds[i]) for i, a, b in zip(full, size[:-1].tolist(), size[1:].tolist(), strict=True)]
    for number in range(k):
        going = [s for s in searches if not number or s.frontier]
        if not going:
            break
        round_of(pieces, going, number, k)
    paths = [np.concatenate(s.paths[path][:2])[::-1] for s in searches for path, _, _ in s.out]
    ids, count = pieces.spelling(pieces.code[np.concatenate(paths)])
    at = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0, *map(len, paths)])]
    n = 0
    for s, i in zip(searches, full, strict=True):
        while s.frontier and s.frontier[0][3] < 0 and len(s.out) == k:
            bound, path, place, gone = s.pop(pieces, 1)
            s.push(bound, path, place, gone)
        threshold = -s.frontier[0][0] if s.frontier else -math.inf
        out[i] = []
        for _, log, value in s.out:
            score = 1.0 if threshold == -math.inf else -math.expm1(-math.exp(min(700.0, log - threshold)))
            out[i].append((ids[at[n] : at[n + 1]], log, value, score))
            n += 1
    return out


def sample(pieces: Pieces, text: str | None, k: int, seed: int) -> list[tuple[list[int], float, float, float]]:
    return [(ids.tolist(), *rest) for ids, *rest in samples(pieces, [text], k, [seed])[0]]


@lru_cache(maxsize=2)
def loaded(path: str, temperature: float) -> Pieces:
    return Pieces(path, temperature)


SCHEMA = "sample int, n_pieces int, ids array<int>, log_p double, perturbed double, inclusion double, decoded boolean"


def returns(pieces: Pieces, flat: np.ndarray, offsets: np.ndarray, want: list[bytes]) -> np.ndarray:
    """Whether each segmentation, ids offsets[i] to offsets[i + 1], decodes to the bytes wanted."""
    taken = pieces._raw.take(pa.array(flat))
    sizes = np.frombuffer(taken.buffers()[1], np.int64)[offsets].tolist()
    raw = taken.buffers()[2].to_pybytes()
    return np.array([raw[a:b] == w for a, b, w in zip(sizes[:-1], sizes[1:], want, strict=True)], bool)


def segment(rows: DataFrame, k: int = SAMPLES, path: str | None = None, temperature: float = TEMPERATURE, key: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """k distinct segmentations of each row's text, and whether each decodes to the text. The columns of `key` are longs."""
    schema = ", ".join([*(f"{c} long" for c in key), SCHEMA])
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        pieces = loaded(path or model_path(), temperature)
        for b in parts(batches, len(key), CHUNK):
            own = [b.column(i).to_pylist() for i in range(len(key))]
            texts = b.column(len(key)).to_pylist()
            seeds = [xxhash.xxh64_intdigest("/".join(map(str, x))) for x in zip(*own, strict=True)]
            found = samples(pieces, texts, k, seeds)
            row = np.repeat(np.arange(len(b)), [len(f) for f in found])
            each = [x for f in found for x in f]
            ids = np.concatenate([x[0] for x in each])
            offsets = np.cumsum([0, *(len(x[0]) for x in each)])
            want = [b" " + utf8(t) if t else b"" for t in texts]
            columns = [
                pa.array([i for f in found for i in range(1, len(f) + 1)], pa.int32()), pa.array(np.diff(offsets), pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                *(pa.array([x[i] for x in each], pa.float64()) for i in (1, 2, 3)), pa.array(returns(pieces, ids, offsets, [want[i] for i in row.tolist()])),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(len(key))), *columns], names=names)

    # A search costs far more than moving its text: rows are dealt out, so file sizes don't set the number of tasks.
    dealt = small_batches(rows).select(*[F.col(c).cast("long") for c in key], F.col("text").cast("string")).repartition(shuffled(rows.sparkSession), *key, "text")
    return dealt.mapInArrow(run, schema)


def encoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with a column `ids`, the model's own segmentation of their texts (null for null), in place of one of that name."""

    @F.pandas_udf("array<int>")
    def ids(text):
        model = loaded(path or model_path(), TEMPERATURE).model
        return text.map(lambda t: None if t is None else model.encode(t))

    return small_batches(rows).withColumn("ids", ids(F.col("text").cast("string")))


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """The rows with a column `text` that their `ids` stand for (null for null), in place of one of that name."""

    @F.pandas_udf("string")
    def text(ids):
        pieces = loaded(path or model_path(), TEMPERATURE)
        return ids.map(lambda x: None if x is None else pieces.decode(x))

    return rows.withColumn("text", text(F.col("ids").cast("array<int>")))
