r"""N-gram language model in an Elias-Fano trie, and scores of every text.

Tokens are words `[^\x20\x09-\x0D]+` with A-Z lower-cased, then one end.  The
model keeps every n-gram of up to three words of the training rows, those seen
once included, whatever the size of the corpus.  Probabilities are absolute
discount with back-off weights; unigrams are add-one.  After any context they
sum to one, up to the quantising: log10 values are rounded to steps of 1/2048.

A trie has a level for each n-gram length.  Children of a context are sorted
word numbers, made monotone over the level by adding the last value of the range
before, and stored as an Elias-Fano sequence, as is the sequence of pointers to
the ranges.  Unary parts carry a count of ones for each 64 bits, so pointers and
values are read where they lie, and a query searches the successor of its value
inside the range of its context.  All parts of a trie are flat arrays: `save`
writes them to one file that `load` maps into memory.

A trigram, and what backs it off, is looked up by its middle word: the trie is
cut into shards by the hash of that word.  A middle word with more than
`shard_tokens` occurrences is cut further, by the word before it; the counts of
the pairs that it begins, which then no shard sees whole, are counted apart and
joined to the shards that need them.  Every row's tokens meet the shards once, in
one exchange: the task of a shard learns from the training rows among them, maps
the trie's file in the shared folder, scores all, and sends sums back.  The cut
changes no score.  Where the shared folder is not one that tasks can map (a
store that only Spark reads), a shard's trie stays in the task's memory.

What the driver holds and broadcasts are the 2^`level_bits` most frequent words
with their counts, 20 bytes each, and one number for each cut word; all other
words have their counts joined by hash.  The tokens of a shard are about
`shard_tokens`; only the questions about one pair of words are never dealt to
several tasks (they lie compressed, about 6 bytes each).

Null texts count as empty and score the end alone.  Each row is scored by its
own text; rows without an id teach nothing.  Without training text N and V are 0.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from marketlake.llm.shared import crc_remainder, folder, held
from marketlake.llm.words import flat, mix, slices, words

LEVEL_BITS = 18
DISCOUNT = 0.75
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x2545F4914F6CDD1D)
#: Training tokens of a shard of the trie, about.
SHARD_TOKENS = 1 << 20
#: Tokens that a task turns into questions at a time.
BLOCK_TOKENS = 1 << 20
#: Stands for what is before the first word of a text.
START = np.uint64(0)
_GRID = 2048
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _places() -> np.ndarray:
    """For each 16 bits and n, the place of the n-th set bit: row x * 16 + n."""
    bits = (np.arange(1 << 16)[:, None] >> np.arange(16)) & 1 == 1
    out = np.zeros((1 << 16, 16), np.uint8)
    x, at = np.nonzero(bits)
    out[x, (np.cumsum(bits, axis=1) - 1)[bits]] = at
    return out.ravel()


_PLACES = _places()


def _nth_one(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The place of the n-th set bit of each word."""
    at, n = np.zeros(len(x), np.int64), n.copy()
    for step in (32, 16):
        low = x & np.uint64((1 << step) - 1)
        ones = np.bitwise_count(low)
        up = n >= ones
        n -= ones * up
        x = np.where(up, x >> np.uint64(step), low)
        at += up * np.int64(step)
    return at + _PLACES[(x.astype(np.int64) << 4) + n]


def _distinct_sorted(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]][: len(x)]]


class EliasFano:
    """A sorted sequence of integers: low bits packed, high bits in unary with counts for each 64 bits."""

    PARTS = ("low", "high", "ones", "zeros")

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, zeros: np.ndarray, n: int, bits: int) -> None:
        self.low, self.high, self.ones, self.zeros, self.n, self.bits = low, high, ones, zeros, n, bits

    @staticmethod
    def of(values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bits = max(0, int(np.log2(max(1.0, float(values[-1]) / n)))) if n else 0
        top = (values >> np.uint64(bits)).astype(np.int64)
        size = -(-((int(top[-1]) if n else 0) + n + 1) // 64)
        unary = np.zeros(size * 64, bool)
        unary[top + np.arange(n)] = True
        high = np.packbits(unary, bitorder="little").view("<u8").astype(np.uint64)
        ones = np.r_[0, np.cumsum(np.bitwise_count(high).astype(np.int64))]
        low = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        return EliasFano(low, high, ones.astype(np.uint32), (np.arange(size + 1) * 64 - ones).astype(np.uint32), n, bits)

    def _select(self, i: np.ndarray, bit: bool) -> np.ndarray:
        """Where the i-th one, or zero, of the unary part is."""
        before = self.ones if bit else self.zeros
        word = np.searchsorted(before, i.astype(np.uint32), "right") - 1
        held = self.high[word] if bit else ~self.high[word]
        return word * 64 + _nth_one(held, i - before[word].astype(np.int64))

    def low_bits(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        out |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return out & np.uint64((1 << self.bits) - 1)

    def at(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        top = (self._select(i, True) - i).astype(np.uint64)
        return (top << np.uint64(self.bits)) | self.low_bits(i)

    def values(self) -> np.ndarray:
        return self.at(np.arange(self.n))

    def find(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | int | None = None) -> np.ndarray:
        """The place of each x among the elements from begin to end, or -1: its successor there, if equal."""
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        if not self.n:
            return out
        top = (x >> np.uint64(self.bits)).astype(np.int64)
        inside = (top >= 0) & (top < int(self.zeros[-1]))
        top = np.where(inside, top, 0)
        stop = self._select(top, False) - top
        low = np.where(top > 0, self._select(np.maximum(top - 1, 0), False) - (top - 1), 0)
        low = np.maximum(low, begin)
        high = np.where(inside, np.minimum(stop, self.n if end is None else end), low)
        stop = high.copy()
        want = x & np.uint64((1 << self.bits) - 1)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) >> 1
            less = self.low_bits(mid) < want[open_]
            low[open_[less]] = mid[less] + 1
            high[open_[~less]] = mid[~less]
            open_ = open_[low[open_] < high[open_]]
        at = np.flatnonzero(low < stop)
        good = at[self.low_bits(low[at]) == want[at]]
        out[good] = low[good]
        return out

    def parts(self) -> dict[str, np.ndarray]:
        return {k: getattr(self, k) for k in self.PARTS} | {"size": np.array([self.n, self.bits])}

    @staticmethod
    def from_parts(p: dict[str, np.ndarray]) -> EliasFano:
        return EliasFano(*[p[k] for k in EliasFano.PARTS], int(p["size"][0]), int(p["size"][1]))


def quantise(x: np.ndarray) -> np.ndarray:
    """Two bytes for each log10 value, in steps of 1/2048: the same whatever other values there are."""
    return (np.clip(np.rint(x * _GRID), -32768, 32767)).astype(np.int16)


@dataclass
class Level:
    """n-grams by context: the children of context k are the elements from pointer k to pointer k + 1."""

    pointers: EliasFano
    words: EliasFano
    prob: np.ndarray
    back: np.ndarray

    @staticmethod
    def of(context: np.ndarray, word: np.ndarray, contexts: int, prob: np.ndarray, back: np.ndarray) -> Level:
        at = np.searchsorted(context, np.arange(contexts + 1))
        last = np.zeros(contexts, np.uint64)
        full = at[1:] > at[:-1]
        last[full] = word[at[1:][full] - 1].astype(np.uint64) + np.uint64(1)
        base = np.cumsum(last) - last
        return Level(EliasFano.of(at), EliasFano.of(word.astype(np.uint64) + base[context]), quantise(prob), quantise(back))

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each n-gram, or -1; context or word of -1 has none."""
        out = np.full(len(word), -1, np.int64)
        some = np.flatnonzero((context >= 0) & (word >= 0))
        if len(some) and self.words.n:
            c = context[some]
            begin, end = self.pointers.at(c).astype(np.int64), self.pointers.at(c + 1).astype(np.int64)
            full = begin < end
            some, begin, end = some[full], begin[full], end[full]
            # The range before ends with the value that was added to this one, less one.
            base = np.where(begin > 0, self.words.at(np.maximum(begin, 1) - 1) + np.uint64(1), np.uint64(0))
            out[some] = self.words.find(word[some].astype(np.uint64) + base, begin, end)
        return out


@dataclass
class Trie:
    """A shard, or the whole, of a model: N, V, words by hash with counts and back-off weights, levels of longer n-grams."""

    tokens: int
    vocabulary: int
    keys: EliasFano
    count: np.ndarray
    back: np.ndarray
    levels: list[Level] = field(default_factory=list)

    def unigram(self, count: np.ndarray | float) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + 1.0 * (self.vocabulary + 1)))

    def log_probs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """log10 of the probability of word c after words a and b (word numbers; -1: none), in steps of 1/2048."""
        two, three = self.levels
        n = len(self.count)
        out = quantise(self.unigram(np.where(c >= 0, self.count[np.maximum(c, 0)], 0) if n else np.zeros(len(c)))).astype(np.int32)
        out += np.where(b >= 0, self.back[np.maximum(b, 0)], 0) if n else 0
        if two.words.n:
            pair = two.find(b, c)
            out = np.where(pair >= 0, two.prob[np.maximum(pair, 0)], out)
            size = np.int64(n + 1)
            left, of = np.unique((a + 1) * size + b + 1, return_inverse=True)
            context = two.find(left // size - 1, left % size - 1)[of]
            out = out + np.where(context >= 0, two.back[np.maximum(context, 0)], 0)
            at = three.find(context, c)
            if three.words.n:
                out = np.where(at >= 0, three.prob[np.maximum(at, 0)], out)
        return out.astype(np.int32)

    def packed(self) -> bytes:
        """All arrays end to end, after a header that says where each is."""
        arrays = {f"keys.{k}": v for k, v in self.keys.parts().items()} | {"count": self.count, "back": self.back, "size": np.array([self.tokens, self.vocabulary, len(self.levels)])}
        for i, level in enumerate(self.levels):
            arrays |= {f"{i}.pointers.{k}": v for k, v in level.pointers.parts().items()} | {f"{i}.words.{k}": v for k, v in level.words.parts().items()}
            arrays |= {f"{i}.prob": level.prob, f"{i}.back": level.back}
        at, index = 0, {}
        for k, v in arrays.items():
            index[k] = (at, v.dtype.str, len(v))
            at += -(-v.nbytes // 8) * 8
        head = json.dumps(index).encode()
        return b"".join([len(head).to_bytes(8, "little") + head + b" " * (-len(head) % 8), *[v.tobytes() + b"\0" * (-v.nbytes % 8) for v in arrays.values()]])

    def save(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.packed())

    @staticmethod
    def load(path: str) -> Trie:
        """The saved model, mapped: pages of the file are read as queries touch them."""
        return Trie.unpacked(np.memmap(path, np.uint8, mode="r"))

    @staticmethod
    def unpacked(raw: np.ndarray) -> Trie:
        n = int(raw[:8].view("<u8")[0])
        index, base = json.loads(raw[8 : 8 + n].tobytes()), 8 + n + (-n % 8)

        def part(k: str) -> np.ndarray:
            at, kind, size = index[k]
            return raw[base + at : base + at + size * np.dtype(kind).itemsize].view(kind)

        def sequence(k: str) -> EliasFano:
            return EliasFano.from_parts({x: part(f"{k}.{x}") for x in (*EliasFano.PARTS, "size")})

        tokens, vocabulary, levels = part("size").tolist()
        made = [Level(sequence(f"{i}.pointers"), sequence(f"{i}.words"), part(f"{i}.prob"), part(f"{i}.back")) for i in range(levels)]
        return Trie(tokens, vocabulary, sequence("keys"), part("count"), part("back"), made)


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token, ends included, and the number of its text."""
    w = words(*flat(column))
    n = len(w.count)
    h = np.empty(len(w.hash) + n, np.uint64)
    ends = w.first[1:] + np.arange(n)
    inside = np.ones(len(h), bool)
    inside[ends] = False
    h[ends], h[inside] = END, w.hash
    return h, np.repeat(np.arange(n), w.count + 1)


class _Counts:
    """Counts of integer keys, merged whenever many have come together."""

    LIMIT = 1 << 22

    def __init__(self) -> None:
        self.keys, self.counts, self.loose = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.loose += len(k)
        if self.loose > self.LIMIT:
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.keys) > 1:
            k, at = np.unique(np.concatenate(self.keys), return_inverse=True)
            self.counts = [np.bincount(at, np.concatenate(self.counts)).astype(np.int64)]
            self.keys = [k]
        self.loose = 0 if not self.keys else max(0, len(self.keys[0]) - self.LIMIT // 2)
        return (self.keys[0], self.counts[0]) if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def batches(self, size: int = 1 << 17) -> Iterator[pa.RecordBatch]:
        k, n = self.merged()
        for i in range(0, len(k), size):
            yield pa.RecordBatch.from_arrays([pa.array(k[i : i + size].astype(np.int64, copy=False)), pa.array(n[i : i + size].astype(np.int64))], names=["k", "c"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = _Counts()
    for batch in batches:
        for run in slices(batch):
            counts.add(tokens_of(run.column("text"))[0].view(np.int64))
    yield from counts.batches()


@dataclass
class Vocabulary:
    """N, V, and the frequent words: by hash their rank, by rank their count; a word's number is its rank plus one."""

    tokens: int
    size: int
    hash: np.ndarray
    rank: np.ndarray
    count: np.ndarray

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, 0 where it is not frequent."""
        if not len(self.hash):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        return np.where(self.hash[at] == h, self.rank[at] + 1, 0).astype(np.int64)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1.0) / (self.tokens + 1.0 * (self.size + 1)))

    def hashes(self) -> np.ndarray:
        """The hash of each number; that of 0 is START."""
        out = np.zeros(len(self.hash) + 1, np.uint64)
        out[self.rank + 1] = self.hash
        return out


@dataclass
class Shards:
    """How words are dealt: `cut[k]` is the first shard of word number k and `parts[k]` how many it has, 1 being the usual."""

    usual: int
    cut: np.ndarray
    parts: np.ndarray

    @staticmethod
    def plan(vocabulary: Vocabulary, shard_tokens: int) -> Shards:
        hashes = vocabulary.hashes()
        large = np.flatnonzero(vocabulary.count > shard_tokens) + 1
        large = large[hashes[large] != END]
        parts = np.ones(int(large.max(initial=0)) + 1, np.int64)
        parts[large] = vocabulary.count[large - 1] // shard_tokens + 1
        usual = (vocabulary.tokens - int(vocabulary.count[large - 1].sum())) // shard_tokens + 1
        more = np.where(parts > 1, parts, 0)
        return Shards(usual, usual + np.cumsum(more) - more, parts)

    @property
    def number(self) -> int:
        return self.usual + int(self.parts[self.parts > 1].sum())

    def large(self, b: np.ndarray) -> np.ndarray:
        return self.parts[np.where(b < len(self.parts), b, 0)] > 1

    def of(self, b: np.ndarray, hash_a: np.ndarray, hash_b: np.ndarray) -> np.ndarray:
        """The shard of each trigram; first tokens of a text (b is 0) have their own hash for that of b."""
        out = (mix(hash_b) % np.uint64(self.usual)).astype(np.int64)
        large = np.flatnonzero(self.large(b))
        k = b[large]
        out[large] = self.cut[k] + (mix(hash_a[large]) % self.parts[k].astype(np.uint64)).astype(np.int64)
        return out


def _pair(b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """A hash of each pair of word hashes."""
    return mix(mix(b) * _ODD + c)


@dataclass
class _Block:
    """Tokens of whole texts as trigrams: word numbers, hashes, shards, and the number of the text of each."""

    a: np.ndarray
    b: np.ndarray
    c: np.ndarray
    hash_b: np.ndarray
    hash_c: np.ndarray
    row: np.ndarray
    shard: np.ndarray
    rare: np.ndarray

    @staticmethod
    def of(h: np.ndarray, row: np.ndarray, vocabulary: Vocabulary, shards: Shards) -> _Block:
        c = vocabulary.numbers(h)
        rare = np.flatnonzero(c == 0)
        known, c[rare] = np.unique(h[rare], return_inverse=True)
        c[rare] += len(vocabulary.hash) + 1
        first = np.r_[True, row[1:] != row[:-1]]
        second = first | np.r_[True, first[:-1]]
        back = lambda x, k: np.r_[x[:k], x[:-k]] if len(x) > k else x.copy()
        b, a = np.where(first, 0, back(c, 1)), np.where(second, 0, back(c, 2))
        hash_b = np.where(first, START, back(h, 1))
        shard = shards.of(b, np.where(second, START, back(h, 2)), np.where(first, h, hash_b))
        return _Block(a, b, c, hash_b, h, row, shard, known)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """Token hashes, row numbers and rows, for about BLOCK_TOKENS at a time."""
    h, row, rows, n, size = [], [], [], 0, 0
    for batch in batches:
        for run in slices(batch):
            x, doc = tokens_of(run.column("text"))
            h.append(x)
            row.append(doc + n)
            rows.append(run.drop_columns(["text"]))
            n, size = n + run.num_rows, size + len(x)
            if size >= BLOCK_TOKENS:
                yield np.concatenate(h), np.concatenate(row), pa.Table.from_batches(rows).combine_chunks()
                h, row, rows, n, size = [], [], [], 0, 0
    if n:
        yield np.concatenate(h), np.concatenate(row), pa.Table.from_batches(rows).combine_chunks()


def _pairs(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, shards: Shards) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs that begin with a cut word."""
    for h, row, _ in _blocks(batches):
        t = _Block.of(h, row, vocabulary, shards)
        some = np.flatnonzero(shards.large(t.b))
        k, at, n = np.unique(_pair(t.hash_b[some], t.hash_c[some]), return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k.view(np.int64), t.b[some[at]], t.hash_c[some[at]].view(np.int64), n.astype(np.int64))], names=["k", "b", "w", "c"])


def _needed(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, shards: Shards) -> Iterator[pa.RecordBatch]:
    """The counts that each shard is to be sent: of words that are not frequent, and of pairs after cut words."""
    for h, row, _ in _blocks(batches):
        t = _Block.of(h, row, vocabulary, shards)
        rare, large = np.flatnonzero(t.c > len(vocabulary.hash)), np.flatnonzero(shards.large(t.b))
        k = np.r_[t.hash_c[rare], _pair(t.hash_b[large], t.hash_c[large])]
        shard = t.shard[np.r_[rare, large]]
        rank = np.argsort(k * _ODD + shard.astype(np.uint64))
        k, shard = k[rank], shard[rank]
        new = np.r_[True, (k[1:] != k[:-1]) | (shard[1:] != shard[:-1])][: len(k)]
        yield pa.RecordBatch.from_arrays([pa.array(shard[new].astype(np.int32)), pa.array(k[new].view(np.int64))], names=["shard", "k"])


_CODEC = pa.Codec("zstd", compression_level=3)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers of 0 or more, by planes of bytes, compressed."""
    head, body = [len(arrays)], []
    for x in arrays:
        x = np.ascontiguousarray(x, np.min_scalar_type(int(x.max(initial=0))).newbyteorder("<"))
        head += [len(x), x.itemsize]
        body.append(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    raw = np.array(head, "<i8").tobytes() + b"".join(body)
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True)


def _unpack(body: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(_CODEC.decompress(body[8:], int.from_bytes(body[:8], "little"), asbytes=True), np.uint8)
    n = int(raw[:8].view("<i8")[0])
    sizes = raw[8 : 8 + 16 * n].view("<i8").reshape(n, 2).tolist()
    at, out = 8 + 16 * n, []
    for length, width in sizes:
        planes = raw[at : at + length * width].reshape(width, length)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(f"<u{width}") if length else np.zeros(0, np.uint64))
        at += length * width
    return out


_NAMES = ["shard", "block", "learn", "row", "key", "n_tokens", "n_known", "base", "body", "k", "c"]


def _batch(kind: pa.DataType, n: int, **columns: pa.Array) -> pa.RecordBatch:
    types = dict(zip(_NAMES, (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), kind, pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.int64(), pa.int64()), strict=True))
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in types.items()], names=_NAMES)


def _ask(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, shards: Shards, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """A row for each text, with what frequent words give, and the trigrams of each block of texts by shard."""
    one = vocabulary.unigram(np.r_[0, vocabulary.count])
    place = TaskContext.get().partitionId() << 32
    for block, (h, row, rows) in enumerate(_blocks(batches)):
        t, n = _Block.of(h, row, vocabulary, shards), rows.num_rows
        number = pa.array(np.full(n, place + block))
        known = t.c <= len(vocabulary.hash)
        base = np.bincount(row, np.where(known, one[np.where(known, t.c, 0)], 0.0), n)
        yield _batch(kind, n, shard=pa.array(np.full(n, (TaskContext.get().partitionId() + block) % shards.number, np.int32)), block=number, row=pa.array(np.arange(n, dtype=np.int32)), key=rows.column("key").combine_chunks(), n_tokens=pa.array(np.bincount(row, minlength=n).astype(np.int64)), n_known=pa.array(np.bincount(row, known, n).astype(np.int64)), base=pa.array(base))
        learn = rows.column("learn").to_numpy().astype(np.int64)
        part = t.shard * 2 + learn[row]
        rank = np.argsort(part << 32 | t.b)
        part = part[rank]
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            p = rank[i:j]
            a, b, c, rare = t.a[p], t.b[p], t.c[p], len(vocabulary.hash)
            # Only the words of this part that are not frequent go with it, by hash.
            mine, of = np.unique(np.concatenate([x[x > rare] for x in (a, b, c)]), return_inverse=True)
            at = 0
            for x in (a, b, c):
                m = x > rare
                x[m] = rare + 1 + of[at : at + m.sum()]
                at += m.sum()
            body = _pack(t.rare[mine - rare - 1], a, np.diff(b, prepend=0), c, row[p])
            yield _batch(kind, 1, shard=pa.array([part[i] >> 1], pa.int32()), block=number[:1], learn=pa.array([bool(part[i] & 1)]), body=pa.array([body], pa.binary()))


def _back_off(context: np.ndarray, contexts: int, prob: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """log10 of the share left after each context over what the shorter contexts give to the rest."""
    kept = np.bincount(context, prob, minlength=contexts)
    below = np.bincount(context, lower, minlength=contexts)
    return np.log10(np.maximum(1 - kept, 1e-9) / np.maximum(1 - below, 1e-9))


def build(tokens: int, vocabulary: int, hashes: np.ndarray, count: np.ndarray, seen: tuple[np.ndarray, ...], pairs: tuple[np.ndarray, ...] | None = None, follow: np.ndarray | None = None, back: np.ndarray | None = None, discount: float = DISCOUNT) -> Trie:
    """The trie of trigrams (a, b, c, times): words by number in the order of `hashes`, each trigram once, a of -1 before the text.

    `pairs` (b, c, times) are those that begin with a cut word, where trigrams do not tell how often a pair stands;
    `follow` and `back` then say how often each word has a next one, and its back-off weight (nan: as trigrams say).
    """
    a, b, c, times = seen
    size, n = np.int64(max(1, len(hashes))), len(hashes)
    trie = Trie(tokens, vocabulary, EliasFano.of(hashes), count, np.zeros(n, np.int16))
    right, of = np.unique(b * size + c, return_inverse=True)
    number = np.bincount(of, times, len(right))
    total = np.bincount(b, times, n)
    if pairs is not None:
        cut = follow > 0
        keep = ~cut[right // size]
        key = np.r_[right[keep], pairs[0] * size + pairs[1]]
        number = np.r_[number[keep], pairs[2]]
        rank = np.argsort(key)
        right, number = key[rank], number[rank]
        total = np.where(cut, follow, total)
    x, y = right // size, right % size
    prob = (number - discount) / total[x]
    weight = _back_off(x, n, prob, 10.0 ** trie.unigram(count[y])) if n else np.zeros(0)
    trie.back = quantise(weight if back is None else np.where(np.isnan(back), weight, back))
    whole = np.flatnonzero(a >= 0)
    left = a[whole] * size + b[whole]
    both = _distinct_sorted(np.r_[right, left])
    log = np.zeros(len(both))
    log[np.searchsorted(both, right)] = np.log10(prob)
    context = np.searchsorted(both, left)
    p3 = (times[whole] - discount) / np.bincount(context, times[whole], len(both))[context]
    lower = prob[of[whole] if pairs is None else np.searchsorted(right, b[whole] * size + c[whole])]
    two = Level.of(both // size, both % size, n, log, _back_off(context, len(both), p3, lower) if len(both) else log)
    rank = np.argsort(context * size + c[whole])
    trie.levels = [two, Level.of(context[rank], c[whole][rank], len(both), np.log10(p3[rank]), np.zeros(0))]
    return trie


def _distinct(a: np.ndarray, b: np.ndarray, c: np.ndarray, n: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Equal trigrams of numbers from -1 to n - 1 once, and of which each given one is."""
    size = np.int64(n + 1)
    if float(size) ** 3 < 2.0**62:
        key, of = np.unique(((b + np.int64(1)) * size + a + 1) * size + c + 1, return_inverse=True)
        out = key // size % size - 1, key // size // size - 1, key % size - 1
    else:
        pair, at = np.unique((b + np.int64(1)) * size + a + 1, return_inverse=True)
        key, of = np.unique(at * size + c + 1, return_inverse=True)
        out = pair[key // size] % size - 1, pair[key // size] // size - 1, key % size - 1
    return out, of


def _answer(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary, shards: Shards, backs: dict[int, float], kind: pa.DataType, where: str | None, discount: float) -> Iterator[pa.RecordBatch]:
    """Learns each shard, maps it, and gives the sums of every text of its questions; rows of texts pass."""
    pieces: dict[int, list[tuple[int, bool, bytes]]] = {}
    counts: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        text = pc.is_valid(batch.column("row"))
        if pc.any(text).as_py():
            yield batch.filter(text)
        given = batch.filter(pc.is_valid(batch.column("k")))
        if given.num_rows:
            s, k, c = (given.column(x).to_numpy() for x in ("shard", "k", "c"))
            for shard in np.unique(s).tolist():
                counts.setdefault(shard, []).append(np.stack([k[s == shard], c[s == shard]]))
        asked = batch.filter(pc.is_valid(batch.column("body")))
        for s, block, learn, body in zip(*[asked.column(x).to_pylist() for x in ("shard", "block", "learn", "body")], strict=True):
            pieces.setdefault(s, []).append((block, learn, body))
    for shard, mine in pieces.items():
        given = np.concatenate(counts.pop(shard, [np.zeros((2, 0), np.int64)]), axis=1)
        yield from _shard(shard, mine, given, vocabulary, shards, backs, kind, where, discount)


def _shard(shard: int, pieces: list[tuple[int, bool, bytes]], given: np.ndarray, vocabulary: Vocabulary, shards: Shards, backs: dict[int, float], kind: pa.DataType, where: str | None, discount: float) -> Iterator[pa.RecordBatch]:
    rank = np.argsort(given[0].view(np.uint64))
    given_key, given_count = given[0].view(np.uint64)[rank], given[1][rank]

    def counted(h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(given_key, h), max(0, len(given_key) - 1))
        return np.where(given_key[at] == h, given_count[at], 0) if len(given_key) else np.zeros(len(h), np.int64)

    frequent = len(vocabulary.hash)
    opened = [(block, learn, *_unpack(body)) for block, learn, body in pieces]
    pieces.clear()
    rare = _distinct_sorted(np.concatenate([x[2].astype(np.uint64) for x in opened]))
    hashes = np.r_[vocabulary.hashes(), rare]
    used = np.zeros(len(hashes), bool)
    parts, codes_of = [], ([], [], [])
    while opened:
        block, learn, own, *three, row = opened.pop()
        place = np.searchsorted(rare, own.astype(np.uint64))
        three[1] = np.cumsum(three[1], dtype=np.int64)
        for x, out in zip(three, codes_of, strict=True):
            x = x.astype(np.int32)
            m = x > frequent
            x[m] = frequent + 1 + place[x[m] - frequent - 1]
            used[x] = True
            out.append(x)
        parts.append((block, learn, row))
    used[0] = False
    codes = np.flatnonzero(used)
    codes = codes[np.argsort(hashes[codes])]
    local = np.full(len(hashes), -1, np.int32)
    local[codes] = np.arange(len(codes))
    plain = codes <= frequent
    count = np.zeros(len(codes), np.int64)
    count[plain] = vocabulary.count[codes[plain] - 1]
    count[~plain] = counted(hashes[codes[~plain]])

    sizes = [len(x[2]) for x in parts]
    a, b, c = (local[np.concatenate(x)] for x in codes_of)
    codes_of = None
    learn = np.repeat([x[1] for x in parts], sizes)
    (ua, ub, uc), of = _distinct(a, b, c, len(codes))
    del a, b
    times = np.bincount(of[learn], minlength=len(ua))
    seen = np.flatnonzero((times > 0) & (ub >= 0))
    pairs = follow = back = None
    if shard >= shards.usual:
        follow, back = np.zeros(len(codes)), np.full(len(codes), np.nan)
        word = int(codes[ub[0]])
        own = int(ub[0])
        follow[own], back[own] = vocabulary.count[word - 1], backs[word]
        next_ = _distinct_sorted(uc)
        number = counted(_pair(np.full(len(next_), hashes[word]), hashes[codes[next_]]))
        next_, number = next_[number > 0], number[number > 0]
        pairs = np.full(len(next_), own), next_, number
    trie = build(vocabulary.tokens, vocabulary.size, hashes[codes], count, (ua[seen], ub[seen], uc[seen], times[seen]), pairs, follow, back, discount)
    path = None
    if where:
        os.makedirs(where, exist_ok=True)
        path = f"{where}/shard-{shard}-{uuid.uuid4().hex}.trie"
        trie.save(path)
    try:
        trie = Trie.load(path) if path else Trie.unpacked(np.frombuffer(trie.packed(), np.uint8))
        log = np.concatenate([trie.log_probs(*[x[i : i + (1 << 18)] for x in (ua, ub, uc)]) for i in range(0, len(ua), 1 << 18)])
        score = log[of]
    finally:
        trie = None
        if path:
            os.unlink(path)
    at = 0
    for (block, _, row), n in zip(parts, sizes, strict=True):
        rows, to = np.unique(row, return_inverse=True)
        total = -np.bincount(to, score[at : at + n], len(rows))
        words_ = c[at : at + n]
        # Sums are at most 0 but for rounding, in whole steps; of words that are not frequent the counts go.
        other = np.flatnonzero(~plain[words_])
        other = other[np.argsort(to[other], kind="stable")]
        low = int(min(0, total.min()))
        body = _pack(np.array([-low]), np.diff(rows.astype(np.int64), prepend=0), (total - low).astype(np.int64), np.diff(to[other], prepend=0), count[words_[other]])
        yield _batch(kind, 1, block=pa.array([block], pa.int64()), body=pa.array([body], pa.binary()))
        at += n


def _sum(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[pa.RecordBatch]:
    """One row for each text, from the rows and the sums of its block; rows come in the order of blocks."""

    def made(rows: pa.Table, bodies: list[bytes]) -> pa.RecordBatch:
        rows = rows.sort_by("row").combine_chunks()
        score = np.zeros(rows.num_rows, np.int64)
        known, base = rows["n_known"].to_numpy().copy(), rows["base"].to_numpy().copy()
        for body in bodies:
            low, step, total, of, seen = _unpack(body)
            at = np.cumsum(step.astype(np.int64))
            score[at] -= total.astype(np.int64) - int(low[0])
            of, seen = at[np.cumsum(of.astype(np.int64))] if len(of) else np.zeros(0, np.int64), seen.astype(np.int64)
            known += np.bincount(of, seen > 0, rows.num_rows).astype(np.int64)
            base += np.bincount(of, vocabulary.unigram(seen), rows.num_rows)
        out = [rows["key"].combine_chunks(), rows["n_tokens"].combine_chunks(), pa.array(known), pa.array(base), pa.array(score / _GRID)]
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names=["key", "n_tokens", "n_known", "base_score", "score"])

    now, rows, bodies = None, [], []
    for batch in batches:
        block = batch.column("block").to_numpy()
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True][: len(block) + 1]) if len(block) else []
        for i, j in zip(edge[:-1], edge[1:], strict=False):
            part = batch.slice(int(i), int(j - i))
            if block[i] != now:
                if rows:
                    yield made(pa.Table.from_batches(rows), bodies)
                now, rows, bodies = block[i], [], []
            text = pc.is_valid(part.column("row"))
            rows.append(part.filter(text))
            bodies += part.filter(pc.invert(text)).column("body").to_pylist()
    if rows:
        yield made(pa.Table.from_batches(rows), bodies)


def vocabulary_of(texts: DataFrame, level_bits: int = LEVEL_BITS) -> tuple[DataFrame, Vocabulary]:
    """The table (k, c) of the counts of all words of a column `text` by hash, and the frequent ones."""
    table = held(texts.mapInArrow(_count_words, "k long, c long").groupBy("k").agg(F.sum("c").alias("c")))
    # Words by size of their count, in eighths of powers of two: a few hundred rows at most.
    steps = table.groupBy(F.floor(F.log2("c") * 8).alias("step")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).orderBy(F.desc("step")).collect()
    taken, least = 0, None
    for r in steps:
        taken += r["v"]
        if taken > 1 << level_bits:
            break
        least = r["step"]
    top = table.where(F.floor(F.log2("c") * 8) >= (least if least is not None else 1 << 20)).toArrow()  # 2^level_bits rows at most
    h, c = top["k"].to_numpy().view(np.uint64), top["c"].to_numpy().astype(np.int64)
    rank = np.lexsort([h, -c])
    h, c = h[rank], c[rank]
    order = np.argsort(h)
    return table, Vocabulary(sum(r["n"] for r in steps), sum(r["v"] for r in steps), h[order], order.astype(np.int32), c)


def _cut_backs(pairs: DataFrame, table: DataFrame, vocabulary: Vocabulary, discount: float) -> dict[int, float]:
    """The back-off weight of each cut word: a row each, of which there are N / `shard_tokens` at most."""
    share = (F.col("n") + 1) / F.lit(vocabulary.tokens + 1.0 * (vocabulary.size + 1))
    after = pairs.select("b", F.col("w").alias("k")).join(table.withColumnRenamed("c", "n"), "k")
    rows = after.groupBy("b").agg(F.count("*").alias("kinds"), F.sum(share).alias("below")).collect()
    left = {r["b"]: discount * r["kinds"] / vocabulary.count[r["b"] - 1] for r in rows}
    return {r["b"]: float(np.log10(max(left[r["b"]], 1e-9) / max(1 - r["below"], 1e-9))) for r in rows}


def scores(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", level_bits: int = LEVEL_BITS, shard_tokens: int = SHARD_TOKENS, discount: float = DISCOUNT) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of every row, under the model of the rows where `learn` holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    trained = rows.where("learn").select("text")
    table, vocabulary = vocabulary_of(trained, level_bits)
    shards = Shards.plan(vocabulary, shard_tokens)
    model = spark.sparkContext.broadcast((vocabulary, shards))
    given, backs = table, {}
    if shards.number > shards.usual:
        pairs = held(trained.mapInArrow(lambda b: _pairs(b, *model.value), "k long, b long, w long, c long").groupBy("k", "b", "w").agg(F.sum("c").alias("c")))
        backs = _cut_backs(pairs, table, vocabulary, discount)
        given = table.unionByName(pairs.select("k", "c"))
    needed = rows.select("text").mapInArrow(lambda b: _needed(b, *model.value), "shard int, k long").distinct().join(given, "k")
    key_type = rows.schema["key"].dataType
    kind = to_arrow_type(key_type)
    schema = f"shard int, block long, learn boolean, row int, key {key_type.simpleString()}, n_tokens long, n_known long, base double, body binary, k long, c long"
    asked = rows.mapInArrow(lambda b: _ask(b, *model.value, kind), schema)
    # Files that tasks can map lie in a folder of the shared one, if that is a mounted one.
    base = urlparse(folder(spark))
    where = f"{base.path}/trie-{uuid.uuid4().hex}" if base.scheme in ("", "file") else None
    both = asked.unionByName(needed, allowMissingColumns=True).repartitionById(shards.number, F.col("shard"))
    sums = both.mapInArrow(lambda b: _answer(b, *model.value, backs, kind, where, discount), schema).drop("shard", "learn", "k", "c")
    summed = sums.repartition("block").sortWithinPartitions("block").mapInArrow(lambda b: _sum(b, model.value[0]), f"key {key_type.simpleString()}, n_tokens long, n_known long, base_score double, score double")
    return summed.select(F.col("key").alias(key), "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_ngram_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = scores(docs, crc_remainder("doc_id", FOLDS) != HELD_OUT)
    return out.select("doc_id", F.coalesce(crc_remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
