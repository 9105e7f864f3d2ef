"""Vectorised tokenising and hashing of Arrow text batches.

Every operator that looks at all words of a corpus works on these arrays: one
numpy pass over the UTF-8 bytes of a batch finds the words and hashes each to
64 bits, so no per-word Python object is ever made.  Hashes do not depend on
the process, the batch or the position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = 0xD6E8FEB86659FD93

#: Bytes of text that one numpy pass handles at a time.
SLICE_BYTES = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing
LETTER_WORDS = np.zeros(256, dtype=bool)
LETTER_WORDS[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_tables: dict[str, np.ndarray] = {}


def _powers(name: str, base: int, n: int) -> np.ndarray:
    held = _tables.get(name)
    if held is None or len(held) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        held = _tables[name] = np.multiply.accumulate(steps)
    return held


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `limit` bytes of text; a longer text is a run of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = (np.cumsum(size) - 1) // limit
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


@dataclass
class Words:
    """Words of a run of texts: byte range, text number and hash of each; `first[i]` is where text i begins."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray = SPACE_WORDS, lower: bool = True) -> Words:
    n = len(data)
    low = LOWER[data] if lower else data
    inside = is_word[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    up, down = _powers("up", _P, n + 1), _powers("down", _P_INV, n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    hashed = mix((total[end] - total[start]) * down[start])
    first = np.searchsorted(start, at)
    return Words(start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), hashed, first)


def join_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each `width` neighbours, in order."""
    if len(h) < width:
        return np.zeros(0, dtype=np.uint64)
    out, factor = np.zeros(len(h) - width + 1, dtype=np.uint64), _powers("join", _Q, width)
    for i in range(width):
        out += h[i : len(h) - width + 1 + i] * factor[i]
    return mix(out + np.uint64(width))
