"""Vectorised byte-level text primitives shared by the Arrow-backed operators.

Everything works on a *chunk*: the UTF-8 bytes of several texts laid end to end
with their offsets.  A chunk holds about ``CHUNK_BYTES`` (or one longer text), so
a Python worker's memory is bounded by the longest single text, not by the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: The separators of the word pattern [^\x20\x09-\x0D]+.
SEPARATORS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**64 - 1, 256, dtype=np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if len(_powers["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for key, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(data: np.ndarray) -> np.ndarray:
    """Prefix sums s with hash(data[a:b]) = mix((s[b] - s[a]) * base**-a)."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


@dataclass
class Words:
    """Words of a chunk: byte span, owning text, and per text the first word's index."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more entry than texts

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


@dataclass
class Chunk:
    rows: slice
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more entry than texts

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self) -> np.ndarray:
        return LOWER[self.data]

    def words(self) -> Words:
        solid = ~IS_SPACE[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        before = np.empty_like(solid)
        before[:1] = True
        before[1:] = ~solid[:-1]
        before |= edge[:-1]
        after = np.empty_like(solid)
        after[-1:] = True
        after[:-1] = ~solid[1:]
        after |= edge[1:]
        starts = np.flatnonzero(solid & before)
        return Words(starts, np.flatnonzero(solid & after) + 1, np.searchsorted(starts, self.offsets))

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many of the chunk's bytes are flagged, per text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return np.diff(total[self.offsets])


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Chunks of a string column; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        a, b = int(offsets[at]), int(offsets[to])
        yield Chunk(slice(at, to), data[a:b], offsets[at : to + 1] - a)
        at = to


def word_hashes(chunk: Chunk, words: Words, lower: bool) -> np.ndarray:
    data = chunk.lowered() if lower else chunk.data
    return span_hashes(rolling(data), words.starts, words.ends)


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; entry i covers words i to i+n-1."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[k : k + count]
    return mix(out)


def grams_of(first: np.ndarray, row: int, n: int) -> tuple[int, int]:
    """Range of gram indices that lie inside one text."""
    a, b = int(first[row]), int(first[row + 1])
    return a, max(a, b - n + 1)
