"""Vectorised text primitives shared by the training-data operators.

All functions work on one Arrow string column at a time.  Texts stay UTF-8
bytes; a *block* is a run of whole texts of about ``BLOCK_BYTES`` (one long text
makes a block of its own), so that temporary arrays stay bounded while no text
is ever cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE_KEY = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WINDOW_KEY = _rng.integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_RADIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public-domain splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n, _RADIX, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = powers(256)


@dataclass
class Block:
    """Whole texts ``first .. first + len(starts) - 1`` of a column, as bytes.

    ``offsets`` has one entry more than there are texts.  ``word_start`` and
    ``word_end`` bound the words, runs of bytes that ``between`` does not mark
    (``[^\\x20\\x09-\\x0D]+`` by default); ``word_offsets`` gives each
    text's run of words.
    """

    first: int
    data: np.ndarray
    offsets: np.ndarray
    between: np.ndarray = field(default_factory=lambda: _SPACE)

    def __post_init__(self) -> None:
        solid = ~self.between[self.data]
        n = len(self.data)
        opens, closes = solid.copy(), solid.copy()
        if n:
            edge = self.offsets[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            joined = solid[:-1] & solid[1:]
            joined[edge - 1] = False
            opens[1:] &= ~joined
            closes[:-1] &= ~joined
        self.solid = solid
        self.word_start = np.flatnonzero(opens)
        self.word_end = np.flatnonzero(closes) + 1
        self.word_offsets = np.searchsorted(self.word_start, self.offsets)

    def word_hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash per word (a keyed polynomial over its bytes)."""
        if not len(self.word_start):
            return np.zeros(0, dtype=np.uint64)
        data = (_LOWER[self.data] if lower else self.data)[self.solid]
        length = self.word_end - self.word_start
        at = np.cumsum(length) - length
        place = np.arange(len(data)) - np.repeat(at, length)
        longest = int(length.max())
        table = _POWERS if longest <= len(_POWERS) else powers(longest)
        value = _BYTE_KEY[data] * table[place]
        return mix64(np.add.reduceat(value, at) + length.astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64, count=n + column.offset + 1)[column.offset :]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(column: pa.Array, between: np.ndarray = _SPACE) -> Iterator[Block]:
    data, offsets = text_bytes(column)
    n, first = len(offsets) - 1, 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, side="right")) - 1
        last = min(max(last, first + 1), n)
        own = offsets[first : last + 1]
        yield Block(first, data[own[0] : own[-1]], own - own[0], between)
        first = last


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:n] * _WINDOW_KEY[0]
    for i in range(1, size):
        out = out + words[i : i + n] * _WINDOW_KEY[i]
    return mix64(out + np.uint64(size))


def shingle_sets(block: Block, size: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block.

    A text with fewer than ``size`` words has one shingle, its whole sequence; a
    text without words has none.
    """
    words = block.word_hashes(lower=True)
    all_windows = windows(words, size)
    for a, b in zip(block.word_offsets[:-1], block.word_offsets[1:], strict=True):
        if b - a >= size:
            yield np.unique(all_windows[a : b - size + 1])
        elif b > a:
            yield windows(words[a:b], int(b - a))
        else:
            yield np.zeros(0, dtype=np.uint64)


def set_digest(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()
