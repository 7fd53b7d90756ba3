"""Token ids of whole texts from a public tokenizer file.

A byte-level tokenizer cuts a text into pretokens before it merges bytes.  A word
behind a single space is a stretch of pretokens that begins with the space; behind
newlines these come first, then the word without a space; and a full stop or comma
behind a letter is a pretoken of its own if it ends the word.  So the ids of a text
follow from those of its words.  Each distinct word is encoded by the ``tokenizers``
library once a worker and looked up by a 96-bit hash from then on, for all words of
a block at once.  Texts with other runs of blanks are encoded whole.

Whether the short cut gives what the whole tokenizer gives is tried on fixed probes
when a file is loaded; if it does not, all texts are encoded whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from mobilis.llm.text import Block, blocks, mix64, powers

#: Words that a worker remembers (some 60 bytes each); then it starts anew.
MEMO_WORDS = 1_500_000
_SLOT_BITS = 22
#: Bytes of the longest words that are looked up.
_LONGEST = 64
#: Texts on which the short cut must agree with the whole tokenizer.
_PROBES = [
    "It's 1st, we're O'Neil's; (x)=y_2! \"quoted.\" don't 'tis a.b, c,d .e ,f ... g., h,.",
    "naïve cafés, École. Über-straße Łódź. ño? ×, ÷. », 5².",
    "one\ntwo, three.\nFour 中文 русский, \U0001f600. end...\n\n(five) a",
    "The THE the thethe x9 9x, 9. ́a áb ª, × A.B.C. e-mail@x.org, 3.14 $5 #tag",
    "\n\nab, \n cd\tef  gh .\n",
    "a",
    ",",
]
ID = np.dtype("<u4")

_BYTE_KEYS = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: Byte-level vocabularies write bytes that do not print as the letters from U+0100 on, in order.
_PRINT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LETTERS = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINT)}
#: What stands before a word: nothing, a space, one newline or two.
_BARE, _SPACED, _LINE, _PARAGRAPH = range(4)
_BEFORE = ["", " ", "\n", "\n\n"]
_STRIDE = 1 << 20


def _inverse(x: np.ndarray) -> np.ndarray:
    """Inverses of odd numbers modulo 2**64, by Newton's iteration."""
    y = x.copy()
    for _ in range(6):
        y = y * (np.uint64(2) - x * y)
    return y


@lru_cache(maxsize=1)
def _radix() -> tuple[np.ndarray, np.ndarray]:
    up = powers(_STRIDE + _LONGEST)
    return up, _inverse(up)


def _spans_hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A polynomial hash of each span of bytes; spans are in order and at most ``_LONGEST`` long."""
    up, down = _radix()
    out = np.empty(len(start), dtype=np.uint64)
    for base in range(0, len(data), _STRIDE):
        a, b = np.searchsorted(start, [base, base + _STRIDE])
        own = data[base : base + _STRIDE + _LONGEST]
        total = np.zeros(len(own) + 1, dtype=np.uint64)
        np.cumsum(key[own] * up[: len(own)], out=total[1:])
        s, e = start[a:b] - base, end[a:b] - base
        out[a:b] = (total[e] - total[s]) * down[s]
    return mix64(out + (end - start).astype(np.uint64))


class _Memo:
    """An open hash table from 96-bit hashes to runs of ids."""

    def __init__(self) -> None:
        self.mask, self.shift = (1 << _SLOT_BITS) - 1, np.uint64(64 - _SLOT_BITS)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << _SLOT_BITS, dtype=np.uint64)
        self.checks = np.zeros(1 << _SLOT_BITS, dtype=np.uint32)
        self.rows = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        self.ids, self.starts, self.lengths = (np.zeros(1 << 16, dtype=t) for t in (ID, np.int64, np.int32))
        self.n = self.used = 0

    def find(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The row of each key, -1 if there is none."""
        slot = (key >> self.shift).astype(np.int64)
        out = np.full(len(key), -1, dtype=np.int32)
        left = np.arange(len(key))
        while len(left):
            at = slot[left]
            held = self.keys[at]
            same = (held == key[left]) & (self.checks[at] == check[left])
            out[left[same]] = self.rows[at[same]]
            go = (held != 0) & ~same
            left = left[go]
            slot[left] = (at[go] + 1) & self.mask
        return out

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[bytes]) -> None:
        """Add distinct new keys."""
        new = np.frombuffer(b"".join(ids), dtype=ID)
        lengths = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids)) // ID.itemsize
        self.ids = _room(self.ids, self.used + len(new))
        self.starts, self.lengths = _room(self.starts, self.n + len(key)), _room(self.lengths, self.n + len(key))
        self.ids[self.used : self.used + len(new)] = new
        self.starts[self.n : self.n + len(key)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.n : self.n + len(key)] = lengths
        row = np.arange(self.n, self.n + len(key), dtype=np.int32)
        slot, left = (key >> self.shift).astype(np.int64), np.arange(len(key))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.rows[at[free]] = row[left[free]]  # of several that want one slot the last stays
            won = np.zeros(len(left), dtype=bool)
            won[free] = self.rows[at[free]] == row[left[free]]
            self.keys[at[won]], self.checks[at[won]] = key[left[won]], check[left[won]]
            left, at = left[~won], at[~won]
            slot[left] = (at + 1) & self.mask
        self.n += len(key)
        self.used += len(new)


def _room(held: np.ndarray, n: int) -> np.ndarray:
    if n <= len(held):
        return held
    out = np.zeros(max(n, 2 * len(held)), dtype=held.dtype)
    out[: len(held)] = held
    return out


def _has_other_blanks(data: np.ndarray) -> np.ndarray:
    """Where a blank outside ASCII (or a control that some count as one) begins."""
    odd = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)) | ((data >= 0x1C) & (data <= 0x1F)))
    padded = np.r_[data, np.zeros(2, np.uint8)]
    one, two, three = padded[odd], padded[odd + 1], padded[odd + 2]
    found = one < 0x20
    found |= (one == 0xC2) & ((two == 0x85) | (two == 0xA0))
    found |= (one == 0xE1) & (two == 0x9A) & (three == 0x80)
    found |= (one == 0xE2) & (two == 0x80) & ((three <= 0x8A) | (three == 0xA8) | (three == 0xA9) | (three == 0xAF))
    found |= (one == 0xE2) & (two == 0x81) & (three == 0x9F)
    found |= (one == 0xE3) & (two == 0x80) & (three == 0x80)
    return odd[found]


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids, without special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: _Memo | None = _Memo()
        self.newline = self.whole(["\n"])[0]
        if self.encode(_PROBES) != self.whole(_PROBES):
            self.memo = None

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype=ID).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: pa.Array | Sequence[str | None]) -> list[bytes]:
        """The ids of each text; null counts as empty."""
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        out: list[bytes] = []
        for block in blocks(column):
            out += self._block(block)
        return out

    def _block(self, block: Block) -> list[bytes]:
        data, offsets, start = block.data, block.offsets, block.word_start
        n = len(offsets) - 1
        raw = data.tobytes()
        if self.memo and self.memo.n > MEMO_WORDS:
            self.memo.clear()
        if self.memo is None:
            return self.whole([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        text = np.repeat(np.arange(n), np.diff(block.word_offsets))
        # what stands before each word, -1 if it is none of the four
        last = np.zeros(len(start), dtype=np.int64)
        last[1:] = block.word_end[:-1]
        gap = start - np.maximum(last, offsets[text])
        before = data[start - 1] if len(start) else data[:0]
        kind = np.full(len(start), -1, dtype=np.int8)
        kind[(gap == 0)] = _BARE
        kind[(gap == 1) & (before == 0x20)] = _SPACED
        kind[(gap == 1) & (before == 0x0A)] = _LINE
        kind[(gap == 2) & (before == 0x0A) & (data[start - 2] == 0x0A)] = _PARAGRAPH
        end = block.word_end
        # texts that the four do not describe are encoded whole
        odd = np.zeros(n, dtype=bool)
        odd[text[(kind < 0) | (end - start > _LONGEST)]] = True
        odd[np.searchsorted(offsets, _has_other_blanks(data), side="right") - 1] = True
        final = np.zeros(n, dtype=np.int64)
        some = np.diff(block.word_offsets) > 0
        final[some] = end[block.word_offsets[1:][some] - 1]
        odd |= some & (final != offsets[1:]) | ~some & (np.diff(offsets) > 0)
        use = ~odd[text]
        start, end, kind, text = start[use], end[use], kind[use], text[use]
        # a full stop or comma behind a letter
        tail = np.where(end - start > 1, data[end - 1], 0) if len(end) else data[:0]
        tail = np.where(((tail == 0x2E) | (tail == 0x2C)) & _LETTER[data[end - 2]], tail, 0) if len(end) else tail
        core = end - (tail > 0)
        own, marks = self._rows(data, raw, start, core, kind), {m: self._mark(m) for m in (0x2E, 0x2C)}
        marked = tail > 0
        place = np.arange(len(own)) + np.cumsum(marked) - marked
        rows = np.empty(len(own) + int(marked.sum()), dtype=np.int64)
        rows[place] = own
        rows[place[marked] + 1] = np.where(tail[marked] == 0x2E, marks[0x2E], marks[0x2C])
        lengths = self.memo.lengths[rows].astype(np.int64)
        total = np.r_[0, np.cumsum(lengths)]
        ids = self.memo.ids[np.repeat(self.memo.starts[rows] - total[:-1], lengths) + np.arange(total[-1])].tobytes()
        # the ids of a text end with those of its last word
        ends = total[np.r_[place, len(rows)]][np.searchsorted(text, np.arange(n + 1))] * ID.itemsize
        whole = iter(self.whole([raw[offsets[k] : offsets[k + 1]].decode() for k in np.flatnonzero(odd).tolist()]))
        cuts = ends.tolist()
        return [next(whole) if o else ids[a:b] for o, a, b in zip(odd.tolist(), cuts[:-1], cuts[1:], strict=True)]

    def _rows(self, data: np.ndarray, raw: bytes, start: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The memo's row of each word, after new words have been added."""
        memo = self.memo
        salt = mix64(kind.astype(np.uint64) + np.uint64(1))
        key = mix64(_spans_hashed(data, start, end, _BYTE_KEYS[0]) + salt) | np.uint64(1)
        check = (mix64(_spans_hashed(data, start, end, _BYTE_KEYS[1]) ^ salt) >> np.uint64(32)).astype(np.uint32)
        rows = memo.find(key, check)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            pairs = np.empty(len(missing), dtype=[("key", np.uint64), ("check", np.uint32)])
            pairs["key"], pairs["check"] = key[missing], check[missing]
            order = np.lexsort((pairs["check"], pairs["key"]))
            first = order[np.r_[True, pairs[order][1:] != pairs[order][:-1]]]
            new = missing[first]
            memo.add(key[new], check[new], self._new([raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)], kind[new].tolist()))
            rows[missing] = memo.find(key[missing], check[missing])
        return rows

    def _new(self, words: list[str], kinds: list[int]) -> list[bytes]:
        """The ids of words with what stands before them; Latin letters go to the merge model directly."""
        model, space = self.tokenizer.model.tokenize, chr(_BYTE_LETTERS[0x20])
        lead = {_BARE: b"", _SPACED: b"", _LINE: self.newline, _PARAGRAPH: 2 * self.newline}
        out: list[bytes] = []
        rest: list[int] = []
        for k, (word, kind) in enumerate(zip(words, kinds, strict=True)):
            if not (word.isascii() and word.isalpha()):
                if not _LATIN.fullmatch(word):
                    rest.append(k)
                    out.append(b"")
                    continue
                word = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
            out.append(lead[kind] + np.array([t.id for t in model(space + word if kind == _SPACED else word)], dtype=ID).tobytes())
        for k, ids in zip(rest, self.whole([_BEFORE[kinds[k]] + words[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def _mark(self, mark: int) -> int:
        """The memo's row of a full stop or comma on its own."""
        at = np.array([0]), np.array([1]), np.array([_BARE], dtype=np.int8)
        return int(self._rows(np.array([mark], dtype=np.uint8), bytes([mark]), *at)[0])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    return Encoder(path)
