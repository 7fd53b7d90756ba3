"""Fill-in-the-middle documents as rearranged ropes.

A text is a balanced tree (a rope) whose leaves are stretches of its bytes.  Every
node caches how many units (a word with the blanks before it, or the blanks at the
end) and code points lie below it.  Two splits at unit ranks, each along one path
from the root, give prefix, middle and suffix as subtrees; they are joined in another
order with leaves for the sentinels between them, so no text is copied before the
result is written.  The inverse builds a rope over the written text, splits it at the
code points of the sentinels and joins the subtrees in their old order.

Each document is worked on where it lies: no shuffle, and a lost task is simply run
again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.llm.shared import tidy
from mobilis.llm.text import Block, blocks

LEAF_UNITS = 256
#: Of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
_NO_ENDS = np.zeros(0, dtype=np.int64)


def _opens(data: np.ndarray) -> np.ndarray:
    """Marks the first byte of each code point."""
    return (data & 0xC0) != 0x80


class Rope:
    """Immutable text as a height-balanced tree; ``None`` stands for the empty one.

    A leaf holds bytes and the ends of its units in them; a branch has two ropes.
    """

    __slots__ = ("data", "ends", "left", "right", "units", "points", "height")

    def __init__(self, data: np.ndarray | None, ends: np.ndarray | None, left: Rope | None, right: Rope | None, units: int, points: int, height: int):
        self.data, self.ends, self.left, self.right = data, ends, left, right
        self.units, self.points, self.height = units, points, height

    @staticmethod
    def leaf(data: np.ndarray, ends: np.ndarray = _NO_ENDS, points: int | None = None) -> Rope | None:
        if not len(data):
            return None
        return Rope(data, ends, None, None, len(ends), int(np.count_nonzero(_opens(data))) if points is None else points, 0)

    @staticmethod
    def _branch(a: Rope, b: Rope) -> Rope:
        return Rope(None, None, a, b, a.units + b.units, a.points + b.points, 1 + max(a.height, b.height))

    @staticmethod
    def of(leaves: Sequence[Rope]) -> Rope | None:
        """A balanced rope of leaves in order."""
        if not leaves:
            return None
        if len(leaves) == 1:
            return leaves[0]
        half = len(leaves) // 2
        return Rope._branch(Rope.of(leaves[:half]), Rope.of(leaves[half:]))

    @staticmethod
    def joined(a: Rope | None, b: Rope | None) -> Rope | None:
        """``a`` and then ``b``, in time that follows the difference of their heights."""
        if a is None or b is None:
            return b if a is None else a
        if a.height > b.height + 1:
            return Rope._levelled(a.left, Rope.joined(a.right, b))
        if b.height > a.height + 1:
            return Rope._levelled(Rope.joined(a, b.left), b.right)
        return Rope._branch(a, b)

    @staticmethod
    def _levelled(a: Rope, b: Rope) -> Rope:
        """A branch of two ropes whose heights differ by two at most, rotated if they do."""
        one = Rope._branch
        if a.height > b.height + 1:
            if a.left.height >= a.right.height:
                return one(a.left, one(a.right, b))
            return one(one(a.left, a.right.left), one(a.right.right, b))
        if b.height > a.height + 1:
            if b.right.height >= b.left.height:
                return one(one(a, b.left), b.right)
            return one(one(a, b.left.left), one(b.left.right, b.right))
        return one(a, b)

    def split(self, rank: int, points: bool = False) -> tuple[Rope | None, Rope | None]:
        """The first ``rank`` units (or code points) and the rest."""
        if rank <= 0:
            return None, self
        if rank >= (self.points if points else self.units):
            return self, None
        if self.left is None:
            return self._cut(int(np.flatnonzero(_opens(self.data))[rank]) if points else int(self.ends[rank - 1]))
        before = self.left.points if points else self.left.units
        if rank <= before:
            a, b = self.left.split(rank, points)
            return a, Rope.joined(b, self.right)
        a, b = self.right.split(rank - before, points)
        return Rope.joined(self.left, a), b

    def _cut(self, at: int) -> tuple[Rope | None, Rope | None]:
        """A leaf in two at a byte; a cut inside a unit makes two units of it."""
        k = int(np.searchsorted(self.ends, at, side="right"))
        own = self.ends[:k] if k and self.ends[k - 1] == at else np.append(self.ends[:k], at)
        return Rope.leaf(self.data[:at], own), Rope.leaf(self.data[at:], self.ends[k:] - at)

    def pieces(self) -> Iterator[np.ndarray]:
        """The bytes of the leaves in order."""
        open_ = [self]
        while open_:
            node = open_.pop()
            if node.left is None:
                yield node.data
            else:
                open_ += [node.right, node.left]


def text_of(rope: Rope | None) -> bytes:
    return b"".join(memoryview(p) for p in rope.pieces()) if rope else b""


def ropes(block: Block) -> Iterator[Rope | None]:
    """A rope over each text of a block; leaves share its bytes."""
    n = len(block.offsets) - 1
    words = np.diff(block.word_offsets)
    last = np.where(words > 0, block.word_end[np.maximum(block.word_offsets[1:], 1) - 1] if len(block.word_end) else 0, block.offsets[:-1])
    tail = last < block.offsets[1:]  # blanks at the end are a unit of their own
    # ends of the units of all texts, in order
    at = block.word_offsets[1:] + np.cumsum(tail) - 1
    ends = np.empty(len(block.word_end) + int(tail.sum()), dtype=np.int64)
    is_tail = np.zeros(len(ends), dtype=bool)
    is_tail[at[tail]] = True
    ends[is_tail], ends[~is_tail] = block.offsets[1:][tail], block.word_end
    first = np.r_[0, np.cumsum(words + tail)]
    # a leaf begins at every LEAF_UNITS-th unit of its text
    text = np.repeat(np.arange(n), words + tail)
    begins = np.flatnonzero((np.arange(len(ends)) - first[text]) % LEAF_UNITS == 0)
    start = np.where(begins == first[text[begins]], block.offsets[text[begins]], ends[begins - 1])
    points = np.add.reduceat(_opens(block.data), start, dtype=np.int64).tolist() if len(start) else []
    stop, bounds = np.r_[start[1:], len(block.data)].tolist(), np.r_[begins, len(ends)].tolist()
    spans = np.searchsorted(begins, first).tolist()
    start = start.tolist()
    for a, b in zip(spans[:-1], spans[1:], strict=True):
        yield Rope.of([Rope.leaf(block.data[start[k] : stop[k]], ends[bounds[k] : bounds[k + 1]] - start[k], points[k]) for k in range(a, b)])


def _sentinel_bytes(sentinels: Sequence[str]) -> list[bytes]:
    """The sentinels, which must not overlap each other, so that they are found again."""
    found = [s.encode() for s in sentinels]
    if len(set(found)) != 3 or not all(found):
        raise ValueError("three different sentinels are needed")
    for a in found:
        for b in found:
            if a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("a sentinel must not lie in another or begin as one ends")
    return found


def _draws(seed: int, name: int | None) -> list[int]:
    """Four numbers of 32 bits that follow from the seed and the id of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4)]


def rearranged(
    docs: DataFrame,
    seed: int = 42,
    percent: int = 50,
    spm_percent: int = 80,
    sentinels: Sequence[str] = SENTINELS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``form`` is ``psm`` (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or
    ``plain`` (``output`` is the text).  About ``percent`` of the documents are cut at
    two of their units, ``spm_percent`` of these are ``spm``; both follow from the seed
    and the id.  A null text is empty; empty texts and those that hold a sentinel stay
    plain.  A null id counts as an empty one, repeated rows and ids give the same row
    again, other columns are not read, an empty table gives no rows.
    """
    marks = _sentinel_bytes(sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves = [Rope.leaf(np.frombuffer(m, np.uint8)) for m in marks]
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for block in blocks(batch.column("text")):
                raw, offsets = block.data.tobytes(), block.offsets.tolist()
                out: list[list] = [[] for _ in range(6)]
                for k, rope in enumerate(ropes(block)):
                    name, (a, b) = names[block.first + k], offsets[k : k + 2]
                    n = rope.units if rope else 0
                    one, two, three, four = _draws(seed, name)
                    if not n or three % 100 >= percent or any(raw.find(m, a, b) >= 0 for m in marks):
                        row = (name, n, PLAIN, None, None, raw[a:b])
                    else:
                        low, high = sorted((one % (n + 1), two % (n + 1)))
                        start, suffix = rope.split(high)
                        prefix, middle = start.split(low) if start else (None, None)
                        form = SPM if four % 100 < spm_percent else PSM
                        order = [leaves[0], prefix, leaves[1], suffix] if form == PSM else [leaves[1], suffix, leaves[0], prefix]
                        whole = None
                        for part in [*order, leaves[2], middle]:
                            whole = Rope.joined(whole, part)
                        row = (name, n, form, prefix.points if prefix else 0, middle.points if middle else 0, text_of(whole))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                arrays = [pa.array(c, t) for c, t in zip(out[:5], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(out[5], pa.binary()).cast(pa.string())], _COLUMNS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


_COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def restored(rows: DataFrame, keep: Sequence[str], sentinels: Sequence[str] = SENTINELS, output_col: str = "output", form_col: str = "form") -> DataFrame:
    """The columns ``keep`` and ``restored``, the text rebuilt from an output and its form.

    A null output is empty, a null form is ``plain``.  ``restored`` is null where the
    output cannot be one of its form: a sentinel is missing, out of order or there twice.
    """
    marks = _sentinel_bytes(sentinels)

    def back(rope: Rope | None, raw: bytes, form: str | None) -> bytes | None:
        if form in (None, PLAIN):
            return raw
        order = {PSM: (0, 1, 2), SPM: (1, 0, 2)}.get(form)
        at = [raw.find(marks[m]) for m in order or ()]
        if not order or at[0] != 0 or not at[0] < at[1] < at[2] or any(raw.count(m) != 1 for m in marks):
            return None
        parts: dict[int, Rope | None] = {}
        done, rest = 0, rope
        for k, m in enumerate(order):
            skip = len(marks[m].decode())
            rest = rest.split(skip, points=True)[1]
            done = at[k] + len(marks[m])
            if k < 2:
                here = len(raw[done : at[k + 1]].decode())
                parts[m], rest = rest.split(here, points=True) if rest else (None, None)
            else:
                parts[m] = rest
        return text_of(Rope.joined(Rope.joined(parts[0], parts[2]), parts[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = batch.column("_form").to_pylist()
            for block in blocks(batch.column("_output")):
                raw, offsets = block.data.tobytes(), block.offsets.tolist()
                n = len(offsets) - 1
                texts = [back(rope, raw[offsets[k] : offsets[k + 1]], forms[block.first + k]) for k, rope in enumerate(ropes(block))]
                kept = batch.slice(block.first, n).select(list(keep))
                yield kept.append_column("restored", pa.array(texts, pa.binary()).cast(pa.string()))

    given = rows.select(*keep, F.col(form_col).cast("string").alias("_form"), F.col(output_col).cast("string").alias("_output"))
    schema = given.select(*keep).schema.add("restored", "string")
    return given.mapInArrow(tidy(run), schema)
