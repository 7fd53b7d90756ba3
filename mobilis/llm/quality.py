"""Quality rules: base counts and compression bands of whole documents.

A text is compressed whole and in fixed chunks of ``CHUNK_BYTES``; repetitive text
compresses better, and random text worse, than prose of the same length.  The
band widens and rises with length because a longer text shares more with itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.llm.shared import tidy
from mobilis.llm.text import Block, blocks, mix64, windows

CHUNK_BYTES = 2048
LEVEL = 3
WINDOW_WORDS = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30
OUTSIDE_PERCENT = 50

#: (log2 of the bytes, lowest and highest ratio), linear between.  The highest stand a few
#: percent above what :func:`fit_band` gives for labelled prose, the lowest well below it,
#: as other languages and formats compress less than the labelled rows do.
BAND = [
    (5.0, 0.55, 1.35), (7.0, 0.90, 1.50), (8.0, 1.12, 1.72), (9.0, 1.25, 1.95), (10.0, 1.40, 2.06), (10.75, 1.50, 2.16),
    (11.25, 1.57, 2.19), (12.0, 1.65, 2.31), (13.0, 1.75, 2.42), (14.0, 1.85, 2.53), (15.0, 1.92, 2.64), (16.0, 2.00, 2.75), (20.0, 2.05, 3.05),
]

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CHAR = (np.arange(256) & 0xC0) != 0x80
_BLANK = b" \t\n\v\f\r"
_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, ratio double, n_chunks long, n_chunks_outside long, kept boolean"
)


def band(n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lowest and highest ratio allowed at each length."""
    at, low, high = (np.array(c) for c in zip(*BAND, strict=True))
    size = np.log2(np.maximum(n_bytes, 1))
    return np.interp(size, at, low), np.interp(size, at, high)


def fit_band(docs: DataFrame, labels: DataFrame, most_rows: int = 5000, outside: float = 0.005, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[float, float, float]]:
    """(log2 of the bytes, lowest and highest ratio) of good texts at the lengths of ``BAND``.

    Takes at most ``most_rows`` rows that ``labels`` (doc_id, quality) calls good, by a
    hash of their id; each gives the ratio of its beginning at every length it has.
    ``outside`` is the part of them that may lie beyond each limit.  Lengths that no
    text has are left out.
    """
    import zstandard

    sizes = [(at, int(2**at)) for at, _, _ in BAND]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            found = [(at, n / len(packer.compress(text[:n]))) for t in batch.column("text").to_pylist() if t for text in [t.encode()] for at, n in sizes if len(text) >= n]
            columns = list(zip(*found, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], ["at", "ratio"])

    good = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).join(good, "_id")
    ratios = rows.orderBy(F.xxhash64("_id")).limit(most_rows).select("text").mapInArrow(run, "at double, ratio double")
    limits = ratios.groupBy("at").agg(F.percentile("ratio", F.array(F.lit(outside), F.lit(1 - outside))).alias("limits")).orderBy("at")
    return [(r["at"], *r["limits"]) for r in limits.collect()]


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return total[offsets[1:]] - total[offsets[:-1]]


def repeated_words(block: Block, size: int = WINDOW_WORDS) -> np.ndarray:
    """Per text: the words that lie in a window of ``size`` words found twice or more in it."""
    words = block.word_hashes()
    found = windows(words, size)
    text = np.repeat(np.arange(len(block.word_offsets) - 1), np.diff(block.word_offsets))
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    if len(found):
        inside = text[: len(found)] == text[size - 1 :]
        at = np.flatnonzero(inside)
        key = mix64(found[at] + text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), dtype=bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        starts = at[again]
        cover += np.bincount(starts, minlength=len(cover))[: len(cover)]
        cover -= np.bincount(starts + size, minlength=len(cover))[: len(cover)]
    return _per_text(np.cumsum(cover)[: len(words)] > 0, block.word_offsets)


def duplicate_lines(text: bytes) -> int:
    if b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def measured(column: pa.Array) -> list[np.ndarray]:
    """The columns of :func:`judge` after the id, for the texts of one column."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=LEVEL)
    out: list[list[np.ndarray]] = [[] for _ in range(10)]
    for block in blocks(column):
        n = len(block.offsets) - 1
        n_words = np.diff(block.word_offsets)
        raw = block.data.tobytes()
        repeats = repeated_words(block)
        ratio, n_chunks, outside, lines = np.full(n, np.nan), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, (a, b) in enumerate(pairwise(block.offsets.tolist())):
            text = raw[a:b]
            if not text:
                continue
            lines[k] = duplicate_lines(text)
            ratio[k] = len(text) / len(packer.compress(text))
            parts = [text[i : i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
            own = np.array([len(x) / len(packer.compress(x)) for x in parts])
            low, high = band(np.array([len(x) for x in parts]))
            n_chunks[k], outside[k] = len(parts), ((own < low) | (own > high)).sum()
        low, high = band(np.diff(block.offsets))
        failed = (n_words < LEAST_WORDS) | (100 * repeats > REPEAT_PERCENT * n_words)
        kept = ~failed & (ratio >= low) & (ratio <= high) & (100 * outside <= OUTSIDE_PERCENT * n_chunks)
        chars = _per_text(block.solid & _CHAR[block.data], block.offsets)
        symbols = _per_text(_SYMBOL[block.data], block.offsets)
        for part, value in zip(out, (n_words, chars, symbols, lines, repeats, failed, ratio, n_chunks, outside, kept), strict=True):
            part.append(value)
    return [np.concatenate(c) if c else np.zeros(0) for c in out]


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: base counts, compression figures and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 percent of the words in repeated
    windows.  Else ``kept`` holds if the whole text's ratio lies in the band and no
    more than half of its chunks lie outside theirs; a short last chunk is held against
    the band of its own length.  A null or empty text has counts of
    0, no ratio, and fails.  Repeated rows and null ids give a row each; other
    columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _SCHEMA.split(", ")]
        kinds = {5: pa.bool_(), 6: pa.float64(), 9: pa.bool_()}
        for batch in batches:
            arrays = [pa.array(c, kinds.get(i, pa.int64()), mask=np.isnan(c) if i == 6 else None) for i, c in enumerate(measured(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), _SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(measured(batch.column(text_col))[9].astype(bool)))

    return docs.mapInArrow(tidy(run), docs.schema)
