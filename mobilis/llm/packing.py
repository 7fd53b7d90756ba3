"""Packing documents into fixed-length token sequences.

Each document is encoded once, where it lies, and cut into full sequences and one
remainder.  Only lengths and checksums then move: documents are dealt to
randomised groups of bounded size, and in each group first-fit decreasing places
the remainders, a tournament tree over bin capacities finding the first bin that
fits in logarithmic time.  Groups are independent, so they run in parallel and a
lost one is simply packed again.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mobilis.llm.shared import group_cuts, map_groups, stored, tidy
from mobilis.llm.tokens import ID, encoder

GROUP_DOCUMENTS = 8192
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Tournament tree over the free room of bins; every bin starts empty."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(bins - 1, 0).bit_length()
        self.best = [room] * (2 * self.leaves)

    def take(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room: the bin and its room before."""
        best, k = self.best, 1
        while k < self.leaves:
            k *= 2
            if best[k] < size:
                k += 1
        bin_, room = k - self.leaves, best[k]
        best[k] = room - size
        while k > 1:
            k //= 2
            a, b = best[2 * k], best[2 * k + 1]
            best[k] = a if a >= b else b
        return bin_, room


def first_fit_decreasing(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; ties keep their order."""
    bins, offsets = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    tree = CapacityTree(len(sizes), room)
    for k in np.argsort(-sizes, kind="stable").tolist():
        bins[k], left = tree.take(int(sizes[k]))
        offsets[k] = room - left
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int, id_col: str, text_col: str, with_ids: bool, group: Column | None = None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype=ID).tobytes()
        step = room * ID.itemsize
        for batch in batches:
            names, groups, rows = batch.column("doc_id").to_pylist(), batch.column("group").to_pylist(), [[] for _ in range(7)]
            for name, own, ids in zip(names, groups, encoder(tokenizer).encode(batch.column("text")), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    found = (name, at // ID.itemsize, len(part) // ID.itemsize, zlib.crc32(part), len(ids) // ID.itemsize, own, part)
                    for column, value in zip(rows, found, strict=True):
                        column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in rows[:6]] + [pa.array(rows[6], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "group", "ids"][: len(arrays)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (F.lit(None) if group is None else group).cast("long").alias("group"))
    return rows.mapInArrow(tidy(run), _PIECE + ", group long" + ", ids binary" * with_ids)


def _pack(room: int):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = table.column("group").to_numpy()
        length = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(group), dtype=np.int64), np.zeros(len(group), dtype=np.int64)
        cuts = group_cuts(group)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            bins, offset[a:b] = first_fit_decreasing(length[a:b], room)
            sequence[a:b] = (int(group[a]) << 28) + bins
        keep = [n for n in table.column_names if n != "group"]
        out = table.select(keep).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from out.to_batches()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    room: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
    group_documents: int = GROUP_DOCUMENTS,
    seed: int = 7,
    group: Column | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids (null text: none) and then ``end_id``; pieces cover
    each exactly once.  Repeated rows and ids are documents of their own, a null id
    stays null, other columns are not read.  ``group`` names the group of each row
    where the caller has an order to keep; by default a hash deals rows to groups of
    about ``group_documents``.  ``with_ids`` adds the ids of each piece as bytes.
    An empty table gives no pieces.
    """
    if not 0 < room < 1 << 31:
        raise ValueError("room must be a positive 32-bit number")
    names = [c.split()[0] for c in _PIECE.split(", ")] + ["ids"] * with_ids
    if group is not None:
        rows = pieces(docs, tokenizer, end_id, room, id_col, text_col, with_ids, group).select("group", *names)
    else:
        found = stored(pieces(docs, tokenizer, end_id, room, id_col, text_col, with_ids).withColumn("row", F.monotonically_increasing_id()))
        n = max(1, math.ceil(found.where("start = 0").count() / group_documents))
        rows = found.select(F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("long").alias("group"), *names)
    schema = _PIECE + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return map_groups(rows, ["group"], _pack(room), schema)


def sequences(packed: DataFrame, room: int = 1024) -> DataFrame:
    """The token ids of each sequence (from ``with_ids``) and its padded length.

    A sequence is padded to ``room`` unless its length is a power of two.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts"))
    power = F.expr("bit_count(length) = 1")
    ids = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return rows.select("sequence_id", "length", F.when(power, F.col("length")).otherwise(room).alias("padded_length"), ids.alias("ids"))
