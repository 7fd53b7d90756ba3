"""Near-duplicate documents by b-bit MinHash with exact confirmation.

1. Every text becomes its set of distinct five-word shingles (64-bit hashes), a
   digest of that set, ``BANDS`` band keys of ``ROWS`` minima each, and the low
   ``BITS`` bits of all minima packed into one binary column.
2. Documents with equal sets form a class; only one representative goes on.
3. Classes that share a band key are candidates.  Within a bucket the packed
   signatures are compared by bit counts; the estimate corrects for low bits that
   agree by chance.  Each bucket returns a spanning forest of pairs whose
   estimate is not clearly below the threshold, never all its pairs.
4. The components of these forests are families.  Texts of a family meet in
   blocks, where all pairs are confirmed on full shingle sets by sparse counting,
   and again only a spanning forest of the confirmed links leaves the task.  Texts
   of no family mostly stay where they are: a bitmap of fixed size, in which each
   wanted id sets a bit, tells them apart before the shuffle.
5. Components of the confirmed links are the near-duplicate groups.

A pair at the threshold 0.85 misses all 25 bands of 5 minima with probability
4e-7, and its estimate lies more than ``MARGIN`` below its similarity with
probability under 1e-6.  Buckets and families of any size are dealt out as pairs
of blocks, so no task gets more than two blocks of either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.llm.shared import components, group_cuts, joined_to_unique, map_groups, stored, tidy
from mobilis.llm.text import blocks, mix64, set_digest, shingle_sets

BANDS, ROWS, BITS = 25, 5, 4
MARGIN = 0.17
BUCKET_BLOCK = 1024
FAMILY_BLOCK = 256
#: Bits of the filter that goes to all tasks (8 MB, whatever the input); a multiple of 32,768.
FILTER_BITS = 1 << 26

_LANES = BANDS * ROWS
_MULTIPLIERS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, _LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 4096


def minima(items: np.ndarray) -> np.ndarray:
    """The minimum of each of the hash functions over a non-empty set."""
    out = np.full(_LANES, np.uint64(2**64 - 1))
    for i in range(0, len(items), _STEP):
        np.minimum(out, (items[None, i : i + _STEP] * _MULTIPLIERS[:, None]).min(axis=1), out=out)
    return mix64(out)


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + low[r::ROWS])
    return keys.view(np.int64)


def packed(low: np.ndarray) -> bytes:
    """The low ``BITS`` bits of all minima, bit plane by bit plane."""
    planes = (low[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8), axis=1).tobytes()


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Collision-corrected similarities of one packed signature to many (n, bytes)."""
    differ = np.bitwise_xor(one[None, :], many).reshape(len(many), BITS, -1)
    lanes = np.bitwise_or.reduce(differ, axis=1)
    same = _LANES - np.bitwise_count(lanes).sum(axis=1)
    chance = 2.0**-BITS
    return (same / _LANES - chance) / (1 - chance)


class Forest:
    """Union-find over the members of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, classes, keys, bits = [], [], [], []
            for block in blocks(batch.column("text")):
                for items in shingle_sets(block):
                    counts.append(len(items))
                    classes.append(set_digest(items) if len(items) else None)
                    low = minima(items) if len(items) else None
                    keys.append(None if low is None else band_keys(low))
                    bits.append(None if low is None else packed(low))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(classes, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                ["doc_id", "n_shingles", "class", "keys", "bits"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_shingles long, class binary, keys array<long>, bits binary")


def dealt_in_blocks(df: DataFrame, key: str, member: str, size: str, block: int) -> DataFrame:
    """Add (i, j), i <= j: a group of up to ``block`` rows has (0, 0); a larger one is
    cut by a hash of its members and every pair of cuts becomes a group."""
    cuts = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(member), cuts).cast("int")
    dealt = df.withColumn("own", F.when(cuts > 1, own).otherwise(0)).withColumn("t", F.explode(F.sequence(F.lit(0), F.greatest(cuts, F.lit(1)) - 1)))
    return dealt.withColumn("i", F.least("own", "t")).withColumn("j", F.greatest("own", "t")).drop("t")


def _bucket_forests(least: float):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        rep = table.column("rep").to_numpy()
        own = table.column("own").to_numpy()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=np.uint8).reshape(len(rep), -1)
        left, right = [], []
        cuts = group_cuts(key, i, j)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids, sig, forest = rep[a:b], bits[a:b], Forest(b - a)
            cross = i[a] != j[a]
            for x in range(b - a - 1):
                close = estimates(sig[x], sig[x + 1 :]) >= least
                if cross:
                    close &= own[a + x + 1 : b] != own[a + x]
                for y in (np.flatnonzero(close) + x + 1).tolist():
                    if forest.join(x, y):
                        left.append(ids[x])
                        right.append(ids[y])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def linked_pairs(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs x < y with 100 * |intersection| >= percent * |union|, exactly.

    Shingles are numbered within the block; an inverted list gives each set's
    overlap with all earlier ones by counting.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    value, owner = flat[order], owner[order]
    run = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    length = np.diff(np.r_[run, len(value)])
    # positions of each set's shingles within the sorted list
    back = np.argsort(owner, kind="stable")
    run_of = np.repeat(np.arange(len(run)), length)
    at = np.r_[0, np.cumsum(size)]
    xs, ys = [], []
    for x in range(len(sets) - 1):
        mine = run_of[back[at[x] : at[x + 1]]]
        mine = mine[length[mine] > 1]
        if not len(mine):
            continue
        ln = length[mine]
        first = np.cumsum(ln) - ln
        pick = np.repeat(run[mine] - first, ln) + np.arange(int(ln.sum()))
        common = np.bincount(owner[pick], minlength=len(sets))
        ok = 100 * common >= percent * (size + size[x] - common)
        ok[: x + 1] = False
        if side is not None:
            ok &= side != side[x]
        y = np.flatnonzero(ok)
        xs.append(np.full(len(y), x))
        ys.append(y)
    if not xs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(xs), np.concatenate(ys)


def _family_forests(percent: int):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        family, i, j = (table.column(c).to_numpy() for c in ("family", "i", "j"))
        rep, own, kind = table.column("rep").to_numpy(), table.column("own").to_numpy(), table.column("class").to_pylist()
        texts = table.column("text").combine_chunks()
        left, right = [], []
        cuts = group_cuts(family, i, j)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            sets, at, seen = [], [], set()
            for block in blocks(texts.slice(a, b - a)):
                for k, items in enumerate(shingle_sets(block)):
                    row = a + block.first + k
                    # rows that repeat an id with another text are not this class
                    if set_digest(items) == kind[row] and kind[row] not in seen:
                        seen.add(kind[row])
                        sets.append(items)
                        at.append(row)
            if len(sets) < 2:
                continue
            side = own[at] if i[a] != j[a] else None
            forest = Forest(len(sets))
            for x, y in zip(*(v.tolist() for v in linked_pairs(sets, side, percent)), strict=True):
                if forest.join(x, y):
                    left.append(rep[at[x]])
                    right.append(rep[at[y]])
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def marked(rows: DataFrame, wanted: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with ``_maybe``: whether ``key`` may be among ``wanted``; true for all that are, and few others.

    Hashes of the wanted keys set bits of a bitmap in parts of 4 kB; at most
    ``bits`` / 32,768 parts exist, so they may be broadcast.  A bitmap that fills up
    marks more rows, it never misses one.
    """
    h = F.pmod(F.xxhash64(key), F.lit(bits))
    marks = wanted.groupBy(F.shiftright(h, 15).alias("_part")).agg(F.bitmap_construct_agg(h.bitwiseAND(32_767)).alias("_bits"))
    met = rows.withColumn("_at", h).join(F.broadcast(marks), F.shiftright("_at", 15) == F.col("_part"), "left")
    byte = F.conv(F.hex(F.expr("substring(_bits, cast(shiftright(_at & 32767, 3) as int) + 1, 1)")), 16, 10).cast("int")
    maybe = F.coalesce(F.getbit(byte, F.col("_at").bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return met.select(*rows.columns, maybe.alias("_maybe"))


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of ``rows`` whose ``key`` may be among ``wanted`` (see :func:`marked`)."""
    return marked(rows, wanted, key, bits).where("_maybe").select(*rows.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets
    of distinct five-word shingles (A-Z lower-cased).  Null and blank texts have an
    empty set, link with nothing and are kept.  Rows that repeat an id with the
    same set are one document and get the same values; an id that repeats with
    different sets joins what these link with; a null id counts as no id:
    the row is a component of its own with a null component_id and is kept.  Other
    columns are not read, whatever their names.  ``percent`` must be at least 80.
    """
    if percent < 80:
        raise ValueError("the bands are laid out for similarities of 0.8 or more")
    sig = stored(signatures(docs, id_col, text_col))
    full = sig.where("class IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(full.groupBy("class").agg(F.min("doc_id").alias("first_id"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies")))
    told = classes.agg(F.count(F.lit(1)).alias("classes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    # an id that repeats with different texts stands for several classes, which then share a component
    names = classes.select("class", F.col("first_id").alias("rep"), "copies")
    keyed = classes.select(F.col("first_id").alias("rep"), F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = joined_to_unique(keyed, shared.withColumn("size", F.col("n")), "key", "n", BANDS * told["classes"]).join(classes.select(F.col("first_id").alias("rep"), "bits"), "rep")
    dealt = dealt_in_blocks(members, "key", "rep", "size", BUCKET_BLOCK)
    close = map_groups(dealt.select("key", "i", "j", "own", "rep", "bits"), ["key", "i", "j"], _bucket_forests(percent / 100 - MARGIN), "a long, b long")
    families = components(close, "a", "b").select(F.col("node").alias("rep"), F.col("component").alias("family"))
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("n")).withColumn("size", F.col("n"))
    wanted = stored(joined_to_unique(families, sizes, "family", "n", families.count()).join(names.drop("copies"), "rep"))
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    met = dealt_in_blocks(maybe_in(texts, wanted, "rep").join(wanted, "rep"), "family", "rep", "size", FAMILY_BLOCK)
    links = map_groups(met.select("family", "i", "j", "own", "rep", "class", "text"), ["family", "i", "j"], _family_forests(percent), "a long, b long")
    found = components(links, "a", "b").select(F.col("node").alias("rep"), "component")
    labels = stored(names.join(found, "rep", "left").select("class", "copies", F.coalesce("component", "rep").alias("root")))
    # a class may have any part of the rows; rows without a class or an id have no root to meet
    rows = sig.select("doc_id", "n_shingles", "class")
    met = joined_to_unique(rows.where("class IS NOT NULL AND doc_id IS NOT NULL"), labels, "class", "copies", told["rows"])
    out = met.unionByName(rows.where("class IS NULL OR doc_id IS NULL").withColumn("root", F.lit(None).cast("long")))
    root = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id"), F.coalesce(F.col("doc_id") == root, F.lit(True)).alias("kept"))
