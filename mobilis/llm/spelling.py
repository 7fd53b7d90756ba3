"""Spelling variants: words that differ by one letter, found by hashes of deletions.

1. Words are counted where their texts lie, a block at once, and summed by word.
2. A word of m letters has m deletions.  Polynomial hashes of all prefixes and suffixes
   come from one running sum, so the hash of each deletion is a few integer operations
   on whole arrays.  Two words differ by a replaced letter at a place if their deletions
   at that place agree, and by an inserted one if a deletion of the longer is the shorter.
   So a word gives a key for each place, one for each distinct deletion and one for
   itself.
3. Keys are dealt by their leading bits and sorted.  Only keys that several words share go
   on; they meet the words themselves, and the strings decide what truly agrees.
4. An agreeing group has at most the letters of the alphabet times the places of a word,
   and any two near words meet in exactly one.  So counts and best words are taken by
   group and then summed by word, and no pairs are formed.
5. Forms are followed from the roots down, one step a round: a form has at least twice the
   count, so there are no more rounds than powers of two in the largest count.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.llm.shared import stored, tidy, whole_groups
from mobilis.llm.text import Block, blocks, mix64

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF, which UTF-8 writes as 0xC3 and one byte.
_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LEAD = 0xC3
#: Occurrences that are counted at once.
_TALLY = 1 << 20
#: Bytes of a word whose checksum is taken for all words at once; the rest of longer ones follows one by one.
_AT_ONCE = 48
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)
_RADIX = 0x9E3779B97F4A7C15
_UNRADIX = pow(_RADIX, -1, 1 << 64)
#: Leading bits by which keys are dealt.
_DEAL_BITS = 12
_PLACE, _SHORTER, _WHOLE = range(3)


def letters(block: Block) -> Block:
    """The block with A-Z lower-cased and all that is no letter blanked, so that its words are runs of letters."""
    lead = block.data == _LEAD
    own = _LETTER[block.data] | lead
    own[1:] |= lead[:-1]
    return Block(block.first, np.where(own, _LOWER[block.data], np.uint8(0x20)), block.offsets)


def checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """crc32 of each span of bytes, begun from the checksum of what stands before it."""
    order = np.argsort(start - end, kind="stable")
    size, at = (end - start)[order], start[order]
    state = begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for k in range(min(int(size[0]) if len(size) else 0, _AT_ONCE)):
        n = int(np.searchsorted(-size, -k, side="left"))  # longer than k
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + k]) & 0xFF] ^ (state[:n] >> np.uint32(8))
    out = np.empty(len(start), dtype=np.uint32)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    for k in np.flatnonzero(end - start > _AT_ONCE).tolist():
        out[k] = zlib.crc32(data[start[k] + _AT_ONCE : end[k]].tobytes(), int(out[k]))
    return out


def _tally(words: list[pa.Array]) -> pa.RecordBatch:
    found = pc.value_counts(pa.chunked_array(words, pa.large_string()))
    return pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])


def counted(docs: DataFrame, least_letters: int = 5, slip: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: runs of letters with at least ``least_letters``, after slips, and how often they occur.

    A run slips if ``slip`` divides the crc32 of ``<id>:<run>``: it loses the letter at that
    number modulo its length.  ``slip`` 0 leaves runs as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []
        n = 0
        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for whole in blocks(batch.column("text")):
                block = letters(whole)
                start, end = block.word_start, block.word_end
                if not len(start):
                    continue
                lead = np.append(block.data == _LEAD, False)
                edges = np.stack([start, end], axis=1).ravel()
                size = end - start - np.add.reduceat(lead, edges, dtype=np.int64)[::2]
                use = size >= least_letters
                text = np.repeat(np.arange(len(block.offsets) - 1), np.diff(block.word_offsets))[use]
                bytes_ = end - start
                data = block.data[block.solid][np.repeat(use, bytes_)]
                start, end, size = start[use], end[use], size[use]
                offsets = np.r_[0, np.cumsum(end - start)]
                words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))
                if slip:
                    begun = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in names[block.first : block.first + len(block.offsets) - 1]], dtype=np.uint32)
                    crc = checksums(block.data, start, end, begun[text])
                    off = crc % slip == 0
                    short = []
                    for word, h in zip(words.filter(pa.array(off)).to_pylist(), crc[off].tolist(), strict=True):
                        at = h % len(word)
                        if len(word) > least_letters:
                            short.append(word[:at] + word[at + 1 :])
                    held += [words.filter(pa.array(~off)), pa.array(short, pa.large_string())]
                else:
                    held.append(words)
                n += len(words)
                if n >= _TALLY:
                    yield _tally(held)
                    held, n = [], 0
        if held:
            yield _tally(held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all words: whose word, kind, place and 64-bit key.

    A word has a key of kind ``_PLACE`` for each letter left out, with its place; one of
    kind ``_SHORTER`` for each distinct deletion and one of kind ``_WHOLE`` for itself,
    which agree as hashes of strings.
    """
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stop = np.cumsum(length)
    start = stop - length
    code = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = len(code)
    up, down = (np.full(n + 1, r, dtype=np.uint64) for r in (_RADIX, _UNRADIX))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((mix64(code + np.uint64(1)) | np.uint64(1)) * up[:n], out=total[1:])
    own, at = np.repeat(np.arange(len(words)), length), np.arange(n)
    place = at - start[own]
    prefix = (total[at] - total[start[own]]) * down[start[own]]
    suffix = (total[stop[own]] - total[at + 1]) * down[start[own] + 1]
    string = lambda value, size: mix64(value + mix64(size.astype(np.uint64)))
    shorter = string(prefix + suffix, length[own] - 1)
    whole = string((total[stop] - total[start]) * down[start], length)
    by_place = mix64(shorter ^ mix64(place.astype(np.uint64) + np.uint64(1 << 32)))
    first = np.ones(n, dtype=bool)  # equal letters side by side give one deletion
    first[1:] = (code[1:] != code[:-1]) | (place[1:] == 0)
    kind = np.repeat(np.array([_PLACE, _SHORTER, _WHOLE], dtype=np.int8), [n, int(first.sum()), len(words)])
    whose = np.r_[own, own[first], np.arange(len(words))]
    return whose, kind, np.r_[place, place[first], np.full(len(words), -1)], np.r_[by_place, shorter[first], whole].view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
        a = 0
        while a < len(words):  # some 100,000 letters at once
            b, letters_ = a, 0
            while b < len(words) and (b == a or letters_ + len(words[b]) < 100_000):
                letters_ += len(words[b])
                b += 1
            whose, kind, place, key = deletion_keys(words[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind), pa.array(place.astype(np.int32)), pa.array(ids[a:b][whose])], ["key", "kind", "place", "id"])
            a = b


def _dealt(keys: DataFrame) -> DataFrame:
    """Rows dealt by the leading bits of their keys and sorted by key."""
    return keys.repartition(F.shiftrightunsigned("key", 64 - _DEAL_BITS)).sortWithinPartitions("key")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys that can make words near: a place with two words, or a word with a deletion that equals it."""
    for table in whole_groups(batches, ["key"]):
        key, kind = table.column("key").to_numpy(), table.column("kind").to_numpy()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        size = np.diff(cuts)
        of = lambda k: np.add.reduceat(kind == k, cuts[:-1], dtype=np.int64)
        places, shorter, whole = of(_PLACE), of(_SHORTER), of(_WHOLE)
        use = np.repeat((places >= 2) | (shorter > 0) & (whole > 0), size)
        yield from table.filter(pa.array(use)).to_batches()


def _less(word: str, place: int) -> str:
    return word if place < 0 else word[:place] + word[place + 1 :]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By group of truly agreeing words: how many others each is near to, and the best of them."""
    best = lambda x: (-x[0], x[1])  # noqa: E731 - largest count, then least word
    for table in whole_groups(batches, ["key"]):
        out: list[tuple] = []
        groups: dict[tuple, list[tuple]] = defaultdict(list)
        columns = [table.column(c).to_pylist() for c in ("key", "kind", "place", "id", "n", "word")]
        for key, kind, place, name, n, word in zip(*columns, strict=True):
            # the string is part of the group: what only hashes alike falls apart here
            groups[key, place if kind == _PLACE else -1, _less(word, place)].append((n, word, name, kind == _WHOLE))
        for (_, at, _), members in groups.items():
            if at >= 0:
                first, *others = sorted(members, key=best)
                if others:
                    out.append((first[2], len(others), others[0][0], others[0][1]))
                    out += [(x[2], len(others), first[0], first[1]) for x in others]
            elif whole := [x for x in members if x[3]]:
                (short,), longer = whole, [x for x in members if not x[3]]
                if longer:
                    top = min(longer, key=best)
                    out.append((short[2], len(longer), top[0], top[1]))
                    out += [(x[2], 1, short[0], short[1]) for x in longer]
        if out:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "n_near", "best_n", "best"])


def near_words(vocabulary: DataFrame) -> DataFrame:
    """id, n_near and (best_n, best), the near word with the largest count (ties: the least), of words that have one.

    ``vocabulary`` has distinct ``word``, its ``id`` and ``n``.
    """
    keys = vocabulary.select("word", "id").mapInArrow(tidy(_keys), "key long, kind byte, place int, id long")
    shared = stored(_dealt(keys).mapInArrow(tidy(_shared), "key long, kind byte, place int, id long"))
    named = shared.join(vocabulary, "id").select("key", "kind", "place", "id", "n", "word")
    met = _dealt(named).mapInArrow(tidy(_nearest), "id long, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("found")
    return met.groupBy("id").agg(F.sum("n_near").alias("n_near"), best).select("id", "n_near", (-F.col("found.minus")).alias("best_n"), F.col("found.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where following ``form`` from each word ends.  A word has one form, and no circle is there.

    Level by level from the words whose form is a root: a word has a bounded number of
    words whose form it is, so no key of the joins is hot.
    """
    parents = forms.select(F.col("word").alias("form"))
    level = stored(forms.join(parents, "form", "left_anti").select("word", F.col("form").alias("root")))
    found = level
    while level.head(1):
        up = level.select(F.col("word").alias("form"), "root")
        level = stored(forms.join(up, "form").select("word", "root"))
        found = found.unionByName(level)
    return found


def variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, slip: int = 97, factor: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a word that occurs ``least_count`` times: word, form, root, n, n_near, form_n.

    Words are near if one letter inserted, deleted or replaced makes one the other.
    ``form`` is the near word with the largest count (ties: the least), if that is at least
    ``factor`` (2 or more) times the word's own, else null; ``root`` is where forms end, the
    word itself if it has none.  Only A-Z are lower-cased.  Null and empty texts have no
    words, a null id counts as an empty one, repeated rows count again, a text may be one
    word of any length, other columns are not read; an empty table gives no rows.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that forms end")
    words = counted(docs, least_letters, slip, id_col, text_col).where(F.col("n") >= least_count)
    vocabulary = stored(words.withColumn("id", F.monotonically_increasing_id()))
    near = near_words(vocabulary)
    formed = F.col("best_n") >= factor * F.col("n")
    told = stored(
        vocabulary.join(near, "id", "left").select(
            "word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n")
        )
    )
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
