"""Repeated lines, paragraphs and passages across documents.

A text is cut into units that nest: paragraphs (runs of lines with words), lines, and
the sentences of a line.  Each unit is normalised and reduced to a digest; digests
meet globally, whatever kind of unit they come from, and each keeps its first
occurrence.  Later paragraphs and lines are listed for removal with their offsets in
the original text; later sentences are listed where they follow each other for at
least ``RUN_WORDS`` words, so a passage is found inside other lines too while stock
phrases stay.  A unit inside a removed one is not listed again.  Whatever is removed,
its words remain in an earlier place.

Only digests and offsets move.  Counts are combined before the shuffle; units whose
digest has a thousandth of all units or more meet their first occurrence by a
broadcast (there are at most a thousand such digests), all others by a join.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.llm.shared import joined_to_unique, stored, tidy

#: Units of fewer words are let alone; 1 leaves none alone.
LEAST_WORDS = 1
#: Words in a row, of sentences that all occur elsewhere, that make a repeated passage.
RUN_WORDS = 30
#: Bytes of a digest: some 10^12 units have a pair of equal ones by chance with probability 1e-5.
DIGEST_BYTES = 12

_SENTENCE_END = re.compile(r"(?<=[.!?。！？])[ \t]+")
#: ``first`` and ``stop`` number the sentences of the document that a unit holds.
_UNIT = "row long, doc_id long, whole boolean, start int, end int, first int, stop int, words int, digest binary"
_FOUND = "doc_id long, n_lines long, n_removed long, chars_removed long, removed string, n_repeated long, repeated_words long, has_passage boolean"


def normalised(line: bytes) -> list[bytes]:
    """The words of a line, A-Z lower-cased."""
    return line.lower().split()


def sentences(text: str, start: int, end: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Start, end and words of each sentence of a line: it ends behind ``.``, ``!`` or ``?`` and a blank."""
    cuts = [(m.start(), m.end()) for m in _SENTENCE_END.finditer(text, start, end) if m.end() < end]
    at = start
    for stop, after in [*cuts, (end, end)]:
        words = normalised(text[at:stop].encode())
        if words:
            yield at, stop, words
        at = after


def paragraphs(text: str) -> Iterator[list[list[tuple[int, int, list[bytes]]]]]:
    """Each paragraph as its lines, each line as its sentences."""
    at, held = 0, []
    for line in text.split("\n"):
        found = list(sentences(text, at, at + len(line)))
        if found:
            held.append(found)
        elif held:
            yield held
            held = []
        at += len(line) + 1
    if held:
        yield held


def text_units(text: str, least_words: int) -> tuple[int, list[tuple[bool, int, int, int, int, list[bytes]]]]:
    """The lines of at least ``least_words`` words, and (whole, start, end, first, stop, words) of each unit."""
    out, n_lines, at = [], 0, 0
    for lines in paragraphs(text):
        first = at
        everything = [w for line in lines for s in line for w in s[2]]
        for line in lines:
            words = [w for s in line for w in s[2]]
            long = len(words) >= least_words
            n_lines += long
            if long:
                out.append((True, line[0][0], line[-1][1], at, at + len(line), words))
            if len(line) > 1 or not long:
                out += [(False, a, b, at + k, at + k + 1, own) for k, (a, b, own) in enumerate(line)]
            at += len(line)
        if len(lines) > 1 and len(everything) >= least_words:
            out.append((True, lines[0][0][0], lines[-1][-1][1], first, at, everything))
    return n_lines, out


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per unit with its digest, and one per document: no digest, its lines in ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _UNIT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 5, pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for row, name, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                n_lines, found = text_units(text or "", least_words)
                out.append((row, name, None, None, None, None, None, n_lines, None))
                out += [(row, name, *place, len(words), hashlib.blake2b(b" ".join(words), digest_size=DIGEST_BYTES).digest()) for *place, words in found]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), _UNIT)


def runs(found: list[dict], flag: str) -> Iterator[tuple[int, list[dict]]]:
    """Words and units of each run of flagged units; of nested ones the largest whole one counts."""
    held: list[dict] = []
    stop = words = 0
    for u in sorted((u for u in found if u[flag]), key=lambda u: (u["first"], -u["stop"])):
        if held and u["first"] < stop:
            continue
        if held and u["first"] > stop:
            yield words, held
            held, words = [], 0
        held.append(u)
        stop, words = u["stop"], words + u["words"]
    if held:
        yield words, held


def _resolved(run_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _FOUND.split(", ")]
        kinds = [*[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            out = []
            for name, n_lines, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_lines", "found")), strict=True):
                gone = [u for words, held in runs(found or [], "later") for u in held if u["whole"] or words >= run_words]
                again = [(words, len(held)) for words, held in runs(found or [], "elsewhere") if words >= run_words]
                spans = ",".join(f"{u['start']}:{u['end']}" for u in gone)
                out.append((name, n_lines, len(gone), sum(u["end"] - u["start"] for u in gone), spans, sum(n for _, n in again), sum(w for w, _ in again), bool(again)))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, chars_removed, removed, n_repeated, repeated_words, has_passage
    for each row of ``docs``.

    Lines end at newlines, paragraphs at lines without words, sentences at a mark and a
    blank; units are equal if their words are, A-Z lower-cased.  Of equal units the
    first is kept, by (doc_id, row, offset) with null ids last.  Later paragraphs and
    lines of at least ``least_words`` words go, and later sentences in a run of units
    that all are later ones, of ``run_words`` words together; ``removed`` lists what
    goes as ``start:end`` in code points of the original text, comma-joined, no span
    inside another.  ``n_lines`` counts lines of ``least_words`` words.  The last three
    columns tell of runs of ``run_words`` words whose units all occur in other rows
    too, first occurrences included: their units, their words, and whether there is
    one.  A null or empty text has no units.  Repeated rows are documents of their own;
    other columns are not read.
    """
    found = stored(units(docs, id_col, text_col, least_words))
    known = found.where("digest IS NOT NULL")
    rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "start")
    met = known.groupBy("digest").agg(F.min(rank).alias("earliest"), F.count(F.lit(1)).alias("n"), F.min("row").alias("least"), F.max("row").alias("most"))
    shared = stored(met.where("n > 1").select("digest", "n", F.col("earliest.row").alias("its_row"), F.col("earliest.start").alias("its_start"), (F.col("least") != F.col("most")).alias("elsewhere")))
    again = joined_to_unique(known.drop("doc_id"), shared, "digest", "n", known.count())
    later = (F.col("row") != F.col("its_row")) | (F.col("start") != F.col("its_start"))
    listed = again.groupBy("row").agg(F.collect_list(F.struct("whole", "start", "end", "first", "stop", "words", later.alias("later"), "elsewhere")).alias("found"))
    marks = found.where("digest IS NULL").select("row", "doc_id", F.col("words").cast("long").alias("n_lines"))
    return marks.join(listed.hint("merge"), "row", "left").select("doc_id", "n_lines", "found").mapInArrow(tidy(_resolved(run_words)), _FOUND)


def without(text: str, removed: str) -> str:
    """The text without the listed spans, each with the blank or newline behind it.

    The newline behind a span that began inside a line stays.
    """
    out, at = [], 0
    for span in filter(None, removed.split(",")):
        a, b = map(int, span.split(":"))
        out.append(text[at:a])
        inside = a > 0 and text[a - 1] != "\n"
        at = b if inside and text[b : b + 1] == "\n" else min(b + 1, len(text))
    return "".join(out) + text[at:]
