"""Personal data: fixed patterns, and a linear-chain conditional random field.

The patterns find well-formed addresses and numbers.  The random field adds what
they miss (numbers without a country code, access keys): each
word has a shape (kinds and lengths of its character runs), labels score the shapes
of a word and its two neighbours plus a transition, and Viterbi finds the best
labelling of each line.  It is trained on the driver from a small labelled table
(:func:`labelled_rows`, a few hundred short lines) in well under a second.

Most words cannot be anything but text: where a word's score for ``O`` beats every
other label by more than any two transitions could return, all best labellings have
``O`` there.  Lines fall apart at such words, and only the runs between them are
decoded, many at once in numpy; the result is that of decoding whole lines.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilis.llm.shared import tidy
from mobilis.llm.text import Block, blocks

KINDS = ["email", "ip", "card", "phone", "secret"]
LABELS = ["O", *KINDS]
N_SHAPES = 1024
_FLAGS = 128

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that fails from its start fails from all its digits: no start inside a run
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            done = m.end()
        at = text.find("@", at + 1)


def pattern_spans(text: str) -> list[Span]:
    """The well-formed spans, by kind and then start."""
    found = list(emails(text))
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- shapes -----------------------------------------------------------------

_LETTER, _UPPER, _NUMBER, _AT, _DOT, _JOIN, _OTHER = (1 << i for i in range(7))
_CLASS = np.full(256, _LETTER, dtype=np.uint8)
for _b in range(128):
    _c = chr(_b)
    _CLASS[_b] = _UPPER if _c.isupper() else _LETTER if _c.islower() else _NUMBER if _c.isdigit() else _AT if _c == "@" else _DOT if _c in ".,!?;" else _JOIN if _c in "-_+()/:=" else _OTHER


def _length(n: int) -> int:
    return n if n < 5 else 5 if n < 8 else 8 if n < 16 else 16 if n < 32 else 32


@lru_cache(maxsize=65536)
def shape_of(word: bytes) -> int:
    """Words without digits and ``@`` have one shape for each set of character kinds;
    others one for their runs of kinds with lengths, or for their mix if the runs are many."""
    kinds = [int(_CLASS[b]) for b in word]
    flags = 0
    for k in kinds:
        flags |= k
    if not flags & (_NUMBER | _AT):
        return flags
    core = word.strip(b"\"'.,!?;#$%&*|<>[]{}")
    kinds = [int(_CLASS[b]) for b in core]
    runs = [(k, len(list(g))) for k, g in groupby(kinds)]
    if len(runs) > 8:
        letters = all(b in b"0123456789abcdefABCDEF" for b in core)
        name = f"mix {letters} {_length(len(core))} {any(k == _AT for k in kinds)}"
    else:
        name = " ".join(f"{k}{_length(n) if k == _NUMBER else ''}" for k, n in runs)
    return _FLAGS + zlib.crc32(name.encode()) % (N_SHAPES - _FLAGS)


def block_shapes(block: Block) -> np.ndarray:
    if not len(block.word_start):
        return np.zeros(0, dtype=np.int64)
    length = block.word_end - block.word_start
    flags = np.bitwise_or.reduceat(_CLASS[block.data[block.solid]], np.cumsum(length) - length).astype(np.int64)
    for k in np.flatnonzero(flags & (_NUMBER | _AT)).tolist():
        flags[k] = shape_of(block.data[block.word_start[k] : block.word_end[k]].tobytes())
    return flags


# ---- the random field -------------------------------------------------------


@dataclass
class Model:
    """Scores by shape of the word, of the one before and of the one after, and by transition."""

    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    step: np.ndarray

    def scores(self, shapes: np.ndarray, previous: np.ndarray, following: np.ndarray) -> np.ndarray:
        return self.here[shapes] + self.before[previous] + self.after[following]


def labelled_rows(n: int = 500, seed: int = 5) -> list[tuple[str, str]]:
    """The small labelled table: (line, labels of its words joined by spaces), made by rule."""
    rng = random.Random(seed)
    syllables = ["the", "ra", "mento", "ing", "shu", "ver", "ción", "eau", "lich", "on"]

    def word() -> str:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
        style, mark = rng.random(), rng.random()
        w = w.capitalize() if style < 0.2 else w.upper() if style < 0.35 else w
        w += rng.choice(["", "", ",", ".", "!!", ",!!", "###", "-", ".)", "?"]) if mark < 0.5 else ""
        return rng.choice(["|", "-", f'"{w}"', f"({w})", f"{w}-{w}", f"{w}/{w}", f"<{w}>", f"{w}:", f"{w}_{w}"]) if mark > 0.85 else w

    def number(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def hexes(k: int) -> str:
        return "".join(rng.choice("0123456789abcdef") for _ in range(k))

    makers = {
        "email": [lambda: [f"{rng.choice(syllables)}.{number(2)}@mail{number(1)}.example.com"], lambda: [f"{rng.choice(syllables)}@example.org!!"]],
        "ip": [lambda: [".".join(str(rng.randint(1, 255)) for _ in range(4)) + rng.choice(["", "!!", ","])]],
        "card": [lambda: [number(16) + rng.choice(["", "!!"])], lambda: [number(4) for _ in range(4)]],
        "phone": [
            lambda: ["+" + number(1), f"({number(3)})", f"{number(3)}-{number(4)}"],
            lambda: [f"({number(3)})", f"{number(3)}-{number(4)}"],
            lambda: [f"{number(3)}-{number(3)}-{number(4)}"],
            lambda: [f"+{number(2)}-{number(3)}-{number(4)}"],
        ],
        "secret": [lambda: [f'"{hexes(40)}"'], lambda: [f'"{hexes(40).upper()}"!!'], lambda: [hexes(32)], lambda: [f"sk_{hexes(24)}"]],
    }
    plain = [lambda: number(rng.randint(1, 4)), lambda: f"{number(1)}.", lambda: f"{number(1)}.0.", lambda: f"{number(2)}%", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}:{number(2)}", lambda: f"${number(3)}.{number(2)}", lambda: number(14), lambda: f"No.{number(3)}", lambda: f"{number(1)},{number(3)}"]
    rows = []
    for _ in range(n):
        words, labels = [], []
        for _ in range(rng.randint(2, 5)):
            draw = rng.random()
            if draw < 0.25:
                kind = rng.choice(KINDS)
                made = rng.choice(makers[kind])()
            elif draw < 0.5:
                kind, made = "O", [rng.choice(plain)()]
            else:
                kind, made = "O", [word() for _ in range(rng.randint(1, 4))]
            # entities stand apart, so that one label's run is one entity
            words += [*made, word()]
            labels += [kind] * len(made) + ["O"]
        rows.append((" ".join(words), " ".join(labels)))
    return rows


def train(rows: list[tuple[str, str]], rounds: int = 100, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Maximum likelihood with an L2 term by adaptive full-batch gradient steps.

    The term pulls towards ``O``, which thereby holds for shapes never seen.
    """
    k = len(LABELS)
    words = [[shape_of(w.encode()) for w in line.split(" ")] for line, _ in rows]
    gold = [[LABELS.index(x) for x in labels.split(" ")] for _, labels in rows]
    n, t = len(rows), max(map(len, words))
    shapes, answer, live = np.zeros((n, t), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for i, (s, g) in enumerate(zip(words, gold, strict=True)):
        shapes[i, : len(s)], answer[i, : len(s)], live[i, : len(s)] = s, g, True
    prev, foll = np.zeros_like(shapes), np.zeros_like(shapes)
    prev[:, 1:], foll[:, :-1] = shapes[:, :-1], shapes[:, 1:]
    foll[~live] = 0
    theta = [np.zeros((N_SHAPES, k)), np.zeros((N_SHAPES, k)), np.zeros((N_SHAPES, k)), np.zeros((k, k))]
    theta[0][:, 0] = 2.0
    prior = [x.copy() for x in theta]
    grown = [np.full_like(x, 1e-8) for x in theta]
    one = np.eye(k)

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)

    for _ in range(rounds):
        score, step = theta[0][shapes] + theta[1][prev] + theta[2][foll], theta[3]
        ahead, back = np.zeros((t, n, k)), np.zeros((t, n, k))
        ahead[0] = score[:, 0]
        for j in range(1, t):
            new = total(ahead[j - 1][:, :, None] + step[None], 1) + score[:, j]
            ahead[j] = np.where(live[:, j, None], new, ahead[j - 1])
        norm = total(ahead[-1], 1)
        for j in range(t - 2, -1, -1):
            new = total(step[None] + (score[:, j + 1] + back[j + 1])[:, None, :], 2)
            back[j] = np.where(live[:, j + 1, None], new, 0.0)
        gradient = [np.zeros_like(x) for x in theta]
        for j in range(t):
            on = live[:, j]
            left = one[answer[on, j]] - np.exp(ahead[j][on] + back[j][on] - norm[on, None])
            for g, at in zip(gradient, (shapes, prev, foll), strict=False):
                np.add.at(g, at[on, j], left)
            if j:
                pair = ahead[j - 1][on][:, :, None] + step[None] + (score[on, j] + back[j][on])[:, None, :] - norm[on, None, None]
                gradient[3] -= np.exp(pair).sum(axis=0)
                np.add.at(gradient[3], (answer[on, j - 1], answer[on, j]), 1.0)
        for x, g, a, x0 in zip(theta, gradient, grown, prior, strict=True):
            g -= decay * n * (x - x0)
            a += g * g
            x += rate * g / np.sqrt(a)
    return Model(*theta)


def viterbi(scores: np.ndarray, step: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Best labels of the runs ``starts .. stops`` of ``scores``, each between two ``O`` words.

    Runs are decoded side by side, longest first, so each step is one numpy call
    over all runs that are still open.
    """
    labels = np.zeros(len(scores), dtype=np.int8)
    size = stops - starts
    order = np.argsort(-size, kind="stable")
    starts, size = starts[order], size[order]
    most = int(size[0]) if len(size) else 0
    best = step[0][None, :] + scores[starts]
    links = np.zeros((len(scores), step.shape[0]), dtype=np.int8)
    for j in range(1, most):
        open_ = int(np.searchsorted(-size, -j, side="left"))  # runs longer than j
        paths = best[:open_, :, None] + step[None]
        at = starts[:open_] + j
        links[at] = paths.argmax(axis=1)
        best[:open_] = paths.max(axis=1) + scores[at]
    now = (best + step[:, 0][None, :]).argmax(axis=1)
    for j in range(most - 1, -1, -1):
        open_ = int(np.searchsorted(-size, -j, side="left"))
        at = starts[:open_] + j
        labels[at] = now[:open_]
        if j:
            now[:open_] = links[at, now[:open_]]
    return labels


def block_labels(block: Block, model: Model) -> np.ndarray:
    """The label of each word of a block; lines are sequences of their own."""
    shapes = block_shapes(block)
    n = len(shapes)
    if not n:
        return np.zeros(0, dtype=np.int8)
    lines = np.cumsum(block.data == 0x0A)
    line = lines[block.word_start]
    text = np.searchsorted(block.offsets, block.word_start, side="right")
    breaks = np.ones(n, dtype=bool)
    breaks[1:] = (line[1:] != line[:-1]) | (text[1:] != text[:-1])
    prev, foll = np.zeros(n, np.int64), np.zeros(n, np.int64)
    prev[1:] = np.where(breaks[1:], 0, shapes[:-1])
    foll[:-1] = np.where(breaks[1:], 0, shapes[1:])
    scores = model.scores(shapes, prev, foll)
    swing = 2 * (model.step.max() - model.step.min())
    unsure = scores[:, 0] - scores[:, 1:].max(axis=1) <= swing
    opens = unsure.copy()
    opens[1:] &= breaks[1:] | ~unsure[:-1]
    closes = unsure.copy()
    closes[:-1] &= breaks[1:] | ~unsure[1:]
    return viterbi(scores, model.step, np.flatnonzero(opens), np.flatnonzero(closes) + 1)


def _field_spans(block: Block, model: Model) -> dict[int, list[Span]]:
    """Per text of the block with any: the spans of labelled words, in code points."""
    labels = block_labels(block, model)
    marked = np.flatnonzero(labels)
    out: dict[int, list[Span]] = {}
    if not len(marked):
        return out
    text = np.searchsorted(block.word_offsets, marked, side="right") - 1
    runs: list[list[int]] = []
    for k, own in zip(marked.tolist(), text.tolist(), strict=True):
        if runs and runs[-1][1] == k - 1 and runs[-1][2] == own and labels[k] == labels[runs[-1][0]] and 0x0A not in block.data[block.word_end[k - 1] : block.word_start[k]]:
            runs[-1][1] = k
        else:
            runs.append([k, k, own])
    cut = b"\"'.,!?;#$%&*|<>[]{}"
    for a, b, own in runs:
        start, end = int(block.word_start[a]), int(block.word_end[b])
        raw = block.data[start:end].tobytes()
        start, end = start + len(raw) - len(raw.lstrip(cut)), end - (len(raw) - len(raw.rstrip(cut)))
        if end <= start:
            continue
        base = int(block.offsets[own])
        lead = int(np.count_nonzero((block.data[base:start] & 0xC0) != 0x80))
        size = int(np.count_nonzero((block.data[start:end] & 0xC0) != 0x80))
        out.setdefault(own, []).append((LABELS[labels[a]], lead, lead + size))
    return out


def plausible(kind: str, found: str) -> bool:
    """What a span of the random field must hold besides its shape."""
    digits = "".join(_DIGIT.findall(found))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "ip":
        return _IP.fullmatch(found) is not None and bool(pattern_spans(found))
    if kind == "email":
        return "@" in found
    return len(found) >= 20


def column_spans(column: pa.Array, model: Model) -> Iterator[tuple[str, list[Span], list[Span]]]:
    """Each text with its pattern spans and the spans that the random field adds to them."""
    texts = column.to_pylist()
    for block in blocks(column):
        more = _field_spans(block, model)
        for k in range(len(block.offsets) - 1):
            text = texts[block.first + k] or ""
            base = pattern_spans(text)
            new = [x for x in more.get(k, []) if plausible(x[0], text[x[1] : x[2]]) and all(x[2] <= a or b <= x[1] for _, a, b in base)]
            yield text, base, new


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1]))


def find(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of pattern spans, their digest, and all spans, per row of ``docs``.

    Spans are ``kind:start:end`` in code points with the end exclusive, by kind and
    start, comma-joined.  Spans of the random field that overlap a pattern span, or
    whose digits cannot be what their shape says (no Luhn sum), are not added.  Null and empty texts have none.  Repeated rows and null ids give a
    row each; other columns are not read.
    """
    model = model or train(labelled_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [[] for _ in range(5)], [], []
            for _, base, new in column_spans(batch.column("text"), model):
                for c, kind in zip(counts, KINDS[:4], strict=False):
                    c.append(sum(x[0] == kind for x in base))
                counts[4].append(len(new))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(ordered(base + new)))
            arrays = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans one mark stays."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


def mask(docs: DataFrame, model: Model | None = None, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with every span of personal data in the text replaced by its kind in brackets.

    ``chars_col``, where the table has it, becomes the length of the new text for
    rows whose text changed.  All other columns and rows stay as they are.
    """
    model = model or train(labelled_rows())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            changed = [k for k, (t, base, new) in enumerate(found) if base or new] if (found := list(column_spans(batch.column(text_col), model))) else []
            if changed:
                sizes = batch.column(chars_col).to_pylist() if chars_col in batch.schema.names else None
                for k in changed:
                    text, base, new = found[k]
                    texts[k] = masked(text, base + new)
                    if sizes:
                        sizes[k] = len(texts[k])
                batch = batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col), pa.array(texts, batch.schema.field(text_col).type))
                if sizes:
                    at = batch.schema.get_field_index(chars_col)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(tidy(run), docs.schema)
