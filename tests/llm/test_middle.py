"""Fill-in-the-middle documents against a plain version."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mobilis.llm import middle
from mobilis.llm.text import blocks

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts():
    rng = random.Random(2)
    pieces = ["a", "é", "中文", "\U0001f600", " ", "  ", "\n", "\t\x0b", "<P", "P>", "<", ">", "\x85", "　", "word"]
    made = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(300)]
    made += ["", " ", "\n\n ", "x", " x", "x ", "a <P> b c", "<S>", "d<M>e", "<<S", "a b <", "< a S> b <", None, None]
    return [*made, " ".join(f"w{k}é" for k in range(20_000)) + " \n", "x" * 300_000]


def plain(name, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if name is None else name}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(a), len(b), f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"


@pytest.fixture(scope="module")
def table(spark):
    made = [(k, t, "out", "f", 1) for k, t in enumerate(texts())]
    return [*made, made[3], made[3], (5, "another text of one id", None, None, None), (None, "no id at all here", None, None, None)]


def test_middle(spark, table):
    docs = spark.createDataFrame(table, "doc_id long, text string, output string, form string, n long").repartition(3)
    out = middle.rearranged(docs)
    rows = out.collect()
    assert len(rows) == len(table)
    assert sorted(map(repr, map(tuple, rows))) == sorted(repr((r[0], *plain(r[0], r[1]))) for r in table)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    back = middle.restored(out, ["doc_id"]).collect()
    assert sorted(map(repr, map(tuple, back))) == sorted(repr((r[0], r[1] or "")) for r in table)
    assert middle.rearranged(docs.limit(0)).count() == 0


def test_rope_splits_anywhere_and_stays_balanced():
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "éé", "中文字"]) for _ in range(9000)) + "  "
    rope = next(middle.ropes(next(blocks(pa.array([text])))))
    units = UNIT.findall(text)
    assert rope.units == len(units) and rope.points == len(text)
    whole = rope
    for _ in range(60):  # cut and put together again, by either rank
        points = rng.random() < 0.5
        at = rng.randrange(1 + (whole.points if points else rope.units))
        a, b = whole.split(at, points)
        if points:
            assert middle.text_of(a).decode() == text[:at]
        whole = middle.Rope.joined(a, b)
        assert middle.text_of(whole).decode() == text
        assert whole.height <= 3 + 2 * np.log2(1 + sum(1 for _ in whole.pieces()))
    for at in (0, 1, 255, 256, 257, 5000, len(units)):
        a, b = rope.split(at)
        assert middle.text_of(a).decode() == "".join(units[:at]) and middle.text_of(b).decode() == "".join(units[at:])
        assert (a.units if a else 0) == at


def test_what_is_no_output_gives_null(spark):
    rows = [("psm", "<P>a<S>c"), ("psm", "<S>c<P>a<M>b"), ("spm", "x<S>c<P>a<M>b"), ("psm", "<P>a<S>c<M>b<M>"), ("other", "<P>a<S>c<M>b"), (None, "as is"), ("plain", None), ("psm", "<P><S><M>"), ("spm", "<S>c<P>a <M>b")]
    got = middle.restored(spark.createDataFrame(rows, "form string, output string").repartition(1), ["form", "output"]).collect()
    assert {(r.form, r.output): r.restored for r in got} == dict(zip(rows, [None] * 5 + ["as is", "", "", "a bc"]))


def test_sentinels_must_be_told_apart(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("ab", "ba", "c"), ("a", "xay", "c"), ("<P", "P>", "x")):
        with pytest.raises(ValueError):
            middle.rearranged(docs, sentinels=bad)
