"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from mobilis.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def plain_counts(table):
    n = collections.Counter()
    for name, text, *_ in table:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return n


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_rows(counts, least=3, factor=2):
    words = {w: n for w, n in counts.items() if n >= least}
    form, out = {}, {}
    for w, n in words.items():
        close = sorted((-words[v], v) for v in words if near(v, w))
        form[w] = close[0][1] if close and -close[0][0] >= factor * n else None
        out[w] = len(close)

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, out[w], words.get(form[w])) for w, n in words.items()), key=repr)


def table():
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdeéÿ×", k=rng.randint(5, 9))) for _ in range(25)] + ["aaaaaa", "ababab", "Straße", "NAÏVE"]
    words = list(base)
    for w in base:
        for _ in range(12):
            k = rng.randrange(len(w))
            words.append(rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcxé") + w[k:], w[:k] + rng.choice("abcxé") + w[k + 1 :], w.upper(), w[: k] + w[k + 1 :] + "x"]))
    weights = [rng.choice([1, 2, 5, 20, 60]) for _ in words]
    made = [(k, " ".join(w + rng.choice(["", ",", ".", "1", "ā", "中", "\n"]) for w in rng.choices(words, weights, k=rng.randrange(60))), "w", 1) for k in range(220)]
    made += [made[3], made[3], (7, "aaaaaa aaaaaa", "w", 1), (None, "aaaaaa Étage étage aaaaab", "w", 1), (900, None, "w", 1), (901, "", "w", 1), (902, "1 2 \n", "w", 1)]
    long = "ab" * 3000
    made += [(1000 + k, f"{long} {long}c {long[:50]}x{long[50:]} {'x' * 5000} {'x' * 4999}", "w", 1) for k in range(4)]
    made += [(2000, " ".join(rng.choices(words, k=20_000)), "w", 1)]
    made += [(3000 + k, "common " * 300, "w", 1) for k in range(40)]  # one word has a large part of all occurrences
    made += [(4000, "steps " * 90 + "stepsq " * 40 + "stepsqr " * 15 + "stepsqrs " * 5, "w", 1)]  # forms of forms of forms
    return made


SCHEMA = "doc_id long, text string, word string, n long"


def test_variants(spark):
    made = table()
    docs = spark.createDataFrame(made, SCHEMA).repartition(3)
    counts = {r.word: r.n for r in spelling.counted(docs).collect()}
    assert counts == plain_counts(made)
    got = spelling.variants(docs)
    rows = sorted(map(tuple, got.collect()), key=repr)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows == plain_rows(plain_counts(made))
    assert any(r[1] and r[1] != r[2] for r in rows) and max(r[4] for r in rows) > 5
    assert spelling.variants(docs.limit(0)).count() == 0


def test_variants_hold_when_hashes_collide(spark, monkeypatch):
    made = table()[:60]
    plain = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda words: (*(x := plain(words))[:3], x[3] & 63))
    rng = random.Random(2)
    words = sorted(plain_counts(made))[:80]
    rows = [(w, k, rng.randint(3, 9)) for k, w in enumerate(words)]
    keys = [r for r in zip(*(np.concatenate(x) for x in zip(spelling.deletion_keys([w for w, _, _ in rows]))))]
    assert len({int(r[3]) for r in keys}) <= 64
    batches = spark.createDataFrame([(int(k), int(kind), int(at), rows[o][1], rows[o][2], rows[o][0]) for o, kind, at, k in keys], "key long, kind byte, place int, id long, n long, word string")
    met = spelling._dealt(batches).mapInArrow(spelling._nearest, "id long, n_near long, best_n long, best string").collect()
    total = collections.Counter()
    for r in met:
        total[r.id] += r.n_near
    assert {w: total[k] for w, k, _ in rows} == {w: sum(near(v, w) for v in words) for w in words}


def test_checksums_and_deletion_hashes():
    rng = random.Random(3)
    words = ["".join(rng.choices("abé", k=rng.randrange(1, 120))) for _ in range(200)]
    data = np.frombuffer("".join(words).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in words])
    end = np.cumsum(size)
    begun = np.array([zlib.crc32(f"{k}:".encode()) for k in range(200)], dtype=np.uint32)
    assert spelling.checksums(data, end - size, end, begun).tolist() == [zlib.crc32(f"{k}:{w}".encode()) for k, w in enumerate(words)]
    whose, kind, place, key = spelling.deletion_keys(words)
    strings = {}
    for o, k, p, h in zip(whose, kind, place, key):
        w = words[o]
        what = (p if k == 0 else -1, w if p < 0 else w[:p] + w[p + 1 :])
        assert strings.setdefault(what, h) == h
    assert len(set(strings.values())) == len(strings)
    assert [sum((whose == o) & (kind == 1)) for o in range(200)] == [len({w[:k] + w[k + 1 :] for k in range(len(w))}) for w in words]


def test_other_words_and_options(spark):
    docs = spark.createDataFrame([(1, "abc abd abc abc ab abde 中文"), (2, "abc abd")], "doc_id long, text string")
    got = spelling.variants(docs, least_letters=2, least_count=1, slip=0).collect()
    assert sorted(map(tuple, got), key=repr) == plain_rows({"abc": 4, "abd": 2, "ab": 1, "abde": 1}, 1)
    with pytest.raises(ValueError):
        spelling.variants(docs, factor=1)
