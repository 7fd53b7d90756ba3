"""Operators on documents against brute force, on a small table with awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mobilis.llm import licenses, lines, minhash, mixing, packing, pii, quality, store
from mobilis.llm.shared import components, shared_folder
from mobilis.llm.tokens import Encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TABLES = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# extra columns whose names operators use inside or in results
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class string, rep long, `group` long, n_words string, row long, slot string"


def prose(rng, n):
    syllables = ["the", "ra", "ing", "ment", "shu", "ción", "lich", "eau", "or"]
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", ",", "."]) for w in words)


def rows():
    rng = random.Random(4)
    base = [prose(rng, rng.randint(30, 160)) for _ in range(25)]
    texts = list(base)
    for t in base[:10]:  # near copies of several degrees, and exact ones
        words = t.split(" ")
        for edits in (1, 2, 4):
            w = list(words)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
        texts += [t, t.upper()]
    shared = prose(rng, 60)
    texts += [f"{prose(rng, 30)}\n{shared}\n{prose(rng, 40)}" for _ in range(5)]
    texts += ["", " \n\t ", "one", "a b c d", "a b c d", "A B C D", "same line here\n" * 40, prose(rng, 20_000), "x" * 50_000, "1" * 3000, "a\n\n \n  b   c ", "　é\x1f <|endoftext|> it's"]
    texts += [
        "Write to a.b@mail.example.com, b@c.de_f@g.hi or 10.0.0.300 and 10.0.0.3!!",
        "Card 4111 1111 1111 1111 not 4111 1111 1111 1112, phone +1 (202) 555-0100 and (202) 555-0100 now",
        'key "b44e15e09fd311c3cf3163b66d5a9875b883d8ce" here\nReleased under the MIT License.',
        "Licensed under the Apache License, Version 2.0.",
    ]
    made = [(k, t, "en", f"s{k % 3}" if k % 7 else "big", len(t), "c", 1, 2, "w", 3, "s") for k, t in enumerate(texts)]
    made += [made[3], made[3], (1000, None, None, None, None, None, None, None, None, None, None), (None, base[1], "en", "s1", 1, None, None, None, None, None, None)]
    return made


@pytest.fixture(scope="module")
def table():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(t):
    w = WORD.findall(ascii_lower(t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(links, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_minhash(docs, table):
    sets = {r[0]: shingles(r[1]) for r in table if r[0] is not None}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = groups(links, ids)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(table)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_minhash_in_blocks(docs, monkeypatch):
    plain = sorted(map(str, minhash.near_duplicates(docs).collect()))
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 2)
    assert sorted(map(str, minhash.near_duplicates(docs).collect())) == plain


def test_estimate_corrects_for_chance():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 2**64, 400, dtype=np.uint64) for _ in range(2))
    both = np.concatenate([a[:300], b[:100]])
    one, many = (np.frombuffer(minhash.packed(minhash.minima(x)), np.uint8) for x in (a, both))
    assert abs(minhash.estimates(one, many[None, :])[0] - 0.6) < 0.2
    assert abs(minhash.estimates(one, np.frombuffer(minhash.packed(minhash.minima(b)), np.uint8)[None, :])[0]) < 0.2


def plain_verdict(row):
    """Id, base_failed, ratio, chunks, chunks outside their band, kept: text by text, limit by limit."""
    import math

    import zstandard

    def ratio(part):
        return len(part) / len(zstandard.ZstdCompressor(level=quality.LEVEL).compress(part))

    def inside(part):
        at = math.log2(len(part))
        pairs = list(zip(quality.BAND, quality.BAND[1:]))
        if at <= quality.BAND[0][0]:
            low, high = quality.BAND[0][1:]
        elif at >= quality.BAND[-1][0]:
            low, high = quality.BAND[-1][1:]
        else:
            (x, a, b), (y, c, d) = next((p, q) for p, q in pairs if p[0] <= at <= q[0])
            low, high = a + (c - a) * (at - x) / (y - x), b + (d - b) * (at - x) / (y - x)
        return low <= ratio(part) <= high

    text = row[1] or ""
    w, raw = WORD.findall(text), text.encode()
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    mark = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(mark) > 30 * len(w)
    if not raw:
        return row[0], failed, None, 0, 0, False
    parts = [raw[i : i + 2048] for i in range(0, len(raw), 2048)]
    outside = sum(not inside(p) for p in parts)
    return row[0], failed, ratio(raw), len(parts), outside, not failed and inside(raw) and 2 * outside <= len(parts)


def test_band_holds_the_fit(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = {at: (low, high) for at, low, high in quality.fit_band(docs, labels)}
    assert len(found) >= 8
    for at, low, high in quality.BAND:
        if at in found:
            assert low <= found[at][0] and found[at][1] <= high
    assert quality.fit_band(docs.limit(0), labels) == []


def test_quality(docs, table):
    got = quality.judge(docs).collect()
    assert len(got) == len(table)
    want = collections.Counter()
    for r in table:
        t = r[1] or ""
        w = WORD.findall(t)
        seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        mark = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        known, repeats = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                repeats += line in known
                known.add(line)
        want[(r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), repeats, len(mark), len(w) < 20 or 100 * len(mark) > 30 * len(w))] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert collections.Counter((r.doc_id, r.base_failed, r.ratio, r.n_chunks, r.n_chunks_outside, r.kept) for r in got) == collections.Counter(plain_verdict(r) for r in table)
    assert quality.keep_good(docs).count() == sum(r.kept for r in got)


def test_quality_keeps_good_prose(spark):
    got = {r.doc_id: r for r in quality.judge(spark.read.parquet(f"{TABLES}/documents.parquet")).collect()}
    good = [got[r.doc_id] for r in spark.read.parquet(f"{TABLES}/labels.parquet").where("quality = 1").collect()]
    assert all(r.kept for r in good if not r.base_failed)
    words = "".join(random.Random(0).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=9000))
    noise = spark.createDataFrame([(1, " ".join(words[i : i + 60] for i in range(0, 9000, 60))), (2, "one and the same thing again and so on. " * 200)], "doc_id long, text string")
    assert not any(r.kept for r in quality.judge(noise).collect())


def reference_ids(table, end):
    tok = Tokenizer.from_file(TOKENIZER)
    return [(r[0], [*tok.encode(r[1] or "", add_special_tokens=False).ids, end]) for r in table]


def test_encoder_on_random_blanks():
    rng = random.Random(2)
    alphabet = [" ", " ", " ", "\n", "\t", "a", "B", "'s", "1", "é", ".", ",", "　", "\x1f", "Ġ", "<|endoftext|>", "😀", " "]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 25))) for _ in range(4000)]
    tok = Tokenizer.from_file(TOKENIZER)
    want = [np.array(x.ids, "<u4").tobytes() for x in tok.encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(TOKENIZER)
    assert encoder.encode(texts) == want
    assert encoder.encode(texts[::-1]) == want[::-1]


def test_packing(docs, table):
    got = packing.pack(docs, TOKENIZER, with_ids=True, group_documents=20).collect()
    documents, bins = collections.Counter(), collections.defaultdict(list)
    parts = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        parts[(r.doc_id, r.doc_tokens, r.start)].append(bytes(r.ids))
    want = collections.Counter()
    for name, ids in reference_ids(table, 0):
        for at in range(0, len(ids), 1024):
            want[(name, len(ids), at, np.array(ids[at : at + 1024], "<u4").tobytes())] += 1
    for key, bodies in parts.items():
        for b in bodies:
            documents[(*key, b)] += 1
    assert documents == want
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_first_fit_decreasing_matches_a_scan():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 101, 300)
    bins, offsets = packing.first_fit_decreasing(sizes, 100)
    free = []
    for k in np.argsort(-sizes, kind="stable"):
        b = next((i for i, f in enumerate(free) if f >= sizes[k]), len(free))
        if b == len(free):
            free.append(100)
        assert (bins[k], offsets[k]) == (b, 100 - free[b])
        free[b] -= sizes[k]


def test_sequences(docs):
    packed = packing.pack(docs, TOKENIZER, with_ids=True)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == 4 * r.length
        assert r.padded_length == (r.length if r.length & (r.length - 1) == 0 else 1024)


def test_store(spark, docs, table):
    path = shared_folder(spark)
    store.write_store(docs, path, TOKENIZER)
    got = store.read_summary(spark, path).orderBy("start").collect()
    want = collections.Counter((name, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for name, ids in reference_ids(table, 2))
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    names = [r.doc_id for r in got]
    assert names == sorted(names, key=lambda x: (x is not None, x))
    bodies = collections.Counter((r.doc_id, bytes(r.ids)) for r in store.read_documents(spark, path).collect())
    assert bodies == collections.Counter((name, np.array(ids, "<u4").tobytes()) for name, ids in reference_ids(table, 2))
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("key").distinct().count()


def local_copy(spark, path, tmp_path, name):
    """A copy of a store in a folder of the test, with the path to give to Spark."""
    import shutil

    place = tmp_path / name
    shutil.copytree(path.removeprefix("file:"), place)
    return place, f"file:{place}"


def test_damaged_store_is_refused(spark, docs, tmp_path):
    path = shared_folder(spark)
    store.write_store(docs.repartition(4), path, TOKENIZER)
    want = store.read_summary(spark, path).count()
    assert want == docs.count()

    place, there = local_copy(spark, path, tmp_path, "lost_recipes")
    next((place / "recipes").glob("part-*.parquet")).unlink()
    for read in (store.read_summary, store.read_documents):
        with pytest.raises(Exception, match="not as the manifest tells|not exist|infer"):
            read(spark, there).collect()

    place, there = local_copy(spark, path, tmp_path, "added_recipes")
    some = next((place / "recipes").glob("part-*.parquet"))
    some.with_name("part-99999-more.parquet").write_bytes(some.read_bytes())
    with pytest.raises(ValueError, match="not as the manifest tells"):
        store.read_summary(spark, there)

    place, there = local_copy(spark, path, tmp_path, "altered_recipes")
    changed = spark.read.parquet(f"{path}/recipes").withColumn("n_ids", F.col("n_ids") + 1)
    changed.write.mode("overwrite").parquet(f"{there}/recipes")
    with pytest.raises(ValueError, match="not as the manifest tells"):
        store.read_summary(spark, there)

    place, there = local_copy(spark, path, tmp_path, "lost_chunk")
    chunks = spark.read.parquet(f"{path}/chunks")
    one = chunks.orderBy("key").first()
    chunks.where(F.col("key") != F.lit(one.key)).write.mode("overwrite").parquet(f"{there}/chunks")
    for read in (store.read_summary, store.read_documents):
        with pytest.raises(Exception, match="does not follow from its chunks"):
            read(spark, there).collect()

    place, there = local_copy(spark, path, tmp_path, "altered_chunk")
    body = bytearray(one.body)
    body[0] ^= 1
    altered = chunks.withColumn("body", F.when(F.col("key") == F.lit(one.key), F.lit(bytes(body))).otherwise(F.col("body")))
    altered.write.mode("overwrite").parquet(f"{there}/chunks")
    for read in (store.read_summary, store.read_documents):
        with pytest.raises(Exception, match="does not hold what its digest says|does not follow from its chunks"):
            read(spark, there).collect()


def test_boundaries_of_a_batch_are_those_of_its_documents():
    rng = np.random.default_rng(4)
    sizes = [1, 5, 70, 3000, 9, 1024, 4096, 64, 2, 600]
    docs_ = [rng.integers(0, 60000, n).astype("<u4") if n != 3000 else np.full(n, 7, "<u4") for n in sizes]
    starts = [0, *np.cumsum(sizes).tolist()[:-1]]
    got = store.boundaries(np.concatenate(docs_), starts)
    for ids, start, stops in zip(docs_, starts, got, strict=True):
        assert [s - start for s in stops] == store.boundaries(ids, [0])[0]
        assert stops[-1] == start + len(ids)
        lengths = np.diff([start, *stops])
        assert (lengths <= store.MOST).all() and (lengths > 0).all()


def test_encoder_forgets_and_goes_on(monkeypatch):
    from mobilis.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_WORDS", 20)
    rng = np.random.default_rng(8)
    texts = [" ".join("".join(rng.choice(list("abcdeé.,'"), rng.integers(1, 9))) for _ in range(60)) for _ in range(12)]
    encoder = Encoder(TOKENIZER)
    for _ in range(2):
        for t in texts:
            assert encoder.encode([t]) == encoder.whole([t])


def test_encoder_of_another_vocabulary_encodes_whole():
    import public_tokenizers

    encoder = Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Some words, in a text.\nAnother line", None, ""]
    assert encoder.memo is None
    assert encoder.encode(texts) == encoder.whole([t or "" for t in texts])


def test_crc_of_joined_strings():
    for n in (0, 1, 4, 100, 1000):
        a, b = b"abc" * 7, bytes(range(200)) * 6
        assert store.joined_crc(zlib.crc32(a), zlib.crc32(b[:n]), n) == zlib.crc32(a + b[:n])


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_patterns():
    rng = random.Random(2)
    texts = ["".join(rng.choices("a1.@+- ()_x9", k=40)) for _ in range(5000)] + [r[1] or "" for r in rows()]
    assert all(pii.pattern_spans(t) == plain_spans(t) for t in texts)


def test_random_field():
    model = pii.train(pii.labelled_rows())
    right = n = 0
    for line, labels in pii.labelled_rows(200, seed=99):
        (block,) = pii.blocks(pii.pa.array([line]))
        found = pii.block_labels(block, model)
        right += sum(pii.LABELS[a] == b for a, b in zip(found, labels.split(" "), strict=True))
        n += len(found)
    assert right / n > 0.98
    # cutting at sure words does not change the best labelling of a line
    rng = np.random.default_rng(1)
    scores, step = rng.normal(size=(7, 6)), rng.normal(size=(6, 6))
    import itertools

    def total(p):
        return step[0, p[0]] + sum(scores[i, x] for i, x in enumerate(p)) + sum(step[a, b] for a, b in itertools.pairwise(p)) + step[p[-1], 0]

    best = max(itertools.product(range(6), repeat=4), key=total)
    assert tuple(pii.viterbi(scores, step, np.array([0]), np.array([4]))[:4]) == best


def test_pii(docs, table):
    model = pii.train(pii.labelled_rows())
    got = pii.find(docs, model).collect()
    assert len(got) == len(table)
    texts = {r[0]: r[1] or "" for r in table}
    for r in got:
        if r.doc_id is not None:
            base = plain_spans(texts[r.doc_id])
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in base) for k in PATTERNS)
            assert r.base_sha256 == pii.hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    found = {r.doc_id: r.spans for r in got}
    key = next(i for i, t in texts.items() if t.startswith("key "))
    assert found[key] == "secret:5:45"
    hidden = {r.doc_id: r for r in pii.mask(docs, model).collect()}
    assert len(hidden) == len({r[0] for r in table}) and hidden[key].text.startswith('key "[SECRET]" here') and hidden[key].n_chars == len(hidden[key].text)
    assert hidden[0].text == texts[0] and hidden[1000].text is None


def nested_units(text, least_words):
    """(whole, start, end, first sentence, one past the last, words) of every unit, and the number of lines."""
    sentences, lines_, at = [], [], 0
    for line in text.split("\n"):
        mine, pos = [], 0
        for piece in re.split(r"(?<=[.!?])([ \t]+)(?=[^ \t])", line):
            words = WORD.findall(ascii_lower(piece))
            if words:
                mine.append((at + pos, at + pos + len(piece), words))
            pos += len(piece)
        lines_.append(range(len(sentences), len(sentences) + len(mine)))
        sentences += mine
        at += len(line) + 1
    out, n_lines, paragraph = {}, 0, []
    for own in [*lines_, range(0)]:
        words = [w for k in own for w in sentences[k][2]]
        if own:
            paragraph.append(own)
            long = len(words) >= least_words
            n_lines += long
            for k in own:
                out.setdefault((k, k + 1), (False, *sentences[k]))
            if long:
                out[own[0], own[-1] + 1] = (True, sentences[own[0]][0], sentences[own[-1]][1], words)
        elif paragraph:
            a, b = paragraph[0][0], paragraph[-1][-1] + 1
            words = [w for k in range(a, b) for w in sentences[k][2]]
            if len(words) >= least_words:
                out[a, b] = (True, sentences[a][0], sentences[b - 1][1], words)
            paragraph = []
    return n_lines, [(*found[:3], a, b, tuple(found[3])) for (a, b), found in out.items()]


def brute_lines(table, least_words, run_words):
    cut = [(r[0], k, *nested_units(r[1] or "", least_words)) for k, r in enumerate(table)]
    seen = collections.defaultdict(list)
    for name, k, _, found in cut:
        for u in found:
            seen[u[5]].append((name is None, name or 0, k, u[1]))

    def runs(flagged):
        most = [u for u in flagged if not any(v is not u and v[3] <= u[3] and u[4] <= v[4] for v in flagged)]
        out = []
        for u in sorted(most, key=lambda u: u[3]):
            if out and out[-1][-1][4] == u[3]:
                out[-1].append(u)
            else:
                out.append([u])
        return [(sum(len(u[5]) for u in r), r) for r in out]

    for name, k, n_lines, found in cut:
        later = [u for u in found if min(seen[u[5]]) != (name is None, name or 0, k, u[1])]
        elsewhere = [u for u in found if len({x[2] for x in seen[u[5]]}) > 1]
        gone = [u for n, r in runs(later) for u in r if u[0] or n >= run_words]
        again = [(n, len(r)) for n, r in runs(elsewhere) if n >= run_words]
        yield name, n_lines, len(gone), sum(u[2] - u[1] for u in gone), ",".join(f"{u[1]}:{u[2]}" for u in gone), sum(r for _, r in again), sum(n for n, _ in again), bool(again)


def line_rows():
    rng = random.Random(12)

    def passage(n):
        words = prose(rng, n).replace(",", "").replace(".", "").split(" ")
        return " ".join(w + "." if k % 9 == 8 or k == n - 1 else w for k, w in enumerate(words))

    shared = [passage(60), passage(75), passage(12)]
    out = []
    for k in range(40):
        parts = [passage(rng.randint(5, 40)) for _ in range(3)]
        p = shared[k % 3]
        text = [
            f"{parts[0]} and {p} {parts[1]}\n\n{parts[2]}",  # inside a line
            f"{parts[0]}\n{p}\n{parts[1]}",
            f"{parts[0]}\n\n" + p.replace(". ", ".\n") + f"\n\n{parts[1]}",  # broken into lines
            f"{parts[0]}\n\nYes. No!  Yes.\n \nstock phrase.\n{p.upper()}",
            "\n".join(parts),
        ][k % 5]
        out.append((k if k % 9 else None, text))
    return [*out, out[5], out[5], (7, "other text under an id that repeats. Yes."), (50, None), (51, ""), (52, " \n\t\n "), (53, "Yes. " * 400), (54, ". . ."), (55, "a." + "b" * 30_000 + ". " + shared[0])]


@pytest.mark.parametrize("least_words", [1, 25])
def test_lines_as_by_brute_force(spark, docs, table, least_words):
    columns = ["doc_id", "n_lines", "n_removed", "chars_removed", "removed", "n_repeated", "repeated_words", "has_passage"]
    for rows_, frame in ((table, docs), (line_rows(), spark.createDataFrame(line_rows(), "doc_id long, text string").repartition(1))):
        got = lines.repeated_lines(frame, least_words=least_words).select(*columns).collect()
        want = collections.Counter(brute_lines(rows_, least_words, lines.RUN_WORDS))
        assert collections.Counter(map(tuple, got)) == want


def test_passages_inside_lines_are_found(spark):
    made = line_rows()
    got = lines.repeated_lines(spark.createDataFrame(made, "doc_id long, text string"), least_words=1).collect()
    found = {r.doc_id: r for r in got}
    texts = dict(made)
    for k in range(40):
        if k % 9 and k != 7:
            # the third passage is too short; a passage inside a line or not is found in all its documents
            assert found[k].has_passage == (k % 5 != 4 and k % 3 != 2) or k == 5
            left = lines.without(texts[k], found[k].removed)
            assert len(left) <= len(texts[k]) and found[k].chars_removed >= 0
    assert lines.without("ab\ncd\nef", "3:5") == "ab\nef"
    assert lines.without("One. Two.\nThree.", "5:9") == "One. \nThree."


def test_short_lines_and_paragraphs(spark, tmp_path):
    from mobilis.llm import registry

    made = [
        (1, "One two\nthree four.\n\nown words here\nshared line"),
        (2, "before\n \none TWO three\nfour.\n\nother"),  # a paragraph of 1, broken elsewhere
        (3, "Shared  line\nmine\n\none two"),
        (4, "three\n\nthree\nyes"),
        (None, "one two three four."),
    ]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in registry.op9_lines(spark, str(tmp_path)).collect()}
    texts = dict(made)
    left = {k: lines.without(texts[k], r.removed) for k, r in got.items()}
    assert left == {1: texts[1], 2: "before\n \n\nother", 3: "mine\n\n", 4: "three\n\nyes", None: ""}
    assert (got[2].n_lines, got[2].n_removed, got[2].chars_removed) == (4, 1, 19)


def test_licenses(spark):
    made = [
        (1, "Licensed under the Apache License, Version 2.0.", "repo/LICENSE"),
        (2, "some text of no licence", "repo/src/deep/a.py"),
        (3, "Released under the MIT License.", "repo/src/COPYING"),
        (4, "plain words\nLicensed under CC BY-NC 4.0.", "repo/b.txt"),
        (5, "plain words", "other/c.txt"),
        (6, None, "repo/d.txt"),
        (7, "", None),
        (None, "plain", "top"),
    ]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string, path string"), "path").collect()}
    assert {k: r.license for k, r in got.items()} == {1: "Apache-2.0", 2: "MIT", 3: "MIT", 4: "CC-BY-NC-4.0", 5: None, 6: "Apache-2.0", 7: None, None: None}
    assert got[2].inherited_from == "repo/src/COPYING" and got[4].inherited_from is None


#: Sentences written by hand, from no generator, with all that is personal in them.
HELD = [
    ("Please reach Dr. Smith at (334) 844-1000 before noon, or leave a note at the desk.", [("phone", "(334) 844-1000")]),
    ("The office moved in 2019; its old number, 205-555-0147, no longer works.", [("phone", "205-555-0147")]),
    ("Call +44-161-4960000 from abroad. Rates start at $120.50 for 3 nights.", [("phone", "+44-161-4960000")]),
    ("Orders ship in 2-3 days; order 20240117 left on 2024-01-17 at 14:05.", []),
    ("Our server at 10.12.0.7 answered in 35 ms, up from version 4.2.", [("ip", "10.12.0.7")]),
    ("He wrote to jane_doe+lists@mail.example.co.uk twice, she said.", [("email", "jane_doe+lists@mail.example.co.uk")]),
    ("Pay with 4111 1111 1111 1111 today; refunds take 5 days.", [("card", "4111 1111 1111 1111")]),
    ("The token 9f86d081884c7d659a2feaa0c55ad015 was rotated last week.", [("secret", "9f86d081884c7d659a2feaa0c55ad015")]),
    ("Set the key to sk_4eC39HqLyjWDarjtT1zdp7dc and restart.", [("secret", "sk_4eC39HqLyjWDarjtT1zdp7dc")]),
    ("Chapter 12 covers pages 310-342, see Table 7 and Figure 3.2 there.", []),
    ("In 1998 about 1,250 people, or 37% of them, came by train.", []),
    ("A build of commit 2fd4e1c67a2d28fced849ee1bb76e7391b93eb12 failed on Friday.", [("secret", "2fd4e1c67a2d28fced849ee1bb76e7391b93eb12")]),
    ("Meet at 5:30 p.m. in Room B-204, second floor; bring form W-9.", []),
    ("Phone: (919) 555-0188. Fax: none. Web: www.example.org/contact", [("phone", "(919) 555-0188")]),
    ("She ran the 100 m in 11.52 s and the 200 m in 23.4 s.", []),
    ("Mail o'brien@example.ie about lot 77-B.", [("email", "brien@example.ie")]),
]


def test_personal_data_in_sentences_written_by_hand():
    import pyarrow as pa

    found = pii.column_spans(pa.array([t for t, _ in HELD]), pii.train(pii.labelled_rows()))
    right = sum(sorted({(k, text[a:b]) for k, a, b in base + new}) == sorted(want) for (_, want), (text, base, new) in zip(HELD, found, strict=True))
    assert right >= 15


def license_rows():
    rng = random.Random(21)
    texts = [t for own in licenses.STATEMENTS.values() for t in own]
    openings = [t for own in licenses.OPENINGS.values() for t in own]
    made = []
    for k, t in enumerate(texts):
        noise = prose(rng, rng.randint(0, 60))
        made.append([t, f"{noise} {t} {noise}", f"Copyright (c) 2020 A. Holder\n\n{t}", t.replace(" ", "\n# ", 9), " ".join(w for w in t.split(" ") if rng.random() > 0.2), t[: len(t) // 2]][k % 6])
    made += [f"{t}\n\nPreamble. {prose(rng, 300)}" for t in openings]
    made += [f"{prose(rng, 40)} {t} {prose(rng, 40)}" for t in openings]
    made += [prose(rng, 50), "", "license license license", f"{prose(rng, 1500)} Released under the MIT License {prose(rng, 1500)}", "the MIT the Apache the public domain", "x" * 5000]
    out = [(k, t, "/".join(["r", *rng.choices("abc", k=rng.randint(0, 4)), f"f{k}"])) for k, t in enumerate(made)]
    return [*out, out[3], out[3], (None, made[0], "r/a/LICENSE"), (900, None, "r/b/x"), (901, made[0], None), (902, "plain", "top"), (903, "plain", ""), (904, "plain", "/abs/x")]


def test_licenses_as_by_brute_force(spark):
    """Every window of every template's length, and a walk up the directories."""
    import math

    table_ = license_rows()
    forms = [(name, False, licenses.terms(t)) for name, own in licenses.STATEMENTS.items() for t in own] + [(name, True, licenses.terms(t)) for name, own in licenses.OPENINGS.items() for t in own]
    known = {t for _, _, own in forms for t in own}
    counts = collections.Counter(t for _, text, _ in table_ for t in set(licenses.terms(text or "")) & known)
    weight = collections.defaultdict(lambda: 1 + math.log(len(table_) + 1), {t: 1 + math.log((len(table_) + 1) / (counts[t] + 1)) for t in known})

    def vector(words):
        raw = {t: k * weight[t] for t, k in collections.Counter(words).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        return {t: v / norm for t, v in raw.items()}

    vectors = [(name, opening, own, vector(own)) for name, opening, own in forms]

    def cosine(words, of):
        v = vector(words)
        return sum(x * v.get(t, 0.0) for t, x in of.items())

    def fits(words, start, size, name, own):
        window = set(words[start : start + size])
        telling = licenses.VARIANTS | (licenses.VERSIONS if name.startswith(licenses.VERSIONED) else set())
        begin = next((i for i in range(start, max(0, start - len(own)), -1) if words[i - 1] not in own or words[i - 1] in licenses.NEGATIONS), max(0, start - len(own)))
        return all((t in window) == (t in own) for t in telling) and sum(t in licenses.NEGATIONS for t in words[start : start + size]) <= sum(t in licenses.NEGATIONS for t in own) and not any(t in licenses.NEGATIONS for t in words[max(0, begin - 2) : begin])

    def judged(text):
        words = licenses.terms(text or "")
        best, file = (0.0, 0, None), False
        for name, opening, own, of in sorted(vectors, key=lambda f: f[0]):
            if not words:
                continue
            size = len(own)
            scores = [cosine(words[i : i + size], of) if any(w in of for w in words[i : i + size]) and fits(words, i, size, name, own) else 0.0 for i in range(max(1, len(words) - size + 1))]
            score, start = max(scores), scores.index(max(scores))
            if len(words) <= size + 12:
                whole = cosine(words, of) if score and fits(words, 0, len(words), name, own) else 0.0
                score = max(score, whole)
                file |= score >= licenses.THRESHOLD
            file |= opening and score >= licenses.THRESHOLD and start < licenses.OPENING_TERMS
            if score > best[0] + 1e-12 or (score > best[0] - 1e-12 and score and size > best[1]):
                best = (score, size, name)
        return (best[2], round(best[0], 6), file) if best[0] >= licenses.THRESHOLD else (None, None, False)

    own = [(k, path, *judged(t)) for k, t, path in table_]
    grants = {}
    for _, path, name, _, file in own:
        if file and path is not None:
            folder = path.rpartition("/")[0]
            grants[folder] = min(grants.get(folder, (path, name)), (path, name))

    def inherited(path):
        while path is not None:
            path = path.rpartition("/")[0]
            if path in grants:
                return grants[path]
            if not path:
                return None, None
        return None, None

    want = collections.Counter()
    for k, path, name, score, file in own:
        source, granted = inherited(path)
        want[(k, path, name, score, file, name or granted, None if name else source)] += 1
    columns = ["doc_id", "path", "own_license", "score", "is_license_file", "license", "inherited_from"]
    frame = spark.createDataFrame(table_, "doc_id long, text string, path string").withColumn("dir", F.lit("clash")).withColumn("file", F.lit(1)).withColumn("n_rows", F.lit(2))
    got = collections.Counter(tuple(r) for r in licenses.scan(frame.repartition(3), "path").select(*columns).collect())
    assert got == want
    assert len({w[2] for w in want}) > 12 and sum(w[4] for w in want) > 20


LGPL = "This library is free software{} you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
#: Texts written by hand, each with the licence that it states.
STATED = [
    (LGPL.format(":", ",", "3"), "LGPL-3.0"),
    (LGPL.format(";", ";", "2.1"), "LGPL-2.1"),
    (LGPL.format(":", ",", "3").replace("Lesser ", ""), "GPL-3.0"),
    (LGPL.format(":", ",", "3").replace("Lesser", "Affero"), "AGPL-3.0"),
    (LGPL.format(";", ";", "2").replace("Lesser ", ""), "GPL-2.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "CC-BY-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", None),
    ("This file is not licensed under the Apache License, Version 2.0.", None),
    ("Never licensed under the Apache License, Version 2.0.", None),
    ("This file is not " + licenses.STATEMENTS["Apache-2.0"][1].replace("L", "l", 1), None),
    ("Nothing here is released under the MIT License without consent.", "MIT"),
    ("This is not released under the MIT License", None),
    ("Licensed under the Boost Software License, Version 1.0", "BSL-1.0"),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("SPDX-License-Identifier: LGPL-3.0-or-later", "LGPL-3.0"),
    ("SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0"),
    ("// SPDX-License-Identifier: MIT", "MIT"),
]


def test_versions_and_variants_are_told_apart():
    w = licenses.weigh(10_000, {}, licenses.THRESHOLD)
    for text, name in STATED:
        score, found, _ = licenses.best_match(text, w, licenses.THRESHOLD)
        assert (found if score >= licenses.THRESHOLD else None) == name, text
        # the same inside a long file, which is then no licence file
        score, found, file = licenses.best_match("some words of code come first and go on. " * 50 + text + " more words of code follow here. " * 50, w, licenses.THRESHOLD)
        assert (found if score >= licenses.THRESHOLD else None) == name and not (name and file), text
    header = licenses.STATEMENTS["Apache-2.0"][1]
    source = f"# {header}\nimport os\nfor name in os.listdir('.'): print(name.upper(), os.stat(name).st_size, end='')"
    assert licenses.best_match(source, w, licenses.THRESHOLD)[1:] == ("Apache-2.0", False)
    assert licenses.best_match(f"Copyright 2020 Somebody\n\n{header}", w, licenses.THRESHOLD)[1:] == ("Apache-2.0", True)


def test_whole_licences_license_their_directory(spark):
    mit = licenses.STATEMENTS["MIT"][1]
    made = [(1, f"MIT License\n\nCopyright (c) 2021 Somebody\n\n{mit}", "a/LICENSE"), (2, "code", "a/src/x.py"), (3, f"// {licenses.STATEMENTS['Apache-2.0'][1]}\n\nint main() {{ return 0; }} " + "call(); " * 300, "b/y.c"), (4, "code", "b/z.c")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(made, "doc_id long, text string, path string"), "path").collect()}
    assert {k: (r.license, r.is_license_file) for k, r in got.items()} == {1: ("MIT", True), 2: ("MIT", False), 3: ("Apache-2.0", False), 4: (None, False)}


def test_mixing(spark, docs, table):
    got = mixing.mix(docs, power=0.5, block_units=500, period=50).collect()
    assert len(got) == len(table)
    n = {}
    for r in got:
        n.setdefault(r.source, set()).add(r.block)
        assert r.release <= r.slot < r.deadline
    weights = spark.createDataFrame([(0, "a", 5.0), (0, "b", 3.0), (0, "c", 2.0)], "team int, source string, weight double")
    plan = mixing.schedule(mixing.shares(weights, 10)).orderBy("slot").collect()
    assert [r.slot for r in plan] == list(range(150))
    done = collections.Counter()
    for r in plan:  # never a whole block from the share
        done[r.source] += 1
        for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
            assert abs(done[s] - share * (r.slot + 1)) < 1


def test_mixing_by_given_weights(spark, docs, table):
    given = spark.createDataFrame([("big", 3.0), ("s0", 1.0), ("s0", 2.0), ("s1", 0.0), (None, None)], "source string, weight double")
    got = mixing.mix(docs, weights=given, block_units=300).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(r[0] for r in table)
    period, n = 1000, {}
    for name, w in (("big", 3.0), ("s0", 2.0), ("s1", 2.0), ("s2", 2.0), (None, 2.0)):
        n[name] = round(w / 11 * period)
    whole = sum(n.values())
    for r in got:
        assert r.release == r.block * whole // n[r.source] and r.deadline == -(-(r.block + 1) * whole // n[r.source])
        assert r.release <= r.slot < r.deadline


def test_mixing_of_long_documents_in_characters(spark):
    rng = random.Random(6)
    made = [(k, "x" * rng.choice([0, 10, 80, 350]), "abc"[min(k % 7, 2)]) for k in range(400)]
    got = mixing.mix(spark.createDataFrame(made, "doc_id long, text string, source string"), block_units=100).collect()
    size = {k: len(t) for k, t, _ in made}
    total = collections.Counter()
    for k, _, s in made:
        total[s] += size[k]
    share = {s: total[s] / sum(total.values()) for s in total}
    done = collections.Counter()
    by_slot = collections.defaultdict(list)
    for r in got:
        by_slot[r.slot].append(r)
    for slot in range(max(by_slot) + 1):
        for r in by_slot[slot]:
            done[r.source] += size[r.doc_id]
        for s in share:  # a block, and the length of the longest document
            assert abs(min(share[s] * 100 * (slot + 1), total[s]) - done[s]) < 100 + 350 + 0.002 * 100 * slot


def test_mixing_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 60)
    made = spark.range(9000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 200)) AS source")
    got = mixing.mix(made, block_units=100).select("source", "slot", "block").collect()
    slots = sorted(r.slot for r in got)
    assert len(set(slots)) == len(got) == 9000
    half = [r.source for r in got if r.slot < 4500]
    count, whole = collections.Counter(half), collections.Counter(r.source for r in got)
    assert len(whole) > 180
    for s, n in whole.items():  # two blocks, and what rounding moves
        assert abs(count[s] - n / 2) < 2 + 0.03 * n


def test_mixing_in_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_SOURCES", 5)
    made = spark.range(9000).selectExpr("id AS doc_id", "repeat('x', 100) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 200)) AS source")
    got = mixing.mix(made, block_units=100).select("source", "slot", "block").collect()
    assert len({r.slot for r in got}) == len(got) == 9000
    half = sorted(r.slot for r in got)[4500]
    count, whole = collections.Counter(r.source for r in got if r.slot < half), collections.Counter(r.source for r in got)
    for s, n in whole.items():  # a block for each of four levels, and what rounding moves in each
        assert abs(count[s] - n / 2) < 4 + 0.05 * n


def test_a_source_with_most_rows_meets_its_slots_in_many_tasks(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        made = spark.range(40_000).selectExpr("id AS doc_id", "repeat('x', 10) AS text", "if(id % 3 = 0, 'hot', concat('s', id % 50)) AS source")
        sizes = [r.n for r in mixing.mix(made).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sum(sizes) == 40_000 and max(sizes) < 13_000  # the source alone has 13,334


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, k) for k in range(501, 560)]
    want = groups(links, {x for e in links for x in e if e[0] != e[1]} | {x for e in links for x in e})
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in links)}


def test_empty_tables(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    assert quality.judge(empty).count() == quality.keep_good(empty).count() == 0
    assert packing.pack(empty, TOKENIZER).count() == 0
    assert pii.find(empty).count() == pii.mask(empty).count() == 0
    assert lines.repeated_lines(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert licenses.scan(empty.withColumn("path", empty["source"]), "path").count() == 0
    path = shared_folder(spark)
    store.write_store(empty, path, TOKENIZER)
    assert store.read_summary(spark, path).count() == store.read_documents(spark, path).count() == 0


def earliest_deadline_first(n):
    """source -> slot of each of its blocks in a period, slot by slot."""
    period, done, out = sum(n.values()), dict.fromkeys(n, 0), {k: [] for k in n}
    order = sorted(n, key=lambda s: (s is not None, s))
    for t in range(period):
        ready = [(-(-(done[s] + 1) * period // n[s]), order.index(s), s) for s in n if done[s] < n[s] and done[s] * period // n[s] <= t]
        s = min(ready)[2]
        out[s].append(t)
        done[s] += 1
    return period, out


def mixed_order(rows_):
    """(slot, unit_start) of each row (id, text, source) with distinct ids, worked out source by source."""
    from hashlib import md5

    by = collections.defaultdict(list)
    for k, text, source in rows_:
        by[source].append((md5(str(k).encode()).hexdigest(), k, text))
    size = {s: max(1, sum(len(t) for _, _, t in own)) for s, own in by.items()}
    total = sum(v**0.7 for v in size.values())
    n = {s: max(1, math.floor(v**0.7 / total * max(1000, 50 * len(size)) + 0.5)) for s, v in size.items()}
    period, slots = earliest_deadline_first(n)
    out = {}
    for s, own in by.items():
        at = 0
        for _, k, text in sorted(own):
            block = at // mixing.BLOCK_UNITS
            out[k] = (block // n[s] * period + slots[s][block % n[s]], at)
            at += len(text)
    return out


def in_file_order(frame):
    rows_ = frame.select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    return sorted(rows_, key=lambda r: (r.f, r.i))


def test_pipeline_stage_by_stage(spark, docs, table, tmp_path):
    """Each stage against a plain version of it, on what the stage before kept."""
    import corpus_pipeline
    from mobilis.llm.shared import stored

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    real = spark.read.parquet(f"{TABLES}/documents.parquet").select(*columns)
    more = docs.where("doc_id IS NOT NULL").select((F.col("doc_id") + 1_000_000).alias("doc_id"), *columns[1:]).dropDuplicates(["doc_id"])
    now = real.unionByName(more)
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stored(stage(spark, now, ""))
        assert now.columns == columns
        kept[name] = now

    first = real.unionByName(more).collect()
    good = [r for r in first if plain_verdict((r.doc_id, r.text))[-1]]
    assert sorted(map(tuple, kept["quality_rules"].collect()), key=str) == sorted(map(tuple, good), key=str)
    assert len(good) > 100

    sets = {r.doc_id: shingles(r.text) for r in good}
    ids = sorted(sets)
    sizes = {k: len(v) for k, v in sets.items()}
    links = [(x, y) for x in ids for y in ids if x < y and 100 * min(sizes[x], sizes[y]) >= 80 * max(sizes[x], sizes[y]) and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    root = groups(links, ids)
    single = [r for r in good if root[r.doc_id] == r.doc_id]
    assert sorted(map(tuple, kept["minhash_dedup"].collect()), key=str) == sorted(map(tuple, single), key=str)
    assert len(single) < len(good)

    spans = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(single, kept["pii"].schema)).collect()}

    def hidden(text, found):
        marks = sorted((int(a), -int(b), kind) for kind, a, b in (x.split(":") for x in found.split(",") if x))
        out, last = "", 0
        for a, b, kind in marks:
            if a >= last:
                out += text[last:a] + f"[{kind.upper()}]"
            last = max(last, -b)
        return out + text[last:]

    want = {r.doc_id: hidden(r.text, spans[r.doc_id]) for r in single}
    got = kept["pii"].collect()
    assert {r.doc_id: r.text for r in got} == want and sum(want[r.doc_id] != r.text for r in single) > 3
    assert all(r.n_chars == len(r.text) for r in got if r.text != next(x.text for x in single if x.doc_id == r.doc_id))

    order = mixed_order([(r.doc_id, r.text, r.source) for r in got])
    mixed = in_file_order(kept["mixing"])
    assert [r.doc_id for r in mixed] == sorted(order, key=lambda k: order[k])

    tok = Tokenizer.from_file(TOKENIZER)
    ids_of = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 0] for r in mixed}
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    covered = collections.defaultdict(list)
    filled = collections.defaultdict(list)
    for r in packed:
        part = ids_of[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids_of[r.doc_id])
        covered[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id].append((r.offset, r.length))
    for k, parts in covered.items():
        assert [a for a, _ in sorted(parts)] == [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()[:-1]] and sum(n for _, n in parts) == len(ids_of[k])
    assert set(covered) == set(ids_of)
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024

    spark.createDataFrame(first, real.schema).write.parquet(f"{tmp_path}/documents.parquet")
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, whole)) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed)


def test_stages_with_bad_ids(spark):
    from mobilis.llm import stages

    rng = random.Random(8)
    a, b, c, d, e = (prose(rng, 80) for _ in range(5))
    made = [(1, a), (5, a), (5, b), (7, c), (7, c), (8, ""), (None, b), (None, d), (None, d), (None, d + " end"), (None, e)]
    table = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in made], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = stages.minhash_dedup(spark, table, "")
    assert got.columns == table.columns
    left = sorted(((r.doc_id, r.text[:20]) for r in got.collect()), key=str)
    assert left == sorted([(1, a[:20]), (5, b[:20]), (7, c[:20]), (8, ""), (None, d[:20]), (None, e[:20])], key=str)

    many = [(None if k % 2 else k % 5, f"{k} " + "x" * 70_000, "en", f"s{k % 3}", 1) for k in range(60)]
    mixed = stages.mix_sources(spark, spark.createDataFrame(many, table.schema).repartition(3), "")
    parts = mixed.rdd.glom().collect()
    assert sorted(r.text for x in parts for r in x) == sorted(t for _, t, *_ in many)
    # rows without an id lie in all parts, no source in a lump
    assert len(parts) == 4 and all(sum(r.doc_id is None for r in x) >= 2 and len({r.source for r in x}) == 3 for x in parts)
