"""op5 and op8 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from corvex.llm import substring_dedup, suffix_array
from corvex.llm.repeats import Plan


def covered(rows, width):
    first = {}
    for i, s in sorted(((i, s) for i, s in rows if i is not None), key=lambda r: r[0]):
        for k in range(len(s) - width + 1):
            first.setdefault(s[k : k + width], i)
    for i, s in rows:
        out = np.zeros(len(s), bool)
        for k in range(len(s) - width + 1):
            if first.get(s[k : k + width], float("inf")) < (float("inf") if i is None else i):
                out[k : k + width] = True
        yield out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 150))) for _ in range(40)]
    rows = list(enumerate(texts))
    for i in range(40, 80):
        a, b = rng.choice(texts), rng.choice(texts)
        cut = rng.randrange(len(a) + 1)
        rows.append((i, b[: rng.randint(0, 90)] + a[cut : cut + rng.randint(30, 400)] + rng.choice(["", "ab" * 90, b[-70:]])))
    rows += [(80, ""), (81, None), (82, "x" * 300), (83, "x" * 200), (83, "x" * 120), (None, texts[0]), (None, texts[0]), (84, texts[1] + "\x00\x00" + texts[2])]
    return rows


@pytest.mark.parametrize("split", [100_000, 2])
def test_bytes(spark, split):
    rows = corpus(1)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in rows], "doc_id long, text string, block string")
    got = sorted(map(tuple, suffix_array.suffix_array_dedup(docs, plan=Plan(50, 24, split), block_bytes=3000).collect()), key=str)
    seqs = [(i, (t or "").encode()) for i, t in rows]
    want = []
    for (i, s), gone in zip(seqs, covered(seqs, 50), strict=True):
        kept = bytes(np.frombuffer(s, np.uint8)[~gone])
        want.append((i, len(s), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)
    assert sum(w[2] for w in want) > 1000


@pytest.mark.parametrize("split", [100_000, 2])
def test_words(spark, split):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, substring_dedup.substring_dedup(docs, plan=Plan(12, 4, split), block_bytes=3000).collect()), key=str)
    seqs = [(i, tuple((t or "").encode().split())) for i, t in rows]
    want = []
    for (i, s), gone in zip(seqs, covered(seqs, 12), strict=True):
        kept = b" ".join(w for w, g in zip(s, gone, strict=True) if not g)
        want.append((i, len(s), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    assert got == sorted(want, key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array.suffix_array_dedup(none).count() == 0 and substring_dedup.substring_dedup(none).count() == 0


def test_kept_texts(spark):
    docs = spark.createDataFrame([(1, "y" * 60), (2, "é" + "y" * 60 + "é")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in suffix_array.kept_texts(docs).collect()} == {1: "y" * 60, 2: "éé"}


def test_intervals_against_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randint(4, 14))) for _ in range(rng.randint(2, 5))]
        flat = np.frombuffer("".join(texts).encode(), np.uint8)
        length = np.array([len(t) for t in texts])
        at = np.concatenate(([0], np.cumsum(length)))
        seg, start, shared, before = suffix_array.sorted_suffixes(np.zeros(len(texts), np.uint64), length, at, flat, np.arange(len(texts)), 3)
        found = set()
        for a, b, depth, _ in suffix_array.intervals(shared, before, np.arange(len(texts))[seg], 3):
            found.add((texts[seg[a]][start[a] : start[a] + depth], b - a + 1))
        want = set()
        strings = {t[i:j] for t in texts for i in range(len(t)) for j in range(i + 3, len(t) + 1)}
        for s in strings:
            where = [(k, i) for k, t in enumerate(texts) for i in range(len(t) - len(s) + 1) if t.startswith(s, i)]
            left = {texts[k][i - 1] if i else ("start", k, i) for k, i in where}
            right = {texts[k][i + len(s)] if i + len(s) < len(texts[k]) else ("end", k) for k, i in where}
            if len(where) > 1 and len(left) > 1 and (len(right) > 1 or any(isinstance(x, tuple) for x in right)):
                want.add((s, len(where)))
        assert found == want
