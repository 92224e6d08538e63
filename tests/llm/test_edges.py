"""Ids beyond floats beside nulls, empty tables, clashing columns, repeated rows, long texts; groups larger than memory allows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex.llm import decontaminate, license_scan, pii, quality_rules, repeats, secret_scan, simhash, substring_dedup, suffix_array, token_count
from corvex.llm.repeats import Plan

BIG = (1 << 60) + 1
TEXT = "What is the sum of all the numbers that the old clock shows at noon, when 12 birds sing in the yard?"
BENCH = [(BIG + 4, TEXT)]

RUN = {
    "op1": lambda docs: simhash.simhash_groups(docs),
    "op4": lambda docs: secret_scan.secret_scan(docs),
    "op5": lambda docs: substring_dedup.substring_dedup(docs),
    "op7": lambda docs: token_count.token_counts(docs),
    "op8": lambda docs: suffix_array.suffix_array_dedup(docs),
    "op10": lambda docs: decontaminate.contaminated(docs, docs.sparkSession.createDataFrame([*BENCH, (None, "one two three")], "item_id long, text string")),
}
CLASH = ["block", "bucket", "fp", "unknown", "row", "item_id", "n_tokens", "spans", "h", "at"]


@pytest.mark.parametrize("name", sorted(RUN))
def test_ids(spark, name):
    rows = [(None, TEXT), (BIG, TEXT), (BIG + 1, TEXT), (BIG + 1, TEXT), (BIG + 2, TEXT), (None, TEXT)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs = docs.withColumns({c: F.lit("clash") for c in CLASH})
    got = RUN[name](docs)
    ids = [r["doc_id"] for r in got.collect()]
    want = [None, BIG, BIG + 1, BIG + 2] if name == "op10" else [i for i, _ in rows]
    assert sorted(ids, key=str) == sorted(want, key=str) and dict(got.dtypes)["doc_id"] == "bigint"
    if name == "op10":
        assert {r["item_id"] for r in got.collect()} == {BIG + 4}
    if name == "op1":
        assert {r["component_id"] for r in got.collect()} == {BIG}
    assert RUN[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(RUN))
def test_long_text(spark, name):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    long = " ".join(word() for _ in range(20_000)) + "\n" + TEXT + " " + "é" * 70_000
    got = {r["doc_id"]: r for r in RUN[name](spark.createDataFrame([(1, long), (2, "x " + long), (3, "")], "doc_id long, text string")).collect()}
    if name == "op10":
        assert set(got) == {1, 2}
    elif name == "op5":
        assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_words"]) == (0, got[1]["n_words"], got[1]["n_words"] + 1)
    elif name == "op8":
        assert (got[1]["n_removed"], got[2]["n_removed"], got[2]["n_spans"]) == (0, got[1]["n_bytes"], 1)
    elif name == "op1":
        assert got[2]["component_id"] == 1 and got[3]["fingerprint"] == "0" * 16
    else:
        assert set(got) == {1, 2, 3}


def test_long_texts_of_native_operators(spark):
    long = "".join(f"word{i} " for i in range(60_000)) + "Released under the MIT License. mail a.b@c.org"
    docs = spark.createDataFrame([(1, long, "s"), (2, "Released under the MIT License.", "s")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["license"]) for r in license_scan.license_scan(docs).collect()} == {(1, "MIT"), (2, "MIT")}
    assert {r["doc_id"]: (r["n_words"], r["n_repeat_words"]) for r in quality_rules.quality_rules(docs).collect()} == {1: (60_007, 0), 2: (5, 0)}
    assert {r["doc_id"]: r["n_email"] for r in pii.pii_spans(docs).collect()} == {1: 1, 2: 0}


@pytest.mark.parametrize("parts, each", [(1, 1), (7, 3), (211, 2)])
def test_buckets_are_dealt_evenly(spark, parts, each):
    keys = repeats.even_keys(parts, each).tolist()
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k int, n int").select("n", F.expr(f"pmod(hash(k), {parts})").alias("p")).collect()
    assert len(set(keys)) == parts * each and all(r["p"] == r["n"] % parts for r in rows)


def test_packets_grow_with_the_input():
    """Rows between blocks and buckets, at a fixed number of partitions."""
    def packets(size):
        blocks, each = repeats.dealt(size, 200, 4 << 20, 32 << 20)
        return blocks * each * 200

    first = packets(1 << 30)
    for factor in (2, 10, 100, 1000, 100_000):
        assert packets(factor << 30) <= 1.02 * factor * first


def brute_repeats(segments, low, width):
    """Places of each segment that a window of another segment, or itself, of that group covers, with the smallest doc."""
    first = {}
    for s, d in zip(segments, low, strict=True):
        for k in range(len(s) - width + 1):
            w = tuple(s[k : k + width])
            first[w] = min(first.get(w, d), d)
    out = []
    for s in segments:
        best = [None] * len(s)
        for k in range(len(s) - width + 1):
            d = first[tuple(s[k : k + width])]
            for j in range(k, k + width):
                best[j] = d if best[j] is None else min(best[j], d)
        out.append(best)
    return out


@pytest.mark.parametrize("module, most", [(suffix_array, 10**6), (suffix_array, 20), (substring_dedup, 10**6), (substring_dedup, 20)])
def test_groups_larger_than_a_slab(module, most):
    """The same repeats whether a group is handled at once or split by prefixes."""
    rng = random.Random(11)
    width = 6
    segments, group = [], []
    for g in range(3):
        core = [rng.randint(1, 2) + 10 * g for _ in range(9)]  # equal windows are always of one group
        more = lambda: tuple(rng.randint(1, 3) + 10 * g for _ in range(rng.randint(0, 4)))  # noqa: B023, E731
        own = {more() + tuple(core[a:]) + more() for a in range(3) for _ in range(25 if g == 1 else 4)}
        own = sorted(s for s in own if len(s) >= width)
        segments += own
        group += [g] * len(own)
    low = np.array([rng.randint(0, 50) for _ in segments])
    kind = np.uint8 if module is suffix_array else np.uint64
    flat = np.array([x for s in segments for x in s], kind)
    found = module.find_repeats(np.array(group, np.uint64), np.array([len(s) for s in segments]), flat, low, width, most)
    best = [[None] * len(s) for s in segments]
    for seg, start, size, doc in zip(*(x.tolist() for x in found), strict=True):
        for j in range(start, start + size):
            best[seg][j] = doc if best[seg][j] is None else min(best[seg][j], doc)
    want = []
    for g in range(3):
        mine = [k for k, x in enumerate(group) if x == g]
        want += brute_repeats([segments[k] for k in mine], low[mine].tolist(), width)
    assert best == want


def test_hot_anchor_goes_by_windows(spark):
    """A line of many documents in texts of their own: found exactly though its anchors are split."""
    rng = random.Random(4)
    line = " ".join(f"common{k}" for k in range(14))
    prose = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20))
    rows = [(i, f"{prose()} {line} {prose()}") for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(200, " ".join([line] * 5))] + [(201, " ".join([line] * 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(docs, plan=Plan(20, 4, 3), block_bytes=2000).collect()}
    assert few == {i: 54 if 100 <= i < 200 else 70 if i == 201 else 0 for i, _ in rows}


def test_token_counts_of_whole_query(spark):
    scores, longest = token_count.vocabulary(token_count.VOCABULARY)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60).collect()]
    got = {r["doc_id"]: r for r in token_count.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), keep=3000).collect()}
    known = {}

    def brute(word):
        if word not in known:
            best = [(0.0, 0)]
            for end in range(1, len(word) + 1):
                best.append(max((best[k][0] + scores[word[k:end]], best[k][1] - 1) for k in range(max(0, end - longest), end) if word[k:end] in scores))
            known[word] = -best[-1][1]
        return known[word]

    for i, t in rows:
        words = re.findall(r" ?[^ \x09-\x0D]+|[ \x09-\x0D]+?(?= [^ \x09-\x0D])|[ \x09-\x0D]+", t)
        assert (got[i]["n_bytes"], got[i]["n_pretokens"], got[i]["n_tokens"]) == (len(t.encode()), len(words), sum(brute(w.encode()) for w in words))


def test_scores_that_are_not_stored():
    scores = {b"a": -2.0, b"b": -2.0, b"ab": -1.0, b"aba": -1.5, b"bbbbb": -3.0}
    words = [b"ab" * 40, b"ab" * 40 + b"a", b"abbbbb" * 9, b"b" * 53, b"aab", b"aab" * 11]
    whole = token_count.count_pieces(words, scores, 5)
    for stored, most in ((0, 5), (3, 7), (60, 9)):
        assert token_count.count_walked(words, token_count.with_tails(scores), 5, most, stored) == whole


# --- decontamination


def brute_tokens(text):
    """Token, slot kind, and whether it begins and ends a sentence or line."""
    out, opens, number = [], True, False
    for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text):
        word = m[0]
        core = re.search(r"[0-9A-Za-z\x80-\U0010ffff].*[0-9A-Za-z\x80-\U0010ffff]|[0-9A-Za-z\x80-\U0010ffff]", word, re.S)
        if not core:
            continue
        line = bool(out) and "\n" in text[out[-1][4] : m.start() + core.start()]
        low = core[0].lower()
        is_number = bool(re.fullmatch(r"[0-9.,:/]+", core[0]))
        kind = "n" if is_number else "u" if number and low in decontaminate.UNITS else "c" if not opens and core[0][0].isupper() and re.search("[a-z]", core[0]) else ""
        out.append([low, kind, opens or line, bool(re.search("[.!?:]", word[core.end() :])), m.start() + core.end()])
        if line:
            out[-2][3] = True
        opens, number = out[-1][3], is_number
    if out:
        out[-1][3] = True
    return out


def brute_contaminated(docs, bench, width=5, containment=0.8, slack=2):
    def windows(tokens, short):
        for k in range(len(tokens) - width + 1):
            w = tokens[k : k + width]
            bare = all(t[1] for t in w)
            yield k, tuple(t[0] if bare or not t[1] else "<" + t[1] for t in w), [(t[1] + t[0]) for t in w if t[1]]
        for n in short:
            for k in range(len(tokens) - n + 1):
                w = tokens[k : k + n]
                if w[0][2] and w[-1][3]:
                    yield k, tuple(t[0] for t in w), []

    out = set()
    items = {i: brute_tokens(t) for i, t in bench}
    shapes = {i: [(0, tuple(x[0] for x in t), [])] if 0 < len(t) < width else list(windows(t, ())) for i, t in items.items()}
    short = {len(t) for t in items.values() if 0 < len(t) < width}
    for d, text in docs:
        places = {}
        for k, w, s in windows(brute_tokens(text or ""), short):
            places.setdefault(w, []).append((k, s))
        for i, shape in shapes.items():
            for aligned in {k - at for at, w, _ in shape for k, _ in places.get(w, ())}:
                have, maps = 0, {}
                for at, w, s in shape:
                    near = [(abs(k - at - aligned), k - at, x) for k, x in places.get(w, ()) if abs(k - at - aligned) <= slack]
                    if near:
                        have += 1
                        for a, b in zip(s, min(near)[2], strict=True):
                            maps.setdefault(a, set()).add(b)
                if shape and have >= containment * len(shape) and all(len(v) == 1 for v in maps.values()):
                    out.add((d, i))
    return out


def test_decontamination_by_brute_force(spark):
    rng = random.Random(2)
    names, nouns = ["Anna", "Bob", "Maria", "Paul", "Zoe"], "apples pears boats mills towns clocks".split()
    bench = []
    for i in range(12):
        a, b = rng.sample(names, 2)
        bench.append((i, f"If {a} buys {rng.randint(2, 99)} {rng.choice(nouns)} at {rng.randint(2, 9)} euros each and {b} sells {rng.randint(2, 99)} of them, how many {rng.choice(nouns)} does {a} have left over today?"))
    bench += [(20, "What is 7?"), (21, "Define entropy."), (22, "3 4 5 6 7 8"), (23, ""), (24, "Yes")]
    docs = []
    for i in range(150):
        text = rng.choice(bench)[1]
        for _ in range(rng.randint(0, 4)):
            how = rng.randrange(6)
            if how == 0:
                text = text.replace(rng.choice(names), rng.choice(names))
            elif how == 1:
                text = text.replace(rng.choice(names), rng.choice(names), 1)
            elif how == 2:
                text = re.sub(r"\b\d+\b", lambda m: str(rng.randint(2, 99)), text, count=rng.randint(0, 3))
            elif how == 3:
                words = text.split(" ")
                words.insert(rng.randrange(len(words) + 1), rng.choice(["indeed", "and", "7"]))
                text = " ".join(words)
            elif how == 4:
                words = text.split(" ")
                del words[rng.randrange(len(words))]
                text = " ".join(words)
            else:
                text = text + rng.choice([" ", "\n", ". "]) + rng.choice(bench)[1]
        docs.append((i, rng.choice(["", "Some words before. ", "a line\n", "well "]) + text + rng.choice(["", " and more", "\nnext", ". End"])))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    want = brute_contaminated(docs, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 60
    assert {20, 21, 22, 24} <= {i for _, i in want}


def test_decontamination_default_is_strict(spark):
    item = "If Anna buys 12 apples at 3 euros each and Bob sells 5 of them, how many apples does Anna have left over today?"
    both = item.replace("Anna buys", "Maria buys").replace("12", "77")  # one name stands for two
    plain = item.replace("Anna", "Maria").replace("12", "77")
    docs = spark.createDataFrame([(1, both), (2, plain), (3, "Yes, it is so. Say yes to it."), (4, "So?\nYes.\nGood")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "yes")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(2, 1), (4, 2)}


@pytest.mark.parametrize("most", [0, 8 << 20])
def test_contaminated_rows_go_either_way(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([(1, TEXT), (2, "other words"), (None, TEXT), (3, None), (2, "other words")], "doc_id long, text string").withColumn("bad_row", F.lit(0))
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame(BENCH, "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 2, 3]


# --- licenses and quality


def test_templates_beyond_the_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, license_scan.license_scan(docs).collect()))
    monkeypatch.setattr(license_scan, "BROADCAST_SHINGLES", 0)
    assert sorted(map(tuple, license_scan.license_scan(docs).collect())) == want and want
    none = spark.createDataFrame([("x", "")], "license string, text string")
    assert license_scan.license_scan(docs, none).count() == 0


def test_prior_without_noise(spark):
    """Many hosts of few documents with one and the same rate: their spread is noise, and all are shrunk to the mean."""
    rng = random.Random(8)
    good, bad = " ".join(f"word{i}" for i in range(20)), "bad"
    rows = [(4 * h + k, bad if rng.random() < 0.5 else good, f"h{h}") for h in range(400) for k in range(4)]
    got = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    rates = [r["host_rate"] for r in got]
    assert max(rates) - min(rates) < 0.2 and all(r["kept"] != r["base_failed"] for r in got)


def test_digest_of_removed_ids():
    out = substring_dedup._digest([None, BIG], ["a", "b"], [[], []], [np.zeros((0, 2), np.int64)] * 2)
    assert out["doc_id"].tolist()[1] == BIG and out["kept_sha256"].tolist()[0] == hashlib.sha256(b"a").hexdigest()
