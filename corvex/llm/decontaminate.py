"""Benchmark decontamination by template canonicalisation.

Texts become tokens: lower-cased words without punctuation at their ends, where numbers, names
(capitalised words inside a sentence) and units after a number are typed placeholders. Windows of five
tokens are hashed, windows of documents that some benchmark window may equal are joined to the
benchmark's by hash, and a document is contaminated by an item if some alignment of the two has
`containment` of the item's windows in their places and fills its placeholders consistently: each value
of the benchmark stands for one value of the document. So copies are found, and also questions with other
numbers or names. An alignment is a shift between places; windows up to SLACK tokens off it still count,
so a word more or less does not break a copy, and of several matches of a window the nearest stands.

A window of placeholders alone has no wording to go by, so it counts with its values as they are. An item
of fewer than five tokens is one window of all its tokens, with their values, and matches only where a
document has it as a whole sentence or line: such a short text within a sentence is no sign of a leak.

Before the join, documents' windows pass a bitmap of fixed size (2 ** BITS bits) of the benchmark's
hashes; a benchmark of any size leaves the join exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, own_name, strings
from .repeats import BYTE_VALUES, U64, Hashes, mixed

WINDOW, CONTAINMENT, CONSISTENT, SLACK, BITS = 5, 0.8, 1.0, 2, 24
#: Documents to drop are broadcast up to this many bytes of keys; beyond, they meet the documents by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Words that name a unit when they follow a number.
UNITS = "kg g mg lb oz km m cm mm mi ft in l ml h hr hrs min mins s sec secs day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres kilometer kilometers mile miles foot feet inch inches gram grams kilogram kilograms pound pounds liter liters litre litres dollar dollars euro euros cent cents usd eur gbp degree degrees percent".split()
_NUM, _CAP, _UNIT = range(3)
_SLOTS = "ncu"
#: Bytes of text handled at a time; a longer text is handled whole.
CHUNK = 1 << 19


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_IS_BLANK, _IS_DIGIT, _IS_END = _class(" \t\n\x0b\x0c\r"), _class("0123456789"), _class(".!?:")
_IS_UPPER, _IS_LOWER, _IS_JOINT = _class(_LETTERS.upper()), _class(_LETTERS), _class(".,:/")
_IS_CORE = _IS_DIGIT | _IS_UPPER | _IS_LOWER | (np.arange(256) >= 128)


def _word_hash(word: str) -> int:
    return int(Hashes(BYTE_VALUES[np.frombuffer(word.encode(), np.uint8)]).of(np.array([0]), np.array([len(word.encode())]))[0])


UNIT_HASHES = np.sort(np.array([_word_hash(u) for u in UNITS], U64))
PLACE = np.array([_word_hash(f"<{k}>") for k in ("number", "name", "unit")], U64)


def tokens_of(texts: list[bytes]):
    """Of all words of the texts: hash, slot kind (-1: none), text number, the first and last byte (exclusive)
    of its core in the texts joined by blanks, those, and whether it begins and ends a sentence or line.

    A word's core is what is left without punctuation at its ends; words without one are no tokens.
    Letters are folded in ASCII and Latin-1. A number has digits and .,:/ only. A name starts with a
    capital, has some small letter, and follows no . ! ? or :.
    """
    data = np.frombuffer(b" ".join([*texts, b""]) or b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    edge = np.diff(np.concatenate(([1], _IS_BLANK[data].astype(np.int8), [1])))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    place = np.arange(len(data), dtype=np.int32)
    core = _IS_CORE[data]
    after = np.minimum.accumulate(np.where(core, place, len(data))[::-1])[::-1]
    before = np.maximum.accumulate(np.where(core, place, -1))
    start, end = after[first].astype(np.int64), before[last - 1].astype(np.int64) + 1
    full = start < last
    start, end, last = start[full], end[full], last[full]
    text = np.searchsorted(np.cumsum(sizes), start, side="right")
    pair = np.zeros(len(data), bool)  # second bytes of Latin-1 letters
    pair[1:] = data[:-1] == 0xC3
    wide = pair & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    upper = _IS_UPPER[data] | wide
    small = data + (upper * np.uint8(32))
    count = lambda mask, a, b: (c := np.concatenate(([0], np.cumsum(mask, dtype=np.int32))))[b] - c[a]
    digits = count(_IS_DIGIT[data], start, end)
    number = (digits > 0) & (digits + count(_IS_JOINT[data], start, end) == end - start)
    head = np.minimum(start + (data[start] == 0xC3), len(data) - 1)
    capital = upper[head] & (count(_IS_LOWER[data] | (pair & (data >= 0xA0)), start, end) > 0)
    ends = count(_IS_END[data], end, last) > 0
    hashes = Hashes(BYTE_VALUES[small]).of(start, end)
    opens, follows = np.ones(len(start), bool), np.zeros(len(start), bool)
    same = text[1:] == text[:-1]
    opens[1:] = ends[:-1] | ~same
    follows[1:] = number[:-1] & same
    slot = np.full(len(start), -1, np.int8)
    slot[capital & ~opens] = _CAP
    maybe = follows & (UNIT_HASHES[np.minimum(np.searchsorted(UNIT_HASHES, hashes), len(UNIT_HASHES) - 1)] == hashes)
    slot[maybe] = _UNIT
    slot[number] = _NUM
    line = count(data == 10, np.append(0, end[:-1]), start) > 0  # a line break since the word before
    begins, stops = opens | line, ends | ~np.append(same, False) | np.append(line[1:], True)
    return hashes, slot, text, start, end, small, begins, stops


def _rolled(hashes: np.ndarray, n: int, width: int) -> np.ndarray:
    value = np.full(n, width, U64)
    for k in range(width):
        value = value * U64(0x9E3779B97F4A7C15) + mixed(hashes[k : k + n])
    return mixed(value)


def windows(hashes: np.ndarray, slot: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first token of every window within one text; placeholders by kind, unless a window has nothing else."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    value = _rolled(np.where(slot >= 0, PLACE[slot], hashes), n, WINDOW)
    filled = np.cumsum(np.append(0, slot >= 0))
    bare = filled[WINDOW:] - filled[:-WINDOW] == WINDOW
    if bare.any():
        value[bare] = _rolled(hashes, n, WINDOW)[bare]
    at = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    return value[at], at


def short_windows(hashes: np.ndarray, text: np.ndarray, begins: np.ndarray, stops: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for sentences and lines of `width` tokens, fewer than a window has."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero((text[:n] == text[width - 1 :]) & begins[:n] & stops[width - 1 :])
    return _rolled(hashes, n, width)[at], at


def template_windows(table: DataFrame, key: list[str], text: str, bitmap: bytes | None = None, short: tuple[int, ...] = ()) -> DataFrame:
    """key columns, h (window hash), at (its first token), slots (kind and value of a template's placeholders) and width of every window,
    or of those in the bitmap. Without a bitmap a text of fewer tokens is one window; with one, short has the widths of such."""
    kinds = dict(table.dtypes)

    def found(rows: pd.DataFrame, texts: list[bytes], bits) -> pd.DataFrame:
        hashes, slot, doc, start, end, data, begins, stops = tokens_of(texts)
        value, at = windows(hashes, slot, doc)
        width = np.full(len(at), WINDOW)
        count = np.bincount(doc, minlength=len(texts))
        for n in short if bits is not None else range(1, WINDOW):
            v, a = short_windows(hashes, doc, begins, stops, n)
            if bits is None:  # all tokens of the text, whatever marks it has
                a = np.searchsorted(doc, np.flatnonzero(count == n))
                v = _rolled(hashes, len(hashes) - n + 1, n)[a] if len(a) else v[:0]
            value, at, width = np.append(value, v), np.append(at, a), np.append(width, np.full(len(a), n))
        if bits is not None:
            low = (value & U64((1 << BITS) - 1)).astype(np.int64)
            hit = (bits[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1
            value, at, width = value[hit], at[hit], width[hit]
        first = np.searchsorted(doc, np.arange(len(rows)))
        word = lambda i: data[start[i] : end[i]].tobytes().decode("utf-8", "replace")
        slots = ["\t".join(_SLOTS[slot[i]] + word(i) for i in range(a, a + n) if slot[i] >= 0 and n == WINDOW) for a, n in zip(at.tolist(), width.tolist(), strict=True)]
        return rows[key].iloc[doc[at]].reset_index(drop=True).assign(h=value.view(np.int64), at=at - first[doc[at]], slots=strings(slots), width=width)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = None if bitmap is None else np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text_"]]
            begin, size = 0, 0
            for i, t in enumerate(texts):
                if size and size + len(t) > CHUNK:
                    yield found(batch.iloc[begin:i], texts[begin:i], bits)
                    begin, size = i, 0
                size += len(t)
            yield found(batch.iloc[begin:], texts[begin:], bits)

    # keys travel as strings: one null among longs would turn a batch of them into floats
    schema = ", ".join(f"`{k}` string" for k in key) + ", h long, at long, slots string, width long"
    out = table.select(*(F.col(k).cast("string").alias(k) for k in key), F.col(text).alias("text_")).mapInPandas(run, schema)
    return out.withColumns({k: F.col(k).cast(kinds[k]) for k in key})


def bitmap_of(hashes: DataFrame) -> bytes:
    """2 ** BITS bits, one set for each h modulo 2 ** BITS: at most 512 rows of 4 KiB reach the driver."""
    low = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    rows = hashes.groupBy(F.bitmap_bucket_number(low).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low)).alias("bits")).collect()
    out = bytearray((1 << BITS) // 8)
    for row in rows:
        start = (row["b"] - 1) * 4096
        out[start : start + 4096] = row["bits"]
    return bytes(out)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", containment: float = CONTAINMENT, consistent: float = CONSISTENT) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, containment, consistency, row (the hash of doc_id and text).

    Of a document's alignments with an item that hold, the one of most consistency, then containment, is
    given. Texts without tokens match nothing, null ones included; equal rows of docs are one document;
    null ids are kept as null. Empty tables give no rows; extra columns are not read. A document is
    tokenised whole by one task.
    """
    items = template_windows(benchmark.select("item_id", F.col("text").alias("t"), F.xxhash64("item_id", "text").alias("item")).distinct(), ["item_id", "item"], "t")
    bitmap = bitmap_of(items)
    short = tuple(r["width"] for r in items.select("width").distinct().filter(F.col("width") < WINDOW).collect())  # four at most
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), F.col(text).alias("t"))
    found = template_windows(rows, ["doc_id", "row"], "t", bitmap, short).select("doc_id", "row", "h", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    size = items.groupBy("item").agg(F.countDistinct("at").alias("n"))
    # texts are tokenised once; what met the benchmark is little
    met = checkpointed(found.join(items, "h").select("doc_id", "row", "item_id", "item", "at", (F.col("doc_at") - F.col("at")).alias("shift"), "slots", "doc_slots"))
    key = ["row", "item"]
    likely = met.groupBy(*key).agg(F.countDistinct("at").alias("have")).join(size, "item").filter(F.col("have") >= containment * F.col("n")).select(*key, "n")
    # every shift is tried as an alignment, with the matches near it
    near = F.transform(F.sequence(F.lit(-SLACK), F.lit(SLACK)), lambda k: F.col("shift") + k)
    tried = met.join(likely, key)
    shifts = tried.select(*key, F.col("shift").alias("aligned")).distinct()
    tried = tried.withColumn("aligned", F.explode(near)).join(shifts, [*key, "aligned"])
    off = F.struct(F.abs(F.col("shift") - F.col("aligned")).alias("off"), F.col("shift").alias("shift"), F.col("slots").alias("a"), F.col("doc_slots").alias("b"))
    placed = tried.groupBy(*key, "aligned", "at", "n").agg(F.min(off).alias("m"), F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"))
    held = placed.groupBy(*key, "aligned", "n").agg(F.count(F.lit(1)).alias("have"), F.collect_set(F.when(F.col("m.a") != "", F.struct("m.a", "m.b"))).alias("filled"), F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"))
    held = held.withColumn("containment", F.col("have") / F.col("n")).filter(F.col("containment") >= containment)
    # slots of equal windows are equal in number and kind
    pairs = F.array_distinct(F.flatten(F.transform("filled", lambda x: F.zip_with(F.split(x["a"], "\t"), F.split(x["b"], "\t"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))))
    values = F.array_distinct(F.transform("pairs", lambda p: p["a"]))
    once = F.size(F.filter(values, lambda v: F.size(F.filter("pairs", lambda p: p["a"] == v)) == 1))
    held = held.withColumn("pairs", pairs).withColumn("consistency", F.when(F.size(values) > 0, once / F.size(values)).otherwise(1.0))
    best = held.filter(F.col("consistency") >= consistent).groupBy(*key).agg(F.max(F.struct("consistency", "containment")).alias("best"), F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"))
    return best.select("doc_id", "item_id", F.round("best.containment", 6).alias("containment"), F.round("best.consistency", 6).alias("consistency"), "row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs without those that contaminated() finds. Texts are shuffled only if the keys of those exceed BROADCAST_BYTES."""
    name = own_name(docs, "bad_row")
    bad = checkpointed(contaminated(docs, benchmark, text, **how).select(F.col("row").alias(name)).distinct())
    small = bad.count() * 8 <= BROADCAST_BYTES
    return docs.join(F.broadcast(bad) if small else bad, F.xxhash64("doc_id", text) == bad[name], "left_anti")
