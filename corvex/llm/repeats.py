"""What both substring operators share: which symbols of a text repeat text of a smaller doc_id.

Symbols are words (their 64-bit hashes) or bytes. A window is `width` consecutive symbols. Every window
has an anchor: the position of the smallest hash of a gram of `gram` symbols in it. Equal windows have
equal anchors, so windows are sorted into groups by their anchor's hash, and consecutive windows with one
anchor travel as one segment. Three passes read the same exchange of texts, dealt into blocks:

1. each block reports the hashes of its anchors, once each; those of one document of the whole
   collection alone are dropped;
2. each block sends its segments around the anchors left, once for each distinct segment, with the
   smallest and largest doc_id it has there; a structure for each group of suffixes (the operators'
   part) finds the repeats, and each block gets those that reach back to a smaller doc_id;
3. each block marks its documents and digests what is left.

A group has at most one entry from each block and distinct segment, however many documents hold it. An
anchor of more than `split` entries is hot: its windows go by their whole content, as hashes alone, since
a window's own copies are all that it can repeat; so a line that many documents hold never fills a group.

What blocks and groups send each other travels in packets, one for each block and bucket of groups.
There are as many buckets as shuffle partitions, each with a partition of its own, or a small multiple
of that where a bucket would have more than `bucket_bytes` of text; blocks grow by the same multiple, so
that packets grow in proportion to the input. Blocks are dealt by a hash of doc_id and number of symbols,
so one key never decides where a third of rows go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

U64 = np.uint64
LAST = (1 << 63) - 1
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Symbols handled at a time; a longer document is handled whole.
CHUNK = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64: spreads any 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


BYTE_VALUES = mixed(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


@dataclass(frozen=True)
class Plan:
    """width: symbols of a window; gram: of an anchor; split: entries beyond which an anchor's windows go by whole content."""

    width: int = 50
    gram: int = 24
    split: int = 20_000

    @property
    def span(self) -> int:
        """Grams in a window."""
        return self.width - self.gram + 1


def even_keys(parts: int, each: int = 1) -> np.ndarray:
    """Integers that Spark's hash partitioning (Murmur3 of an int, seed 42) deals evenly: `each` to each of
    `parts` partitions; number i goes to partition i % parts."""
    out = np.zeros((each, parts), np.int32)
    have = np.zeros(parts, np.int64)
    first, size = 0, 1 << 16
    while (have < each).any():
        key = np.arange(first, first + size, dtype=np.int64).astype(np.uint32)
        turn = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        h = turn(key * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593) ^ np.uint32(42)
        h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        place = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % parts
        order = np.argsort(place, kind="stable")
        place, key = place[order], key[order].view(np.int32)
        rank = np.arange(size) - np.searchsorted(place, place) + have[place]
        fits = rank < each
        out[rank[fits], place[fits]] = key[fits]
        have += np.bincount(place, minlength=parts)
        first += size
    return out.ravel()


class Hashes:
    """Hashes of any range of an array of symbols, from sums of symbol x BASE ** position."""

    _powers = np.zeros(0, U64)
    _inverse = np.zeros(0, U64)

    def __init__(self, values: np.ndarray) -> None:
        n = len(values) + 1
        if len(Hashes._powers) < n:
            size = max(n, CHUNK + 1)
            for name, base in (("_powers", BASE), ("_inverse", BASE_INVERSE)):
                out = np.full(size, base, U64)
                out[0] = 1
                setattr(Hashes, name, np.cumprod(out, dtype=U64))
        self.sums = np.zeros(n, U64)
        np.cumsum(values * Hashes._powers[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Hashes._inverse[: len(self.sums)][start])


def anchors(values: np.ndarray, starts: np.ndarray, plan: Plan) -> tuple[Hashes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined in values, text i from starts[i] to starts[i + 1]: hashes, and one entry for each
    run of consecutive windows of a text with one anchor: the anchor's hash, text, first and last window.

    The anchor of a window is its smallest gram hash, so it depends on the window's content alone. Runs
    of more than `span` windows (repetitive text) are cut, so that segments stay short."""
    hashes, span = Hashes(values), plan.span
    count = np.maximum(np.diff(starts) - plan.width + 1, 0)
    total = int(count.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return hashes, none.astype(U64), none, none, none
    low = hashes.of(slice(0, len(values) - plan.gram + 1), slice(plan.gram, None))
    size = 1
    while size < span:  # minimum over `span` grams by doubling
        step = min(size, span - size)
        low = np.minimum(low[: len(low) - step], low[step:])
        size += step
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(total) - np.repeat(np.cumsum(count) - count - starts[:-1], count)
    value = low[at]
    new = np.ones(total, bool)
    new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, total))
    if (size > span).any():
        cuts = -(-size // span)
        place = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        head = np.repeat(head, cuts) + place * span
    last = np.append(head[1:], total) - 1
    return hashes, mixed(value[head]), text[head], at[head], at[last]


def dealt(size: int, parts: int, block_bytes: int, bucket_bytes: int) -> tuple[int, int]:
    """Blocks that `size` bytes of text are dealt into, and buckets for each of `parts` partitions."""
    each = size // (parts * bucket_bytes) + 1
    return max(parts, size // (block_bytes * each) + 1), each


def windows_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of windows: the run and the start of each window."""
    count = last - first + 1
    run = np.repeat(np.arange(len(first)), count)
    return run, first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


def chunks(values: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK symbols."""
    begin, size = 0, 0
    for i, v in enumerate(values):
        if size and size + len(v) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(v)
    if begin < len(values):
        yield begin, len(values)


def _pack(x: np.ndarray) -> bytes:
    import zstandard

    return zstandard.compress(x.tobytes(), 3)


def _unpack(blob: bytes, kind) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob), kind)


def _contents(flat: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of each segment of flat."""
    at = np.concatenate(([0], np.cumsum(length)))
    return Hashes(_hash_values(flat)).of(at[:-1], at[1:])


#: Symbols of a text, and hash values of symbols.
Symbols = Callable[[str], np.ndarray]
#: (suffix structure) groups, segment bounds, symbols, smallest doc of each segment -> segment, start, length, smallest doc of each repeat
Finder = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _joined(texts: list[str | None], symbols: Symbols) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    parts = [symbols(t or "") for t in texts]
    return parts, list(chunks(parts))


def _hash_values(parts: np.ndarray) -> np.ndarray:
    return BYTE_VALUES[parts] if parts.dtype == np.uint8 else mixed(parts)


def removed_spans(docs: DataFrame, symbols: Symbols, find: Finder, digest: Callable, schema: str, plan: Plan, text: str = "text", block_bytes: int = 4 << 20, bucket_bytes: int = 32 << 20) -> DataFrame:
    """digest(doc_id, text, symbols, removed ranges as an (n, 2) array of symbol places) for every row of docs, as rows of schema."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks, each = dealt(size, partitions(docs), block_bytes, bucket_bytes)
    keys_of = even_keys(partitions(docs), each)
    buckets = U64(len(keys_of))
    block = F.pmod(F.xxhash64("doc_id", F.octet_length(text)), F.lit(blocks)).cast("int")
    # unknown ids come after all others, so that they take nothing from a document
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.col("doc_id").isNull().alias("unknown"), F.col(text).alias("text"), block.alias("block"))

    def segments(parts: list[np.ndarray], a: int, b: int):
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts[a:b]]))).astype(np.int64)
        whole = np.concatenate(parts[a:b])
        return whole, starts, anchors(_hash_values(whole), starts, plan)

    def packets(name: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
        """Keys of the buckets that names go to, and the places of the names of each."""
        at = ((name >> U64(16)) % buckets).astype(np.int64)
        order = np.argsort(at, kind="stable")
        cuts = np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []
        return [int(keys_of[at[c[0]]]) for c in cuts], cuts

    def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({n: "int32" for n in names if n in ("bucket", "block")})

    def report(key: tuple, batch: pd.DataFrame) -> pd.DataFrame:
        """Pass 1: for each bucket, the anchors of this block; of those with more than one, the documents and distinct segments, up to 65,535."""
        parts, ranges = _joined(batch["text"].tolist(), symbols)
        found = []
        for a, b in ranges:
            _, _, (hashes, anchor, doc, first, last) = segments(parts, a, b)
            found.append((anchor, doc + a, hashes.of(first, last + plan.width)))
        names = ["bucket", "block", "keys", "many"]
        if not found:
            return frame([], names)
        anchor, doc, content = (np.concatenate(x) for x in zip(*found, strict=True))
        same = np.unique(batch["doc_id"].to_numpy(), return_inverse=True)[1]  # rows of one doc_id are one document
        value, back, count = np.unique(anchor, return_inverse=True, return_counts=True)
        again = count[back] > 1
        of, doc, content = back[again], same[doc[again]], content[again]
        n_docs, n_entries = np.ones(len(value), np.int64), np.ones(len(value), np.int64)
        for number, what in ((n_docs, doc), (n_entries, content)):
            order = np.lexsort((what, of))
            o, w = of[order], what[order]
            fresh = np.append(True, (o[1:] != o[:-1]) | (w[1:] != w[:-1])) if len(o) else np.zeros(0, bool)
            number[:] = np.maximum(np.bincount(o[fresh], minlength=len(value)), 1)
        more = (n_docs > 1) | (n_entries > 1)
        shown = lambda x: np.minimum(x, 65_535).astype(np.uint16).tobytes()
        rows = []
        for bucket, c in zip(*packets(value), strict=True):
            m = c[more[c]]
            # most anchors are alone in their block: six bytes of each are enough to compare them
            rows.append((bucket, int(key[0]), _six(value[c]), _six(value[m]) + shown(n_docs[m]) + shown(n_entries[m])))
        return frame(rows, names)

    def recurring(batch: pd.DataFrame) -> pd.DataFrame:
        """Anchors of two documents or more, for each block that has them; the hot ones apart."""
        keys = [_unsix(x) for x in batch["keys"]]
        flat = np.concatenate(keys)
        n_docs, n_entries = np.ones(len(flat), np.int64), np.ones(len(flat), np.int64)
        base = 0
        for k, m in zip(keys, batch["many"], strict=True):
            n = len(m) // 10
            if n:
                at = base + np.searchsorted(k, _unsix(m[: 6 * n]))
                n_docs[at], n_entries[at] = np.frombuffer(m[6 * n : 8 * n], np.uint16), np.frombuffer(m[8 * n :], np.uint16)
            base += len(k)
        value, back = np.unique(flat, return_inverse=True)
        wanted = (np.bincount(back, n_docs, len(value)) > 1)[back]
        hot = wanted & (np.bincount(back, n_entries, len(value)) > plan.split)[back]
        rows, base = [], 0
        for block_no, k in zip(batch["block"].tolist(), keys, strict=True):
            mine = slice(base, base + len(k))
            base += len(k)
            if wanted[mine].any():
                rows.append((block_no, _six(k[wanted[mine]] << U64(16)), _six(k[hot[mine]] << U64(16))))
        return frame(rows, ["block", "keys", "hot"])

    def entries(parts, a, b, wanted, hot):
        """Group, text, place, symbols (0: a window that goes by its content) and content of each segment around a wanted anchor."""
        whole, starts, (hashes, anchor, doc, first, last) = segments(parts, a, b)
        short = anchor >> U64(16)
        if wanted is not None:
            keep = _within(short, wanted)
            anchor, doc, first, last, short = anchor[keep], doc[keep], first[keep], last[keep], short[keep]
        group, end = anchor & ~U64(1), last + plan.width
        content = hashes.of(first, end)
        if len(hot) and (split := _within(short, hot)).any():
            run, start = windows_of(first[split], last[split])
            put = lambda x, y: np.concatenate((x[~split], y))
            group, doc, content = put(group, group[split][run] | U64(1)), put(doc, doc[split][run]), put(content, hashes.of(start, start + plan.width))
            first, end = put(first, start), put(end, start)
        return whole, starts, group, doc, first, end - first, content

    def send(key: tuple, batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Pass 2: the distinct segments of this block around recurring anchors, by bucket."""
        names = ["bucket", "block", "groups", "sizes", "low", "more", "symbols", "windows"]
        wanted, hot = _sorted_six(known["keys"]), _sorted_six(known["hot"])
        if not len(batch) or not len(wanted):
            return frame([], names)
        ids = batch["doc_id"].to_numpy()
        parts, ranges = _joined(batch["text"].tolist(), symbols)
        rows = []
        for a, b in ranges:
            whole, _, group, doc, first, length, content = entries(parts, a, b, wanted, hot)
            head, low, high = _distinct(group, content, ids[doc + a])
            pieces = _slices(whole, first[head], (first + length)[head])
            rows.append((group[head], content[head], length[head], low, high, pieces))
        group, content, length, low, high, pieces = (np.concatenate(x) for x in zip(*rows, strict=True))
        at = np.concatenate(([0], np.cumsum(length)))
        head, lowest, _ = _distinct(group, content, low)
        highest = _distinct(group, content, high)[2]
        window = length[head] == 0
        out = []
        for bucket, c in zip(*packets(np.where(window, content[head], group[head])), strict=True):
            h = head[c]
            out.append((
                bucket, int(key[0]), _pack(group[h]), _pack(length[h].astype(np.uint16)), _pack(lowest[c]), _pack(highest[c] - lowest[c]),
                _pack(_slices(pieces, at[h], at[h] + length[h])), _pack(content[h[window[c]]]),
            ))
        return frame(out, names)

    kind = symbols("").dtype

    def decide(batch: pd.DataFrame) -> pd.DataFrame:
        """Repeats of each group of segments, for each block that holds the segment in a later document."""
        groups, sizes = [_unpack(x, U64) for x in batch["groups"]], [_unpack(x, np.uint16).astype(np.int64) for x in batch["sizes"]]
        content = []
        for x, n, w in zip(batch["symbols"], sizes, batch["windows"], strict=True):
            c = _contents(_unpack(x, kind), n)
            c[n == 0] = _unpack(w, U64)
            content.append(c)
        content = np.concatenate(content)
        block_of = np.repeat(batch["block"].to_numpy(), [len(x) for x in groups])
        group, length, flat = np.concatenate(groups), np.concatenate(sizes), np.concatenate([_unpack(x, kind) for x in batch["symbols"]])
        low = np.concatenate([_unpack(x, np.int64) for x in batch["low"]])
        high = low + np.concatenate([_unpack(x, np.int64) for x in batch["more"]])
        at = np.concatenate(([0], np.cumsum(length)))
        head, lowest, inverse = _distinct(group, content, low, inverse=True)
        window = np.flatnonzero(length[head] == 0)
        found = [(window, np.zeros(len(window), np.int64), np.full(len(window), plan.width), lowest[window])]
        for p in _pieces(group[head], length[head]):
            h = head[p]
            seg, start, size, first_doc = find(group[h], length[h], _slices(flat, at[h], at[h] + length[h]), lowest[p], plan.width)
            found.append((p[seg], start, size, first_doc))
        seg, start, size, first_doc = (np.concatenate(x) for x in zip(*found, strict=True))
        # repeats of a distinct segment, to each entry of it
        order = np.argsort(seg, kind="stable")
        seg, start, size, first_doc = seg[order], start[order], size[order], first_doc[order]
        begin = np.searchsorted(seg, np.arange(len(head)))
        count = np.diff(np.append(begin, len(seg)))
        entry = np.repeat(np.arange(len(group)), count[inverse])
        place = begin[inverse][entry] + np.arange(len(entry)) - np.repeat(np.cumsum(count[inverse]) - count[inverse], count[inverse])
        later = high[entry] > first_doc[place]
        entry, place = entry[later], place[later]
        order = np.argsort(block_of[entry], kind="stable")
        entry, place = entry[order], place[order]
        rows = []
        for x in np.split(np.arange(len(entry)), np.flatnonzero(np.diff(block_of[entry])) + 1) if len(entry) else []:
            e, p = entry[x], place[x]
            hot = np.unique(group[e[length[e] == 0]])
            rows.append((int(block_of[e[0]]), _pack(_named(group[e], content[e])), _pack(start[p].astype(np.uint16)), _pack(size[p].astype(np.uint16)), _pack(first_doc[p]), _six(hot)))
        return frame(rows, ["block", "names", "starts", "lengths", "first", "hot"])

    def mark(key: tuple, batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Pass 3: the removed places of each document of the block, digested."""
        if not len(batch):
            return digest([], [], [], [])
        ids = batch["doc_id"].to_numpy()
        texts = batch["text"].tolist()
        parts, ranges = _joined(texts, symbols)
        gone: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(texts)
        if len(known):
            name, first_doc = (np.concatenate([_unpack(x, k) for x in known[c]]) for c, k in (("names", U64), ("first", np.int64)))
            start, size = (np.concatenate([_unpack(x, np.uint16) for x in known[c]]).astype(np.int64) for c in ("starts", "lengths"))
            order = np.argsort(name, kind="stable")
            name, start, size, first_doc = name[order], start[order], size[order], first_doc[order]
            kinds, hot = np.unique(name), _sorted_six(known["hot"])
            for a, b in ranges:
                whole, starts, group, doc, first, _, content = entries(parts, a, b, None, hot)
                n = _named(group, content)
                hit = _within(n, kinds)
                n, d, f = n[hit], doc[hit], first[hit]
                lo, hi = np.searchsorted(name, n), np.searchsorted(name, n, side="right")
                entry = np.repeat(np.arange(len(n)), hi - lo)
                place = lo[entry] + np.arange(len(entry)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
                later = ids[d[entry] + a] > first_doc[place]
                entry, place = entry[later], place[later]
                cover = np.zeros(len(whole) + 1, np.int32)
                np.add.at(cover, f[entry] + start[place], 1)
                np.add.at(cover, f[entry] + start[place] + size[place], -1)
                edge = np.diff(np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8))))
                # runs of covered symbols; cut where texts meet
                begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                for i, (x, y) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)):
                    p, q = np.searchsorted(end, x, side="right"), np.searchsorted(begin, y)
                    if x < y and p < q:
                        gone[a + i] = np.stack((np.maximum(begin[p:q], x) - x, np.minimum(end[p:q], y) - x), axis=1)
        return digest([None if no else i for i, no in zip(batch["doc_id"].tolist(), batch["unknown"].tolist(), strict=True)], texts, parts, gone)

    def cogrouped(left: DataFrame, right: DataFrame, f, out: str) -> DataFrame:
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(f, out)

    anchors_of = texts.groupBy("block").applyInPandas(report, "bucket int, block int, keys binary, many binary")
    known = anchors_of.groupBy("bucket").applyInPandas(recurring, "block int, keys binary, hot binary")
    sent = cogrouped(texts, known, send, "bucket int, block int, groups binary, sizes binary, low binary, more binary, symbols binary, windows binary")
    repeats = sent.groupBy("bucket").applyInPandas(decide, "block int, names binary, starts binary, lengths binary, first binary, hot binary")
    return cogrouped(texts, repeats, mark, schema)


def ids_of(ids: list[int | None]):
    """A column of ids that may be null, without a detour through floats."""
    return pd.array(ids, dtype="Int64")


def _pieces(group: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the segments (length above 0) of whole groups, about CHUNK symbols at a time; group is sorted."""
    place = np.flatnonzero(length)
    if len(place):
        g = group[place]
        begin = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        number = (np.cumsum(length[place])[begin] - length[place][begin]) // CHUNK
        yield from np.split(place, begin[1:][np.diff(number) > 0])


def alone(group: np.ndarray) -> np.ndarray:
    """Whether each segment is the only distinct one of its group. group is sorted."""
    differs = group[1:] != group[:-1]
    return np.append(True, differs) & np.append(differs, True) if len(group) else np.zeros(0, bool)


def _six(x: np.ndarray) -> bytes:
    """The top six bytes of each value."""
    return np.ascontiguousarray((x.astype(">u8").view(np.uint8).reshape(-1, 8))[:, :6]).tobytes()


def _unsix(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(x, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(U64)


def _sorted_six(blobs: pd.Series) -> np.ndarray:
    return np.unique(_unsix(b"".join(blobs)))


def _within(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    if not len(values):
        return np.zeros(len(x), bool)
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x


def _named(group: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One name for group and content, odd for windows."""
    return mixed(group ^ (content * U64(BASE))) & ~U64(1) | group & U64(1)


def _slices(flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """flat[start[0]:end[0]], flat[start[1]:end[1]], ... one after the other."""
    size = end - start
    total = int(size.sum())
    back = np.repeat(start - (np.cumsum(size) - size), size)
    return flat[back + np.arange(total)] if total else flat[:0]


def _distinct(group: np.ndarray, content: np.ndarray, value: np.ndarray, inverse: bool = False):
    """First place of each distinct (group, content), its smallest value, and its largest value or the number of each entry's."""
    order = np.lexsort((content, group))
    g, c = group[order], content[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
    head = np.flatnonzero(new)
    if not len(head):
        return order, value[:0], value[:0] if not inverse else np.zeros(0, np.int64)
    low = np.minimum.reduceat(value[order], head)
    if not inverse:
        return order[head], low, np.maximum.reduceat(value[order], head)
    number = np.empty(len(g), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[head], low, number
