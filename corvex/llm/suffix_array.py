"""Suffix-array dedup: the common-prefix interval tree of an enhanced suffix array, scanned with a stack.

Suffixes that can share a window come to one group (see repeats). Each group's suffixes are sorted, the
lengths of the prefixes that neighbours share are taken, and one scan with a stack gives every interval of
suffixes that share `width` bytes or more. An interval whose suffixes differ in the byte before them (or
start a segment, where that byte is unknown) is a maximal repeat: it is returned with all its occurrences.
A byte is removed if such a repeat covers it and also occurs in a smaller doc_id; every 50-byte string
that repeats lies in a maximal repeat with the same occurrences, so that is the same as judging each string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .repeats import Hashes, Plan, _hash_values, _slices, ids_of, removed_spans

PLAN = Plan(width=50, gram=24)
#: Suffixes sorted at a time; only those that begin with one and the same window can be more.
SLAB = 150_000


def suffixes_of(length: np.ndarray, members: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment and start of every suffix of the segments in members that holds a window."""
    count = length[members] - width + 1
    seg = np.repeat(members, count)
    return seg, np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)


def slabs(group: np.ndarray, length: np.ndarray, at: np.ndarray, flat: np.ndarray, width: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Segment and start of suffixes, about `most` at a time, of groups of two distinct segments or more:
    whole groups, and of a larger group all that begin with the same windows. group is sorted."""
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
    end = np.append(head[1:], len(group))
    total = np.append(0, np.cumsum(length - width + 1))
    size, members = 0, []
    for a, b, n in zip(head.tolist(), end.tolist(), (total[end] - total[head]).tolist(), strict=True):
        if b - a < 2:
            continue
        if n > most:
            seg, start = suffixes_of(length, np.arange(a, b), width)
            base = at[a]
            name = Hashes(_hash_values(flat[base : at[b]])).of(at[seg] + start - base, at[seg] + start - base + width)
            order = np.argsort(name, kind="stable")
            name = name[order]
            fresh = np.flatnonzero(np.append(True, name[1:] != name[:-1]))
            for part in np.split(order, fresh[1:][np.diff(fresh // most) > 0]):
                yield seg[part], start[part]
            continue
        members.append(np.arange(a, b))
        size += n
        if size >= most:
            yield suffixes_of(length, np.concatenate(members), width)
            size, members = 0, []
    if members:
        yield suffixes_of(length, np.concatenate(members), width)


def sorted_suffixes(group: np.ndarray, length: np.ndarray, at: np.ndarray, flat: np.ndarray, members: np.ndarray, width: int):
    """The suffixes of the segments in members that start a window, sorted as by enhanced()."""
    return enhanced(group, length, at, flat, *suffixes_of(length, members, width))


def enhanced(group: np.ndarray, length: np.ndarray, at: np.ndarray, flat: np.ndarray, seg: np.ndarray, start: np.ndarray):
    """The suffixes sorted by group and symbols: segment, start, length of the prefix shared with the next
    one (0 across groups), and the symbol before (-1: unknown)."""
    size = length[seg] - start
    longest = int(size.max())
    begin = at[seg] + start
    padded = np.concatenate((flat, np.zeros(longest, flat.dtype)))
    rows = padded[begin[:, None] + np.arange(longest)[None, :]]
    rows[np.arange(longest)[None, :] >= size[:, None]] = 0
    place = np.unique(group[seg], return_inverse=True)[1].astype(">u4")
    key = np.ascontiguousarray(np.concatenate((place.view(np.uint8).reshape(-1, 4), rows), axis=1))
    order = np.argsort(key.view(f"S{key.shape[1]}").ravel(), kind="stable")
    rows, size, place, seg, start = rows[order], size[order], place[order], seg[order], start[order]
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), longest)
    shared = np.minimum(shared, np.minimum(size[1:], size[:-1]))
    shared[place[1:] != place[:-1]] = 0
    before = np.where(start > 0, padded[np.maximum(at[seg] + start - 1, 0)].astype(np.int64), -1)
    return seg, start, shared, before


def intervals(shared: np.ndarray, before: np.ndarray, doc: np.ndarray, width: int) -> list[tuple[int, int, int, int]]:
    """(first, last, depth, smallest doc) of every maximal repeat of `width` symbols or more."""
    out = []
    deep = np.flatnonzero(np.diff(np.concatenate(([0], (shared >= width).astype(np.int8), [0]))))
    for a, b in zip(deep[::2].tolist(), deep[1::2].tolist(), strict=True):
        depths, left, docs = [*shared[a:b].tolist(), width - 1], before[a : b + 1].tolist(), doc[a : b + 1].tolist()
        stack: list[list] = []  # depth, first, left symbol (None: they differ), smallest doc
        mark = lambda i: left[i] if left[i] >= 0 else None
        for i, depth in enumerate(depths):
            # suffix i ends intervals deeper than what it shares with the next one
            new = [depth, i, mark(i), docs[i]]
            if stack:
                top = stack[-1]
                top[2] = top[2] if top[2] == mark(i) else None
                top[3] = min(top[3], docs[i])
                new = None
                while stack and stack[-1][0] > depth:
                    d, first, symbol, low = stack.pop()
                    if symbol is None:
                        out.append((a + first, a + i, d, low))
                    if stack and stack[-1][0] >= depth:
                        stack[-1][2] = stack[-1][2] if stack[-1][2] == symbol else None
                        stack[-1][3] = min(stack[-1][3], low)
                    else:
                        new = [depth, first, symbol, low]
                if new is None and stack[-1][0] < depth:
                    new = [depth, i, mark(i), docs[i]]
            if new is not None:
                stack.append(new)
    return out


def find_repeats(group: np.ndarray, length: np.ndarray, flat: np.ndarray, low: np.ndarray, width: int, most: int = SLAB):
    """Occurrences of maximal repeats: segment, start, length, smallest doc. group is sorted."""
    at = np.concatenate(([0], np.cumsum(length)))
    # a segment's own copies repeat whatever else does
    out = [(np.arange(len(group)), np.zeros(len(group), np.int64), length, low)]
    for seg, start in slabs(group, length, at, flat, width, most):
        seg, start, shared, before = enhanced(group, length, at, flat, seg, start)
        found = intervals(shared, before, low[seg], width)
        if found:
            first, last, depth, doc = (np.array(x, np.int64) for x in zip(*found, strict=True))
            size = last - first + 1
            entry = _slices(np.arange(len(seg)), first, last + 1)
            out.append((seg[entry], start[entry], np.repeat(depth, size), np.repeat(doc, size)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def as_bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


def _digest(ids, texts, parts, gone) -> pd.DataFrame:
    rows = []
    for part, spans in zip(parts, gone, strict=True):
        data, at, kept = part.tobytes(), 0, hashlib.sha256()
        for a, b in spans.tolist():
            kept.update(data[at:a])
            at = b
        kept.update(data[at:])
        rows.append((len(data), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), kept.hexdigest()))
    out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"kept_sha256": object})
    out.insert(0, "doc_id", ids_of(ids))
    return out


def suffix_array_dedup(docs: DataFrame, text: str = "text", plan: Plan = PLAN, **how) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    Null texts count as empty. Rows of one doc_id never take from each other; null doc_ids come after all
    others and never take from each other. An empty table gives no rows; extra columns are not read.
    Segments are compared by 64-bit hashes. A text is handled whole by one task, in memory of about 100
    bytes for each of its bytes.
    """
    return removed_spans(docs, as_bytes, find_repeats, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", plan, text, **how)


def _texts(ids, texts, parts, gone) -> pd.DataFrame:
    """The kept text; bytes left of a cut character are dropped."""
    rows = []
    for part, spans in zip(parts, gone, strict=True):
        keep = np.ones(len(part), bool)
        for a, b in spans.tolist():
            keep[a:b] = False
        rows.append(part[keep].tobytes().decode("utf-8", "ignore"))
    return pd.DataFrame({"doc_id": ids_of(ids), "text": pd.Series(rows, dtype=object)})


def kept_texts(docs: DataFrame, text: str = "text", plan: Plan = PLAN, **how) -> DataFrame:
    """doc_id and the text without its repeats."""
    return removed_spans(docs, as_bytes, find_repeats, _texts, "doc_id long, text string", plan, text, **how)
