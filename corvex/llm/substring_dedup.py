"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes are partitioned by prefixes of variable length. Between machines, those around one anchor (a run
of 8 words) go together, and an anchor of more than `split` segments is split by prefixes of a whole window
(see repeats). What one task has of them is split again into groups of at most GROUP suffixes by prefixes
that grow (PREFIXES, then the window) until they fit; small groups are taken together. The suffix tree of
each group is written top-down: the suffixes at a node branch by their next word, and those that agree in
it go on together. Its internal nodes of depth 50 or more whose suffixes differ in the word before are
maximal repeats, and a repeat that reaches back to a smaller doc_id is removed from the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .repeats import BYTE_VALUES, Hashes, Plan, _slices, alone, ids_of, mixed, removed_spans

PLAN = Plan(width=50, gram=8, split=2_000)
#: Suffixes of a group whose tree is built at a time; only those of one and the same window can be more.
GROUP = 1 << 17
#: Words of the prefixes that split groups, before the whole window.
PREFIXES = (1, 2, 4, 8, 16, 32)
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def as_words(text: str) -> np.ndarray:
    """A 64-bit hash of each word."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    edge = np.diff(np.concatenate(([0], (~_BLANK[data]).astype(np.int8), [0])))
    return Hashes(BYTE_VALUES[data]).of(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def prefix_groups(hashes: Hashes, begin: np.ndarray, width: int, most: int) -> Iterator[np.ndarray]:
    """Places in begin of suffixes, at most `most` at a time if their windows allow it; suffixes of one window come together."""
    todo = [(np.arange(len(begin)), [*(n for n in PREFIXES if n < width), width])]
    while todo:
        these, lengths = todo.pop()
        if len(these) <= most or not lengths:
            yield these
            continue
        prefix = hashes.of(begin[these], begin[these] + lengths[0])
        order = np.argsort(prefix, kind="stable")
        head = np.flatnonzero(np.append(True, np.diff(prefix[order]) != 0))
        size = np.diff(np.append(head, len(order)))
        for a, n in zip(head[size > most].tolist(), size[size > most].tolist(), strict=True):
            todo.append((these[order[a : a + n]], lengths[1:]))
        fits = np.repeat(size <= most, size)
        size = size[size <= most]
        if len(size):
            number = (np.cumsum(size) - 1) // most
            cut = (np.cumsum(size) - size)[1:][np.diff(number) > 0]
            yield from np.split(these[order[fits]], cut)


def tree_nodes(words: np.ndarray, hashes: Hashes, begin: np.ndarray, size: np.ndarray, before: np.ndarray, doc: np.ndarray, width: int):
    """Internal nodes of depth `width` or more of the suffix tree, as (suffix, depth, smallest doc) for each suffix under each.

    before: the word before a suffix, and whether it is known, as two rows. A node counts if its suffixes differ in that word."""
    _, node = np.unique(hashes.of(begin, begin + width), return_inverse=True)
    order = np.argsort(node, kind="stable")
    here, node, depth, out = order, node[order], width, []
    while len(here):
        more = size[here] > depth
        word = np.where(more, words[np.minimum(begin[here] + depth, len(words) - 1)], 0)
        order = np.lexsort((word, more, node))
        here, node, word, more = here[order], node[order], word[order], more[order]
        new = np.append(True, node[1:] != node[:-1])
        child = new.copy()
        child[1:] |= (word[1:] != word[:-1]) | ~more[1:] | ~more[:-1]
        head, branch = np.flatnonzero(new), np.flatnonzero(child)
        children = np.diff(np.append(np.searchsorted(branch, head), len(branch)))
        count = np.diff(np.append(head, len(here)))
        left, sure = before[0][here], before[1][here]
        differ = (np.minimum.reduceat(left, head) != np.maximum.reduceat(left, head)) | ~np.logical_and.reduceat(sure, head)
        deep = (count > 1) & (children > 1) & differ
        if deep.any():
            low = np.minimum.reduceat(doc[here], head)
            of = np.repeat(deep, count)
            out.append((here[of], np.full(int(of.sum()), depth), np.repeat(low[deep], count[deep])))
        # children of two suffixes or more go on
        count = np.diff(np.append(branch, len(here)))
        stay = np.repeat(count > 1, count)
        here, node = here[stay], np.repeat(np.arange(len(branch)), count)[stay]
        depth += 1
    return out


def find_repeats(group: np.ndarray, length: np.ndarray, flat: np.ndarray, low: np.ndarray, width: int, most: int = GROUP):
    """Occurrences of maximal repeats: segment, start, length, smallest doc. group is sorted."""
    at = np.concatenate(([0], np.cumsum(length)))
    # a segment's own copies repeat whatever else does
    out = [(np.arange(len(group)), np.zeros(len(group), np.int64), length, low)]
    many = np.flatnonzero(~alone(group))
    count = length[many] - width + 1
    seg = np.repeat(many, count)
    start = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    if len(seg):
        hashes = Hashes(mixed(flat))
        begin = at[seg] + start
        for these in prefix_groups(hashes, begin, width, most):
            s, b = seg[these], begin[these]
            before = (flat[np.maximum(b - 1, 0)], start[these] > 0)
            for suffix, depth, doc in tree_nodes(flat, hashes, b, length[s] - start[these], before, low[s], width):
                out.append((s[suffix], start[these][suffix], depth, doc))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _kept(text: str | None, spans: np.ndarray) -> tuple[int, int, bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").split()  # splits at the same six characters
    n = len(words)
    for a, b in reversed(spans.tolist()):
        del words[a:b]
    return n, n - len(words), b" ".join(words)


def _digest(ids, texts, parts, gone) -> pd.DataFrame:
    rows = []
    for text, spans in zip(texts, gone, strict=True):
        n, removed, kept = _kept(text, spans)
        rows.append((n, removed, hashlib.sha256(kept).hexdigest()))
    out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"]).astype({"kept_sha256": object})
    out.insert(0, "doc_id", ids_of(ids))
    return out


def substring_dedup(docs: DataFrame, text: str = "text", plan: Plan = PLAN, **how) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs.

    Null texts have no words. Rows of one doc_id never take from each other; null doc_ids come after all
    others and never take from each other. An empty table gives no rows; extra columns are not read. Words
    are compared by 64-bit hashes. A text is handled whole by one task.
    """
    return removed_spans(docs, as_words, find_repeats, _digest, "doc_id long, n_words long, n_removed long, kept_sha256 string", plan, text, **how)


def _texts(ids, texts, parts, gone) -> pd.DataFrame:
    rows = [_kept(t, g)[2].decode("utf-8", "surrogatepass") for t, g in zip(texts, gone, strict=True)]
    return pd.DataFrame({"doc_id": ids_of(ids), "text": pd.Series(rows, dtype=object)})


def kept_texts(docs: DataFrame, text: str = "text", plan: Plan = PLAN, **how) -> DataFrame:
    """doc_id and the kept words, joined by one space."""
    return removed_spans(docs, as_words, find_repeats, _texts, "doc_id long, text string", plan, text, **how)
