"""Token counts under a unigram model, by dynamic programming shared along a trie of pre-tokens.

A pre-token is a word with the one space before it, or else a run of blanks. Its token count is that
of its best segmentation into pieces of the vocabulary: the highest sum of scores, and among equal sums
the fewest pieces. The score of a piece of rank r is -ln(r + 2), the shape of a unigram model over a
vocabulary sorted by frequency; every single byte is a piece, so every text has a segmentation.

The distinct pre-tokens of a partition are inserted in one trie of prefixes, each node with the best
segmentation of its prefix, so that a prefix that pre-tokens share is scored once; a terminal's count is
stored for the next time the pre-token comes. Pieces that end at a place are found by a walk back from
it, as in a trie of reversed pieces, so long pieces cost only where they match. Prefixes of more than
STORED bytes are scored without being stored, and of more than STACK of them only a window of last scores
is kept. A trie of more than `keep` prefixes is dropped and begun anew, which bounds memory (about 200
bytes a prefix) and changes no count.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from .common import by_python, strings

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
STACK, STORED = 1 << 16, 256
PRE_TOKEN = re.compile(r"\x20?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?=\x20[^\x20\x09-\x0D])|[\x20\x09-\x0D]+")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> tuple[dict[bytes, float], int]:
    scores: dict[bytes, float] = {}
    with open(path, "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            scores[base64.b64decode(piece)] = -math.log(int(rank) + 2)
    low = min(scores.values()) - 1
    for b in range(256):
        scores.setdefault(bytes([b]), low)
    return scores, max(map(len, scores))


def with_tails(scores: dict[bytes, float]) -> dict[bytes, float | None]:
    """The scores, and None for what only ends some piece: a walk back from a place stops where neither is met."""
    return {piece[i:]: None for piece in scores for i in range(1, len(piece))} | scores


@lru_cache(maxsize=4)
def pieces(path: str) -> tuple[dict[bytes, float | None], int]:
    scores, longest = vocabulary(path)
    return with_tails(scores), longest


class Trie:
    """Prefixes of pre-tokens, each with the best segmentation: its score and its number of pieces, negated."""

    def __init__(self, table: dict[bytes, float | None], longest: int, stored: int = STORED, most: int = STACK) -> None:
        self.table, self.longest, self.stored, self.most = table, longest, stored, most
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.best: list[tuple[float, int]] = [(0.0, 0)]

    def count(self, word: bytes) -> int:
        """Pieces of the word's best segmentation; its prefixes are inserted."""
        child, best, table, longest = self.child, self.best, self.table, self.longest
        node, path = 0, [best[0]]
        for byte in word[: self.stored]:
            after = child.get(node << 8 | byte)
            if after is None:
                break
            node = after
            path.append(best[node])
        gone = 0  # prefixes dropped from the front of the path
        for end in range(len(path), len(word) + 1):
            found = (-math.inf, 0)
            for start in range(end - 1, max(-1, end - longest - 1), -1):
                score = table.get(word[start:end], False)
                if score is False:
                    break
                if score is not None:
                    have = path[start - gone]
                    new = (have[0] + score, have[1] - 1)
                    if new > found:
                        found = new
            path.append(found)
            if end <= self.stored:
                child[node << 8 | word[end - 1]] = len(best)
                node = len(best)
                best.append(found)
            elif len(path) > self.most + longest:
                gone += len(path) - longest
                del path[:-longest]
        return -path[-1][1]


class Terminals(dict):
    """Counts of pre-tokens; one not met yet is inserted in the trie, and stored if it has up to STORED bytes."""

    def __init__(self, made, keep: int) -> None:
        super().__init__()
        self.made, self.keep, self.trie = made, keep, made()

    def __missing__(self, word: str) -> int:
        coded = word.encode("utf-8", "surrogatepass")
        n = self.trie.count(coded)
        if len(self.trie.best) > self.keep:
            self.trie = self.made()
            self.clear()
        if len(coded) <= STORED:
            self[word] = n
        return n


def count_pieces(words: list[bytes], scores: dict[bytes, float], longest: int) -> dict[bytes, int]:
    """Pieces in the best segmentation of each word."""
    return count_walked(words, with_tails(scores), longest)


def count_walked(words: list[bytes], table: dict[bytes, float | None], longest: int, most: int = STACK, stored: int = STORED) -> dict[bytes, int]:
    """The same, given scores with tails."""
    trie = Trie(table, longest, stored, most)
    return {word: trie.count(word) for word in words}


def token_counts(docs: DataFrame, text: str = "text", path: str = VOCABULARY, keep: int = 400_000) -> DataFrame:
    """One row per row of docs, repeated ones included: doc_id, n_bytes, n_pretokens, n_tokens.

    The whole vocabulary counts, and no pre-token is cut. Null and empty texts have 0 of each; null
    doc_ids stay null; an empty table gives no rows; extra columns are not read. `path` must be readable
    by every executor. A text is handled whole by one task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, longest = pieces(path)
        known = Terminals(lambda: Trie(table, longest), keep)
        for batch in batches:
            rows = []
            for text_ in batch["text"]:
                text_ = text_ or ""
                words = PRE_TOKEN.findall(text_)
                rows.append((len(text_.encode("utf-8", "surrogatepass")), len(words), sum(map(known.__getitem__, words))))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_pretokens", "n_tokens"], dtype="int64")
            yield out.assign(doc_id=strings(batch["doc_id"]))[["doc_id", *out.columns]]

    return by_python(docs, run, "n_bytes long, n_pretokens long, n_tokens long", text)
