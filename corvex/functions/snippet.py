"""Snippets and highlights: matches are found in normalized text and mapped back to the source."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

from .constants import SNIPPET_AFTER, SNIPPET_BEFORE, SNIPPET_FALLBACK, SNIPPET_WEIGHTS
from .text import normalize_py


@lru_cache(maxsize=4096)
def _folded(char: str) -> str:
    return "".join(unicodedata.normalize("NFKC", char).lower().split())


def searchable(text: str) -> tuple[str, list[int]]:
    """Normalized text and the source place of each of its characters."""
    out, places = [], []
    for i, char in enumerate(text):
        folded = _folded(char)
        out.append(folded)
        places += [i] * len(folded)
    return "".join(out), places


def find_matches(text: str, terms: list[str]) -> list[tuple[int, int, str]]:
    """start, end and term of every match, overlapping ones included."""
    folded, places = searchable(text)
    found = []
    for term in terms:
        at = folded.find(term)
        while at >= 0:
            found.append((places[at], places[at + len(term) - 1] + 1, term))
            at = folded.find(term, at + 1)
    return found


def highlights(text: str, terms: list[str]) -> list[tuple[int, int, str]]:
    """Matches by start, longer ones first, that overlap none before."""
    out: list[tuple[int, int, str]] = []
    for match in sorted(find_matches(text, terms), key=lambda m: (m[0], m[0] - m[1])):
        if not out or match[0] >= out[-1][1]:
            out.append(match)
    return out


def plain_segments(text: str, terms: list[str]) -> list[tuple[str, bool]]:
    """text cut into pieces, highlighted or not, by terms as they stand."""
    spans, low, end = [], text.lower(), 0
    for start, stop in sorted((i, i + len(t)) for t in {t.lower() for t in terms if t} for i in range(len(low)) if low.startswith(t, i)):
        if start >= end:
            spans.append((start, stop))
            end = stop
    out, at = [], 0
    for start, stop in spans:
        out += [(text[at:start], False)] * (start > at) + [(text[start:stop], True)]
        at = stop
    return out + [(text[at:], False)] * (at < len(text))


def best_snippet(fields: dict[str, str], query: str, terms: list[str]) -> tuple[str, str, bool]:
    """field, text and whether it is only a fallback, from the best-scored match of all fields."""
    q = normalize_py(query)
    wanted = sorted(dict.fromkeys(t for t in map(normalize_py, [query, *terms]) if len(t) >= 2), key=len, reverse=True)
    best, texts = None, {k: " ".join(v.split()) for k, v in fields.items() if v and v.strip()}
    for name, text in texts.items():
        for start, end, term in find_matches(text, wanted):
            score = SNIPPET_WEIGHTS[name] + 1000 * (term == q) + 12 * len(term) + max(0, 40 - start // 8)
            if best is None or score > best[0] or score == best[0] and start < best[1]:
                best = (score, start, end, name)
    if best:
        _, start, end, name = best
        text, a, b = texts[name], max(0, start - SNIPPET_BEFORE), min(len(texts[name]), end + SNIPPET_AFTER)
        return name, f"{'...' * (a > 0)}{text[a:b].strip()}{'...' * (b < len(text))}", False
    for name, text in texts.items():
        return name, text[:SNIPPET_FALLBACK].strip() + "..." * (len(text) > SNIPPET_FALLBACK), True
    return "", "", True


def snippet_column(query: str, terms: list[str], fields: dict[str, str]):
    """Struct of field, text and fallback; fields maps snippet fields, in order of preference, to columns. Use it on the top rows, after the limit:
    it counts as not deterministic, because Spark moves other projections below a limit, where every row would run it."""
    names = list(fields)

    @F.pandas_udf("field string, text string, fallback boolean")
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = [best_snippet(dict(zip(names, r, strict=True)), query, terms) for r in frame.itertuples(index=False)]
        return pd.DataFrame({"field": pd.Series([r[0] for r in rows], dtype=object), "text": pd.Series([r[1] for r in rows], dtype=object), "fallback": [r[2] for r in rows]})

    return run.asNondeterministic()(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in fields.items())))
