"""Secret scans: an Aho-Corasick prefilter, anchored expressions at its hits, embedded checksums.

One automaton holds every keyword; an expression runs only at a keyword's hit, anchored there. Hex runs
have no keyword and get their own scan. Tokens that carry a checksum (six base-62 digits of the CRC-32
of what precedes them) count only if it agrees.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .common import by_python, strings

#: The kinds in order, their keywords, and their expressions.
KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ANCHORED = {
    "assign": re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]+"),
    "npm": re.compile(r"npm_[A-Za-z0-9]+"),
}
HEX = re.compile(r"[0-9a-f]{16,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLD = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def base62(value: int, width: int = 6) -> str:
    out = ""
    while value:
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out.rjust(width, "0")


def _checked(token: str) -> bool:
    """40 characters: a prefix of four, 30 of entropy, six of checksum over the entropy."""
    return len(token) == 40 and base62(zlib.crc32(token[4:34].encode())) == token[34:]


VALID = {"assign": lambda m: len(m[2]) >= 12, "access": lambda m: len(m[0]) >= 18, "github": lambda m: _checked(m[0]), "npm": lambda m: _checked(m[0])}


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def scan(text: str | None, machine) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of every secret, sorted; matches of a kind never overlap, and failing ones are dropped."""
    if not text:
        return []
    low = text.lower()
    if len(low) != len(text):  # some capitals have longer small forms
        low = text.translate(_FOLD)
    out, ends = [], dict.fromkeys(KEYWORDS, 0)
    for last, (kind, size) in sorted((last, x) for last, x in machine.iter(low)):
        start = last + 1 - size
        if start >= ends[kind] and (m := ANCHORED[kind].match(text, start)):
            ends[kind] = m.end()
            if VALID[kind](m):
                out.append((start, KINDS.index(kind), m.end()))
    out += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, str]], base: bool = False) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if not base or k < 3)


def secret_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of docs, repeated ones included: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked.

    Null and empty texts have no spans; null doc_ids stay null; an empty table gives no rows; extra
    columns are not read. Memory is bounded by one Arrow batch of texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for batch in batches:
            found = [scan(t, machine) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": strings(batch["doc_id"]),
                **{f"n_{kind}": [sum(k == i for _, k, _ in x) for x in found] for i, kind in enumerate(KINDS[:3])},
                "base_sha256": strings([hashlib.sha256(joined(x, base=True).encode()).hexdigest() for x in found]),
                "spans": strings([joined(x) for x in found]),
                "n_checked": [sum(k > 2 for _, k, _ in x) for x in found],
            })

    return by_python(docs, run, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long", text)
