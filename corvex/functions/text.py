"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .constants import FNV_BASIS, FNV_PRIME

#: All characters that Unicode calls white space; as plain ranges Java matches them faster than by property.
BLANKS = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BLANK_CHARS = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
RUNS = r"[一-鿿]{2,}|[a-z0-9][a-z0-9._-]{1,}"


def nfkc(value: Column) -> Column:
    """Compatibility composition, which no built-in function has."""

    @F.pandas_udf(StringType())
    def compose(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v)).astype(object)

    return compose(value)


def _text(value) -> Column:
    return F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))


def clean_text(value) -> Column:
    """Blanks collapsed to one space, ends trimmed; null is empty."""
    return F.trim(F.regexp_replace(_text(value), BLANKS, " "))


def normalize_text(value, stable: bool = False) -> Column:
    """NFKC, lower case, all blanks dropped. stable: the text is in NFKC already, so no Python is needed."""
    text = _text(value)
    return F.translate(F.lower(text if stable else nfkc(text)), BLANK_CHARS, "")  # a third of a pattern's time


def sha1_text(value: Column, length: int = 20) -> Column:
    return F.substring(F.sha1(value), 1, length)


def sha256_text(value: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(value, 256), 1, length)


def stable_slug(value, fallback: str = "unknown", max_length: int = 48, stable: bool = False) -> Column:
    slug = F.btrim(F.regexp_replace(normalize_text(value, stable), r"[^a-z0-9一-鿿_-]+", "-"), F.lit("-"))
    return F.substring(F.coalesce(F.nullif(slug, F.lit("")), F.lit(fallback)), 1, max_length)


def canonical_title(value, whole: bool = True) -> Column:
    """Without a leading label in lenticular brackets; if nothing else is left, the whole title, or nothing if not whole."""
    title = clean_text(value)
    rest = F.btrim(F.regexp_replace(F.regexp_replace(title, "^【[^】]{1,24}】", ""), BLANKS, " "), F.lit(" -_"))
    return F.coalesce(F.nullif(rest, F.lit("")), title) if whole else rest


def unique_strings(values: Column, limit: int | None = None) -> Column:
    out = F.array_distinct(F.filter(F.transform(values, clean_text), lambda v: v != ""))
    return out if limit is None else F.slice(out, 1, limit)


def _runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(RUNS), F.lit(0))


def _is_cjk(run: Column) -> Column:
    """A run is of one kind, so its first character tells."""
    return run >= "一"


def _grams(run: Column, sizes: tuple[int, int]) -> Column:
    """n-grams by size, then place; sizes beyond the run's length have none (a sequence would count down)."""
    one = lambda n: F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(0), F.length(run) - n), lambda i: F.substring(run, i + 1, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*(one(n) for n in range(sizes[0], sizes[1] + 1)))


def tokens(value, cjk_max_n: int = 3, cap: int | None = None, stable: bool = False, normalized: bool = False) -> Column:
    """Distinct tokens in order of generation: CJK runs of 16 or fewer and their n-grams, ASCII runs.

    A cap is looked at after n-grams and ASCII runs, not after whole runs, so cap + 1 tokens can come out.
    """
    text = _text(value) if normalized else normalize_text(value, stable)
    return _let(text, lambda t: _tokens(t, cjk_max_n, cap))


def _tokens(text: Column, cjk_max_n: int, cap: int | None) -> Column:
    if cap is None:
        whole = lambda r: F.when(F.length(r) <= 16, F.array(r)).otherwise(F.array().cast("array<string>"))
        # texts without CJK, the most, need no n-grams
        return F.when(~text.rlike("[一-鿿]"), F.array_distinct(_runs(text))).otherwise(F.array_distinct(F.flatten(F.transform(_runs(text), lambda r: F.when(_is_cjk(r), F.concat(whole(r), _grams(r, (2, cjk_max_n)))).otherwise(F.array(r))))))
    kind = "array<struct<t:string,c:boolean>>"
    item = lambda t, c: F.struct(t.alias("t"), F.lit(c).alias("c"))
    marked = lambda r: F.when(_is_cjk(r), F.concat(F.when(F.length(r) <= 16, F.array(item(r, False))).otherwise(F.array().cast(kind)), F.transform(_grams(r, (2, cjk_max_n)), lambda g: item(g, True)))).otherwise(F.array(item(r, True)))
    every = F.flatten(F.transform(_runs(text), marked))

    def cut(rows: Column, distinct: Column) -> Column:
        # Where the cap is reached by a whole run, the n-gram after it, the run's first one, still comes in.
        last = F.get(distinct, F.lit(cap - 1))
        looked_at = F.get(F.filter(rows, lambda x: x["t"] == last), F.lit(0))["c"]
        first = F.slice(distinct, 1, cap)
        more = ~looked_at & ~F.array_contains(first, F.substring(last, 1, 2))
        return F.when(F.size(distinct) < cap, distinct).when(more, F.slice(distinct, 1, cap + 1)).otherwise(first)

    return _let(every, lambda rows: _let(F.array_distinct(F.transform(rows, lambda x: x["t"])), lambda d: cut(rows, d)))


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def phrase_tokens(phrase: Column, max_n: int = 5) -> Column:
    """The phrase itself and its tokens, longest first, equal lengths in order of generation."""
    found = F.flatten(F.transform(_runs(phrase), lambda r: F.when(_is_cjk(r), _grams(r, (2, max_n))).otherwise(F.array(r))))
    unique = F.array_distinct(F.concat(F.array(phrase), found))
    keyed = F.array_sort(F.transform(unique, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))))
    return F.transform(keyed, lambda x: x["t"])


def summarize(content, title, limit: int = 180) -> Column:
    """The start of the content without the title that leads it; the title if nothing is left.

    Only as much of a long content is cleaned as its summary can need, and each piece once.
    """
    raw = _text(content)

    def cut(text: Column, head: Column) -> Column:
        rest = F.when(F.startswith(text, head), F.trim(F.substring(text, F.length(head) + 1, F.length(text)))).otherwise(text)
        return _let(F.substring(rest, 1, limit), lambda s: F.when(s == "", head).otherwise(s))

    def of(start: Column, head: Column) -> Column:
        enough = (F.length(start) >= F.length(head) + limit + 2) | (F.length(raw) <= 2048)
        return F.when(enough, cut(start, head)).otherwise(_let(clean_text(raw), lambda whole: cut(whole, head)))

    return _let(clean_text(title), lambda head: _let(clean_text(F.substring(raw, 1, 2048)), lambda start: of(start, head)))


def doc_host(url) -> Column:
    """The authority of a URL: user and port stay."""
    return F.regexp_extract(_text(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def fnv1a(token: Column, seed: int) -> Column:
    """32-bit FNV-1a with the seed in the offset basis, over UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(F.encode(token, "UTF-8")), F.lit(".."), F.lit(0))
    byte = lambda p: F.conv(p, 16, 10).cast("bigint")
    return F.aggregate(pairs, F.lit((FNV_BASIS ^ seed) & 0xFFFFFFFF).cast("bigint"), lambda h, p: (h.bitwiseXOR(byte(p)) * F.lit(FNV_PRIME).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))


def contains_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def exam_text(value) -> Column:
    """No-break spaces as spaces, ends trimmed, null as empty."""
    return F.regexp_replace(F.translate(_text(value), " ", " "), r"(?U)^\s+|\s+$", "")


def exam_count(value) -> Column:
    return F.coalesce(_text(value).try_cast("int"), F.lit(0))


def bytes_label(value: Column) -> Column:
    return F.when(value < 1024, F.concat(value.cast("string"), F.lit(" B"))).when(value < 1 << 20, F.concat(F.format_number(value / 1024, 1), F.lit(" KB"))).otherwise(F.concat(F.format_number(value / (1 << 20), 1), F.lit(" MB")))


def normalize_py(value: str | None) -> str:
    """normalize_text for one query on the driver."""
    return "".join(unicodedata.normalize("NFKC", value or "").lower().split())
