"""Dates, terms and freshness as column expressions; `now` is always a parameter (milliseconds)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import FRESHNESS, OFFICIAL_ENTRY, STALE, STALE_MODES
from .text import clean_text, contains_any, nfkc, normalize_text

DAY_MS = 86_400_000


def normalize_iso_date(raw) -> Column:
    """The date of an ISO date or timestamp, null for anything else."""
    text = clean_text(raw)
    ok = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$") & F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00")).isNotNull()
    return F.when(ok, F.date_format(F.substring(text, 1, 10).try_cast("date"), "yyyy-MM-dd"))


def valid_iso_date(year: Column, month: Column, day: Column) -> Column:
    """Years 1990 to 2035 and dates that exist."""
    made = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
    return F.when(year.try_cast("int").between(1990, 2035), F.date_format(made, "yyyy-MM-dd"))


def infer_academic_year(value) -> Column:
    text = clean_text(value)
    out = []
    for pattern in (r"(20\d{2})\s*[-—~至]\s*(20\d{2})\s*学年", r"(20\d{2})\s*[-—~]\s*(20\d{2})"):
        start, end = (F.regexp_extract(text, pattern, i) for i in (1, 2))
        out.append(F.when(end.try_cast("int") == start.try_cast("int") + 1, F.concat_ws("-", start, end)))
    return F.coalesce(*out)


def infer_term(value, stable: bool = False) -> Column:
    text = normalize_text(value, stable)
    second = contains_any(text, ["第二学期", "下学期", "-2学期", "2学期"])
    first = contains_any(text, ["第一学期", "上学期", "-1学期", "1学期"])
    return F.when(second, "2").when(first, "1")


def infer_version_date(value, published_at: Column | None = None, stable: bool = False) -> Column:
    """The first valid date of three patterns, each by its first match; else month and day in the year of publication."""
    raw = F.coalesce((F.col(value) if isinstance(value, str) else value).cast("string"), F.lit(""))
    text = raw if stable else nfkc(raw)
    parts = lambda p: valid_iso_date(*(F.regexp_extract(text, p, i) for i in (1, 2, 3)))
    found = [parts(r"(20\d{2})[-/.年](\d{1,2})[-/.月](\d{1,2})日?"), parts(r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"), parts(r"(?<!\d)(20\d{2})(\d{2})(\d{2})(?!\d)")]
    if published_at is not None:
        year = F.regexp_extract(F.coalesce(normalize_iso_date(published_at), F.lit("")), r"(20\d{2})", 1)
        day = r"(?<!\d)(\d{1,2})[-/.](\d{1,2})(?!\d)"
        found.append(valid_iso_date(year, F.regexp_extract(text, day, 1), F.regexp_extract(text, day, 2)))
    return F.coalesce(*found)


def date_sort_value(value) -> Column:
    """Milliseconds since 1970, 0 for null and unreadable ones."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.unix_millis(F.try_to_timestamp(text)), F.lit(0).cast("long"))


def resolve_date(published: Column, version: Column, recorded: Column) -> Column:
    """value and kind of the date that stands for a document."""
    present = lambda c: c.isNotNull() & (c != "")
    pair = lambda c, k: F.struct(c.alias("value"), F.lit(k).alias("kind"))
    return F.when(present(published), pair(published, "published")).when(present(version), pair(version, "version")).when(present(recorded), pair(recorded, "recorded")).otherwise(pair(F.lit(None).cast("string"), "undated"))


def date_kind(published: Column, version: Column, recorded: Column) -> Column:
    return F.when(published.isNotNull() & version.isNotNull() & (published != version), "published_and_version").when(published.isNotNull(), "published").when(version.isNotNull(), "version").when(recorded.isNotNull(), "recorded").otherwise("undated")


def date_confidence(kind: Column) -> Column:
    names = {"published_and_version": "source_published_and_title_version", "published": "source_published", "version": "title_or_attachment", "recorded": "recorded_only", "undated": "unknown"}
    out = F
    for k, v in names.items():
        out = out.when(kind == k, v)
    return out


def format_search_date(value) -> Column:
    text = F.col(value) if isinstance(value, str) else value
    plain = F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})", 0)
    return F.when(text.isNull() | (text == ""), "日期未标注").when(plain != "", F.translate(plain, "-", "/")).otherwise(F.coalesce(F.date_format(F.try_to_timestamp(text), "yyyy/MM/dd"), text))


def age_days(millis: Column, now_ms: int) -> Column:
    return F.greatest(F.lit(0.0), (F.lit(now_ms) - millis) / DAY_MS)


def freshness(mode: str, published_ms: Column, version_ms: Column, facet: Column, now_ms: int) -> Column:
    """Decays linearly to 0 at the mode's horizon; form_version looks at the version's date first."""
    if mode == "official_entry":
        return F.when(facet == "system", float(OFFICIAL_ENTRY[0])).otherwise(0.0)
    most, horizon, _ = FRESHNESS[mode]
    first, second = (version_ms, published_ms) if mode == "form_version" else (published_ms, version_ms)
    stamp = F.when(first != 0, first).otherwise(second)
    return F.when(stamp == 0, 0.0).otherwise(F.greatest(F.lit(0.0), most - F.least(age_days(stamp, now_ms), F.lit(float(horizon))) / horizon * most))


def stale_penalty(mode: str, published_ms: Column, version_ms: Column, now_ms: int) -> Column:
    if mode not in STALE_MODES:
        return F.lit(0.0)
    stamp = F.when(published_ms != 0, published_ms).otherwise(version_ms)
    out = F.when(stamp == 0, 0.0)
    for days, score, modes in STALE:
        if modes is None or mode in modes:
            out = out.when(age_days(stamp, now_ms) > days, float(score))
    return out.otherwise(0.0)


def date_floor(date_range: str, now_ms: int) -> int:
    """Earliest millisecond of past_1y, past_3y or past_5y; 0 for any other range."""
    years = {"past_1y": 1, "past_3y": 3, "past_5y": 5}.get(date_range, 0)
    return now_ms - years * 365 * DAY_MS if years else 0


CHINESE_TIME = r"(\d{4})年(\d{1,2})月(\d{1,2})日.*?(\d{1,2}:\d{2})\s*[-~至]\s*(\d{1,2}:\d{2})"
ISO_TIME = r"\(?(\d{4}-\d{1,2}-\d{1,2})\)?.*?(\d{1,2}:\d{2})\s*[-~至]\s*(\d{1,2}:\d{2})"


def exam_time(raw) -> Column:
    """Struct of date, start, end (ISO text at +08:00), minutes and error of an exam's time text."""
    text = F.coalesce(F.col(raw) if isinstance(raw, str) else raw, F.lit(""))
    cn, iso = (lambda i: F.regexp_extract(text, CHINESE_TIME, i)), (lambda i: F.regexp_extract(text, ISO_TIME, i))
    is_cn, is_iso = cn(1) != "", iso(1) != ""
    pad = lambda c: F.lpad(c, 2, "0")
    split = lambda i: F.split(iso(1), "-")[i]
    date = F.when(is_cn, F.concat_ws("-", cn(1), pad(cn(2)), pad(cn(3)))).when(is_iso, F.concat_ws("-", split(0), pad(split(1)), pad(split(2))))
    clock = lambda c: F.concat(F.lpad(c, 5, "0"), F.lit(":00"))
    at = lambda i, j: F.concat(date, F.lit("T"), clock(F.when(is_cn, cn(i)).otherwise(iso(j))))
    start, end = at(4, 2), at(5, 3)
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    ok = a.isNotNull() & b.isNotNull()
    error = F.when(text == "", "Missing time data").when(~(is_cn | is_iso), "Unrecognized date format").when(~ok, "Parsing exception")
    zone = F.lit("+08:00")
    return F.struct(
        F.when(ok, date).alias("date"), F.when(ok, F.concat(start, zone)).alias("start_timestamp"), F.when(ok, F.concat(end, zone)).alias("end_timestamp"),
        F.when(ok, ((F.unix_seconds(b) - F.unix_seconds(a)) / 60).cast("int")).otherwise(0).alias("duration_minutes"), error.alias("parse_error"),
    )
