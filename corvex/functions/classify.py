"""Facets, task kinds, shards and intents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import AUTHORITY_PROFILES, FACET_WORDS, FALLBACK_INTENT, INTENTS, SYSTEM_AUTHORITY, SYSTEM_DEFAULT_AUTHORITY, TASK_AID, TASK_FORM, TASK_INNOVATION, TASK_WORDS
from .text import clean_text, contains_any, normalize_py, normalize_text, stable_slug


def infer_facet(record_type: Column, text: Column, category: Column | None = None) -> Column:
    """text: normalized section, path, tags, title, content and category."""
    out = F.when((record_type == "external") & (F.contains(category, F.lit("external_system")) if category is not None else F.lit(False)), "system").when(record_type == "external", "external").when(record_type == "attachment", "download")
    for facet, words in FACET_WORDS:
        out = out.when(contains_any(text, words), facet)
    return out.otherwise("notice_article")


def infer_task_kind(source_id: Column, facet: Column, record_type: Column, text: Column) -> Column:
    """text: normalized title, section, path, tags, facet and record type."""
    out = F.when(facet == "system", "system_entry").when((record_type == "attachment") | (facet == "download") | contains_any(text, TASK_FORM), "form_download")
    for kind, words in TASK_WORDS:
        out = out.when(contains_any(text, words), kind)
    out = out.when((source_id == "xsc") & contains_any(text, TASK_AID), "scholarship_aid").when(source_id == "xsc", "student_affairs")
    return out.when((source_id == "cxcy") | contains_any(text, TASK_INNOVATION), "innovation_entrepreneurship").otherwise("broad_exploratory")


def authority_profile(source_id: Column, task_kind: Column) -> Column:
    out = F
    for source, profile in AUTHORITY_PROFILES.items():
        out = out.when(source_id == source, profile)
    return out.otherwise(F.concat_ws("_", source_id, task_kind))


def shard_year(published: Column, version: Column) -> Column:
    """The first year 19xx or 20xx of the published or else version date."""
    date = clean_text(published)
    date = F.when(date == "", clean_text(version)).otherwise(date)
    year = F.regexp_extract(date, r"(20\d{2}|19\d{2})", 1)
    return F.when(year == "", "undated").otherwise(year)


def shard_bucket(doc_id: Column, buckets: int = 4) -> Column:
    first = F.conv(F.substring(F.sha1(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 2), 16, 10).cast("int")
    return F.concat(F.lit("b"), (first % buckets).cast("string"))


def shard_id(source_id: Column, facet: Column, record_type: Column, year: Column, section: Column, doc_id: Column, stable: bool = False) -> Column:
    slug = lambda c, f, n=48: stable_slug(c, f, n, stable)
    return F.concat_ws("__", slug(source_id, "source"), slug(facet, "facet"), slug(record_type, "record"), year, slug(section, "root", 32), shard_bucket(doc_id))


def local_index_id(source_id: Column, facet: Column, year: Column) -> Column:
    return F.concat_ws("__", source_id, facet, year)


def intent_of(query: Column, stable: bool = False) -> Column:
    """Struct of intent, authority sources and freshness mode of each query; the first rule that matches wins."""
    text = normalize_text(query, stable)
    dynamic = F
    for source, words in SYSTEM_AUTHORITY:
        dynamic = dynamic.when(contains_any(text, [normalize_py(w) for w in words]), F.array(F.lit(source)))
    dynamic = dynamic.otherwise(F.array(*map(F.lit, SYSTEM_DEFAULT_AUTHORITY)))
    item = lambda name, sources, mode: F.struct(F.lit(name).alias("intent"), (dynamic if sources is None else F.array(*map(F.lit, sources))).alias("sources"), F.lit(mode).alias("mode"))
    out = F
    for name, words, sources, mode in INTENTS:
        out = out.when(contains_any(text, [normalize_py(w) for w in words]), item(name, sources, mode))
    return out.otherwise(item(*FALLBACK_INTENT))


def detect_intent(query: str) -> tuple[str, list[str], str]:
    """intent_of for one query on the driver."""
    text = normalize_py(query)
    hit = lambda words: any(normalize_py(w) in text for w in words)
    for name, words, sources, mode in INTENTS:
        if hit(words):
            return name, next(([s] for s, w in SYSTEM_AUTHORITY if hit(w)), SYSTEM_DEFAULT_AUTHORITY) if sources is None else sources, mode
    return FALLBACK_INTENT


def source_of(source_id: Column, site_id: Column, doc_id: Column) -> Column:
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(source_id), filled(site_id), F.split(doc_id, "-")[0], F.lit(""))
