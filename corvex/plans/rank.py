"""Relevance of documents to a query as one column expression, with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions.classify import detect_intent
from ..functions.constants import AUTHORITY, FACET_BOOSTS, FORM_EXTERNAL, FRESHNESS, HARDSHIP, OFFICIAL_ENTRY, SHORT_LANDING, TASK_KIND_MATCH, TERM_MATCH, TEXT_MATCH, UNSEEN_LIGHT_SCORE
from ..functions.text import normalize_py


def rank_columns(query: str, terms: list[str], now_ms: int) -> dict[str, Column]:
    """score and score_reason over the columns of search_view: normalized n_* fields, facet, record_type,
    source_id, task_kind, published_ms, version_ms and light_score (null: no posting was hit)."""
    intent, sources, mode = detect_intent(query)
    q = F.lit(normalize_py(query))
    name = {k: F.col(f"n_{k}") for k in ("title", "canonical", "attachment", "external", "url", "section", "summary", "content", "tags")}
    has = lambda k, x: F.contains(name[k], x)
    parts: list[tuple[Column, Column, str]] = []  # condition, score, reason
    exact = (name["title"] == q) | (name["canonical"] == q)
    part_of = ~exact & (has("title", q) | has("canonical", q))
    parts.append((exact, F.when(F.col("facet") == "system", TEXT_MATCH["system_title_exact"]).otherwise(TEXT_MATCH["title_exact"]), "标题精确"))
    parts.append((part_of, F.lit(TEXT_MATCH["title_contains"]), "标题包含"))
    if len(normalize_py(query)) >= TEXT_MATCH["long_query"]:
        parts.append((part_of, F.lit(TEXT_MATCH["long_title_extra"]), "标题短语命中"))
    for k, reason in (("attachment", "附件名命中"), ("external", "外部入口命中"), ("url", "URL 命中"), ("section", "栏目路径命中"), ("content", "正文命中"), ("tags", "标签命中")):
        parts.append((has(k, q), F.lit(TEXT_MATCH[k]), reason))
    score = F.coalesce(F.col("light_score"), F.lit(UNSEEN_LIGHT_SCORE)).cast("double")
    matched = []
    for term in terms[:12]:
        t = F.lit(term)
        value = F.when(has("title", t) | has("canonical", t), TERM_MATCH["title"])
        for k in ("attachment", "external", "url", "section"):
            value = value.when(has(k, t), TERM_MATCH[k])
        value = value.when(has("summary", t) | has("content", t), TERM_MATCH["body"])
        score = score + F.coalesce(value, F.lit(0))
        matched.append(F.when(value.isNotNull(), t))
    top = F.slice(F.array_compact(F.array(*matched)), 1, 6) if matched else F.array().cast("array<string>")
    words = F.when(F.size(top) > 0, F.concat(F.lit("词项："), F.array_join(top, "、")))
    late: list[tuple[Column, Column, str]] = []
    official = F.col("source_id").isin(sources)
    broad = intent == "broad_exploratory"
    late.append((official, F.lit(AUTHORITY["broad" if broad else "focused"]), "权威来源"))
    if len(sources) == 1 and not broad:
        score = score - F.when(official, 0).otherwise(AUTHORITY["single_miss"])
    for facet, intents, boost, reason in FACET_BOOSTS:
        if intent in intents:
            late.append((F.col("facet") == facet, F.lit(boost), reason))
    late.append((F.col("task_kind") == intent, F.lit(TASK_KIND_MATCH), "任务匹配"))
    fresh = dates.freshness(mode, F.col("published_ms"), F.col("version_ms"), F.col("facet"), now_ms)
    late.append((fresh > 0, fresh, OFFICIAL_ENTRY[1] if mode == "official_entry" else FRESHNESS[mode][2]))
    stale = dates.stale_penalty(mode, F.col("published_ms"), F.col("version_ms"), now_ms)
    late.append((stale > 0, -stale, "历史内容降权"))
    if intent == "academic_policy":
        short = (name["title"] == q) & F.col("facet").isin("workflow", "news", "notice_article") & (F.col("published_ms") == 0) & (F.length(name["content"]) < 220)
        late.append((short, F.lit(-SHORT_LANDING), "短入口降权"))
    if intent == "form_download":
        late.append((F.col("record_type") == "external", F.lit(-FORM_EXTERNAL), "外链非下载降权"))
    if intent == "scholarship_aid":
        late.append((has("title", F.lit("学业困难")) & ~has("title", F.lit("家庭经济困难")), F.lit(-HARDSHIP), "非资助困难降权"))
    for condition, value, _ in parts + late:
        score = score + F.when(condition, value).otherwise(0)
    told = [F.when(c, F.lit(r)) for c, _, r in parts] + [words] + [F.when(c, F.lit(r)) for c, _, r in late]
    reason = F.array_join(F.array_compact(F.array(*told)), "；")
    return {"score": score, "score_reason": F.when(reason == "", "倒排候选").otherwise(reason)}


def rank(view: DataFrame, query: str, terms: list[str], now_ms: int) -> DataFrame:
    return view.withColumns(rank_columns(query, terms, now_ms))


def ordered(ranked: DataFrame, sort: str = "relevance", limit: int | None = None) -> DataFrame:
    """relevance: score, date, id; date_desc: date, score, id. With a limit Spark keeps only the top rows of each task."""
    keys = [F.desc("score"), F.desc("date_ms")] if sort == "relevance" else [F.desc("date_ms"), F.desc("score")]
    out = ranked.orderBy(*keys, "id")
    return out if limit is None else out.limit(limit)


def merge_ranked(*phases: DataFrame) -> DataFrame:
    """The best-scored row of each id over several phases."""
    every = phases[0]
    for p in phases[1:]:
        every = every.unionByName(p)
    return every.groupBy("id").agg(F.max_by(F.struct(*[c for c in every.columns if c != "id"]), "score").alias("r")).select("id", "r.*")
