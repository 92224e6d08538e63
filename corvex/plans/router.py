"""Planning: phrases and terms of a query, filters, the routing directory, and choice of local indexes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import detect_intent
from ..functions.constants import CLASS_LOOKUP, EXAM_HELPER, MAX_LOCAL_REFS, PHASE_BUDGETS, QUERY_ALIASES, REF_UTILITY
from ..functions.dates import date_floor
from ..functions.text import normalize_py, normalize_text

_RUN = re.compile(r"[一-鿿]{2,}|[a-z0-9][a-z0-9._-]+")


def expand_query(query: str, aliases: dict[str, list[str]] | None = None) -> list[str]:
    """Normalized phrases of two characters or more, longest first: the query and every alias group that it touches."""
    groups = QUERY_ALIASES if aliases is None else aliases
    text, found = normalize_py(query), [query]
    for key, others in groups.items():
        members = [key, *others]
        if any((m := normalize_py(x)) and m in text for x in members):
            found += members
    return sorted(dict.fromkeys(p for p in map(normalize_py, found) if len(p) >= 2), key=len, reverse=True)


def query_terms(query: str, aliases: dict[str, list[str]] | None = None) -> list[str]:
    """Phrases and their runs: CJK n-grams of 2 to 5 and ASCII runs, longest first, in order of generation."""
    out: dict[str, None] = {}
    for phrase in expand_query(query, aliases):
        out[phrase] = None
        for run in _RUN.findall(phrase):
            if run[0] >= "一":
                out |= dict.fromkeys(run[i : i + n] for n in range(2, min(5, len(run)) + 1) for i in range(len(run) - n + 1))
            else:
                out[run] = None
    return sorted(out, key=len, reverse=True)


def alias_rows(spark) -> DataFrame:
    return spark.createDataFrame([(k, normalize_py(m)) for k, v in QUERY_ALIASES.items() for m in [k, *v]], "alias_key string, member string")


def expand_queries(queries: DataFrame, aliases: DataFrame, stable: bool = False) -> DataFrame:
    """query_id and phrase for many queries at once: a small broadcast of alias members, matched by substring."""
    text = queries.select("query_id", normalize_text("query", stable).alias("text"))
    hit = text.join(F.broadcast(aliases), F.contains("text", F.col("member"))).select("query_id", "alias_key").distinct()
    more = hit.join(F.broadcast(aliases), "alias_key").select("query_id", F.col("member").alias("phrase"))
    return text.select("query_id", F.col("text").alias("phrase")).unionByName(more).filter(F.length("phrase") >= 2).distinct()


@dataclass(frozen=True)
class Filters:
    source: str = "all"
    facet: str = "all"
    date_range: str = "all"

    @staticmethod
    def value(raw: str | None) -> str:
        return (raw or "").strip() or "all"

    def active(self) -> bool:
        return any(self.value(x) != "all" for x in (self.source, self.facet, self.date_range))

    def condition(self, now_ms: int) -> Column:
        """Over source_id, facet and date_ms; a past range leaves out undated documents."""
        out = F.lit(True)
        if self.value(self.source) != "all":
            out = out & (F.col("source_id") == self.value(self.source))
        if self.value(self.facet) != "all":
            out = out & (F.col("facet") == self.value(self.facet))
        span = self.value(self.date_range)
        if span == "undated":
            out = out & (F.col("date_ms") == 0)
        elif span != "all":
            out = out & (F.col("date_ms") >= date_floor(span, now_ms)) & (F.col("date_ms") != 0)
        return out

    def scope(self, now_ms: int) -> Column:
        """Over source_id, facet and year of local indexes; Parquet partitions by these are pruned."""
        out = F.lit(True)
        if self.value(self.source) != "all":
            out = out & (F.col("source_id") == self.value(self.source))
        if self.value(self.facet) != "all":
            out = out & (F.col("facet") == self.value(self.facet))
        span = self.value(self.date_range)
        if span == "undated":
            out = out & (F.col("year") == "undated")
        elif span != "all":
            floor = 1970 + date_floor(span, now_ms) // 31_556_952_000
            # a document of the year undated may be dated by its record
            out = out & ((F.col("year") == "undated") | (F.col("year").try_cast("int") >= floor))
        return out


def shard_in_scope(filters: Filters, now_ms: int) -> Column:
    """Over source_id, facets and years of the shard catalog."""
    out = F.lit(True)
    if Filters.value(filters.source) != "all":
        out = out & (F.col("source_id") == Filters.value(filters.source))
    if Filters.value(filters.facet) != "all":
        out = out & F.array_contains("facets", Filters.value(filters.facet))
    span = Filters.value(filters.date_range)
    if span == "undated":
        out = out & F.array_contains("years", "undated")
    elif span != "all":
        floor = 1970 + date_floor(span, now_ms) // 31_556_952_000
        out = out & F.exists("years", lambda y: (y == "undated") | (y.try_cast("int") >= floor))
    return out


def local_indexes(docs: DataFrame) -> DataFrame:
    """One row per source, facet and year."""
    sets = F.array_sort(F.collect_set("shard_id"))
    return docs.groupBy("source_id", "facet", "year").agg(F.count(F.lit(1)).alias("doc_count"), sets.alias("shard_ids"), F.sum(F.octet_length("content")).alias("bytes")).withColumn("index_id", F.concat_ws("__", "source_id", "facet", "year"))


def unique_refs(refs: DataFrame, order: str = "position") -> DataFrame:
    """Refs of local indexes from several choices, one row for each index_id: the first in order, ties by all its values."""
    rest = [c for c in refs.columns if c not in ("index_id", order)]
    first = refs.groupBy("index_id").agg(F.min(F.struct(order, *rest)).alias("_first"))
    return first.select("index_id", "_first.*").select(*refs.columns)


def term_matches(docs: DataFrame, terms: DataFrame, blob: str = "blob") -> DataFrame:
    """term and the columns of the documents whose blob holds it; terms is the directory's bounded vocabulary, broadcast."""
    return docs.join(F.broadcast(terms), F.contains(blob, F.col("term")))


def route_counts(matches: DataFrame, dimensions: dict[str, str]) -> DataFrame:
    """term, dim, value, n and rank: Counter.most_common over each dimension, ties by the first document."""
    listed = F.array(*(F.struct(F.lit(d).alias("dim"), F.col(c).cast("string").alias("value")) for d, c in dimensions.items()))
    long = matches.select("term", "doc_index", F.explode(listed).alias("x")).select("term", "doc_index", "x.*")
    counted = long.groupBy("term", "dim", "value").agg(F.count(F.lit(1)).alias("n"), F.min("doc_index").alias("first_doc"))
    order = Window.partitionBy("term", "dim").orderBy(F.desc("n"), "first_doc", "value")
    return counted.withColumn("rank", F.row_number().over(order))


def route_summary(counts: DataFrame, costs: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """One row per term: ranked values of each dimension, matches, priors, cost and utility per KB. costs has index_id and bytes."""
    limits = {"local_index": 24, "shard": 12, "task_kind": 8} | (limits or {})
    keep = F.lit(True)
    for dim, n in limits.items():
        keep = keep & ((F.col("dim") != dim) | (F.col("rank") <= n))
    priced = costs.select(F.lit("local_index").alias("dim"), F.col("index_id").alias("value"), "bytes")
    kept = counts.filter(keep).join(priced, ["dim", "value"], "left")  # one pass over the counts, which come from all texts
    ranked = kept.groupBy("term", "dim").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("v"), F.sum("n").alias("total"), F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"))
    values = lambda d: F.max(F.when(F.col("dim") == d, F.transform("v", lambda x: x["value"]))).alias(f"likely_{d}")
    of = lambda d, c: F.max(F.when(F.col("dim") == d, F.col(c)))
    out = ranked.groupBy("term").agg(*(values(d) for d in ("source", "facet", "year", "task_kind", "record_type", "local_index", "shard")), of("source", "total").alias("matched"), of("local_index", "bytes").alias("cost_bytes"))
    return out.withColumn("utility_per_kb", F.round(1.6 * F.col("matched") / F.greatest(F.lit(1.0), F.col("cost_bytes") / 1024), 6))


@dataclass(frozen=True)
class QueryPlan:
    query: str
    phrases: list[str]
    terms: list[str]
    intent: str
    sources: list[str]
    mode: str
    filters: Filters = field(default_factory=Filters)
    route: str = "collection"


def build_plan(query: str, filters: Filters | None = None, aliases: dict[str, list[str]] | None = None) -> QueryPlan:
    intent, sources, mode = detect_intent(query)
    text = query.strip()
    route = "home" if len(text) < 2 else "exam" if re.match(CLASS_LOOKUP, text.upper()) or text == EXAM_HELPER else "collection"
    return QueryPlan(query, expand_query(query, aliases), query_terms(query, aliases), intent, list(sources), mode, filters or Filters(), route)


#: Columns of the directory and those of local indexes that they list.
ROUTED_BY = {"likely_local_index": "index_id", "likely_source": "source_id", "likely_facet": "facet"}


def with_utility(indexes: DataFrame, plan: QueryPlan, routes: DataFrame | None = None) -> DataFrame:
    """Local indexes with turn (place in the directory's answers, null for none) and utility: what an index promises for each KB it costs.

    routes is the directory (route_summary): of the plan's terms, listed indexes count four times, listed or
    authoritative sources twice, listed facets one and a half times; then come year and documents.
    """
    out = indexes
    if routes is None:
        out = out.withColumns({"turn": F.lit(None).cast("int"), "by_source": F.lit(False), "by_facet": F.lit(False)})
    else:
        hits = routes.filter(F.col("term").isin(plan.terms))
        order = F.element_at(F.create_map(*(F.lit(x) for n, t in enumerate(plan.terms) for x in (t, n))), F.col("term"))
        # One pass over the directory, whose rows come from all texts: its keys of each kind, then one join.
        no = lambda c: F.transform(c, lambda v, p: F.struct(F.lit(c).alias("kind"), v.alias("key"), p.cast("int").alias("p")))
        keys = hits.select(order.alias("o"), F.explode(F.flatten(F.array(*(no(c) for c in ROUTED_BY)))).alias("k")).groupBy("k.kind", "k.key").agg(F.min(F.struct("o", "k.p")).alias("at"))
        keys = keys.select("kind", "key", F.row_number().over(Window.partitionBy("kind").orderBy("at", "key")).alias("turn"))  # 24 indexes a term at most
        own = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in ROUTED_BY.items()))
        rows = indexes.select(F.struct(*indexes.columns).alias("row"), F.explode(own).alias("k")).select("row", "k.*").join(keys, ["kind", "key"], "left")
        turn = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("turn")))
        found = rows.groupBy("row").agg(turn("likely_local_index").alias("turn"), turn("likely_source").isNotNull().alias("by_source"), turn("likely_facet").isNotNull().alias("by_facet"))
        out = found.select("row.*", "turn", "by_source", "by_facet")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    w = REF_UTILITY
    routed = F.when(F.col("turn").isNotNull(), w["routed"]).otherwise(1.0)
    source = F.when(true("by_source") | F.col("source_id").isin(plan.sources), w["source"]).otherwise(1.0)
    facet = F.when(true("by_facet"), w["facet"]).otherwise(1.0)
    fresh = F.coalesce((F.col("year").try_cast("int") - w["first_year"]) / w["years"], F.lit(w["oldest"]))
    fresh = F.greatest(F.lit(w["oldest"]), F.least(F.lit(w["newest"]), fresh))
    cost = F.greatest(F.lit(1.0), F.col("bytes") / 1024)
    return out.withColumn("utility", F.round(routed * source * facet * fresh * F.log2(F.col("doc_count") + 2) / cost, 6)).drop("by_source", "by_facet")


def select_refs(indexes: DataFrame, plan: QueryPlan, now_ms: int, routes: DataFrame | None = None, most: int = MAX_LOCAL_REFS) -> DataFrame:
    """The best local indexes in the scope of the plan's filters, with their position: those the directory lists, or all where it lists none."""
    rows = with_utility(indexes.filter(plan.filters.scope(now_ms)), plan, routes)
    order = [F.desc("utility"), F.asc_nulls_last("turn"), F.desc_nulls_last(F.col("year").try_cast("int")), F.desc("doc_count"), F.asc("index_id")]
    best = rows.orderBy(F.col("turn").isNull(), *order).limit(most)  # listed ones first, so they are all there, or `most` of them
    some = F.max(F.col("turn").isNotNull()).over(Window.partitionBy())  # `most` rows
    best = best.withColumn("some", some).filter(~F.col("some") | F.col("turn").isNotNull()).drop("some")
    return best.withColumn("position", F.row_number().over(Window.orderBy(*order)))


def within_budget(refs: list[dict], budget: int, least: int) -> list[dict]:
    """Greedy: an index that would pass the budget is skipped and uses none of it, but the first `least` are always taken."""
    out, used = [], 0
    for ref in refs:
        if len(out) < max(least, 1) or used + ref["bytes"] <= budget:
            out.append(ref)
            used += ref["bytes"]
    return out


def phase_refs(refs: list[dict]) -> list[list[dict]]:
    return [within_budget(refs, budget, least) for budget, least in PHASE_BUDGETS]


def limit_shards(candidates: DataFrame, shards: int) -> DataFrame:
    """Candidates in order whose shard is among the first `shards` to appear."""
    rank = Window.orderBy(F.desc("light_score"), "doc_index")  # candidates are at most a few hundred rows
    first = candidates.withColumn("at", F.row_number().over(rank))
    seen = first.groupBy("shard_id").agg(F.min("at").alias("first_at")).orderBy("first_at").limit(shards)
    return first.join(F.broadcast(seen), "shard_id").drop("first_at", "at")
