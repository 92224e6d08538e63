"""Validation: every check returns rows that break it, so an empty result passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import EVIDENCE_LEVELS
from ..functions.text import normalize_py


def obsolete_keys(schema: T.StructType, obsolete: set[str], path: str = "$") -> list[str]:
    """Paths of obsolete fields anywhere in a schema."""
    out = []
    for f in schema.fields:
        here, kind = f"{path}.{f.name}", f.dataType
        if f.name in obsolete:
            out.append(here)
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if isinstance(kind, T.StructType):
            out += obsolete_keys(kind, obsolete, here)
    return out


def hashed_path(path: Column, extension: str = "json") -> Column:
    return path.rlike(rf"\.[0-9a-f]{{16}}\.{extension}$")


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_from(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(present.select(key), key, "left_anti")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def shard_count_faults(catalog: DataFrame, documents: DataFrame) -> DataFrame:
    """Shards whose documents differ in number from the catalog's."""
    actual = documents.groupBy("shard_id").agg(F.count(F.lit(1)).alias("actual"))
    return catalog.join(actual, "shard_id", "full_outer").filter(~F.col("document_count").eqNullSafe(F.col("actual"))).select("shard_id", "document_count", "actual")


def document_faults(documents: DataFrame) -> DataFrame:
    """id and rule: repeated ids, empty required fields, wrong dates of external records."""
    again = duplicates(documents, "id").select("id", F.lit("duplicate_id").alias("rule"))
    empty = F.col("title").isNull() | (F.col("title") == "") | F.col("url").isNull() | F.col("source_id").isNull()
    outside = F.col("record_type") == "external"
    rules = F.array_compact(F.array(F.when(empty, "required"), F.when(outside & F.col("recorded_at").isNull(), "external_recorded_at"), F.when(outside & F.col("published_at").isNotNull(), "external_published_at")))
    return again.unionByName(documents.select("id", F.explode(rules).alias("rule")))


def index_faults(indexes: DataFrame, shards: DataFrame) -> DataFrame:
    """Local indexes that refer to shards that do not exist."""
    return indexes.select("index_id", F.explode("shard_ids").alias("shard_id")).join(shards, "shard_id", "left_anti")


def evidence_faults(attachments: DataFrame) -> DataFrame:
    return attachments.filter(~F.col("evidence").isin(EVIDENCE_LEVELS))


def count_faults(expected: DataFrame, documents: DataFrame) -> DataFrame:
    """kind, wanted and present numbers that differ."""
    have = documents.groupBy("kind").agg(F.count(F.lit(1)).alias("present"))
    return expected.join(have, "kind", "left").filter(F.col("wanted") != F.coalesce("present", F.lit(0)))


def forbidden_columns(rows: DataFrame, forbidden=("content", "summary", "attachments", "provenance")) -> list[str]:
    return [c for c in rows.columns if c in forbidden]


def unreachable(queries: list[str], blobs: DataFrame) -> list[str]:
    """Queries that no document's blob holds, in one pass."""
    held = blobs.agg(*(F.max(F.contains("blob", F.lit(normalize_py(q)))).alias(f"q{i}") for i, q in enumerate(queries))).first()
    return [q for i, q in enumerate(queries) if not held[i]]


def over_budget(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    return sizes.join(F.broadcast(budgets), "metric").filter(F.col("value") > F.col("budget"))


def manifest_count_faults(manifest: DataFrame, exams: DataFrame) -> DataFrame:
    return manifest.crossJoin(exams.agg(F.count(F.lit(1)).alias("rows"))).filter("total_records <> rows")  # one row each


_CHECKS = ("title_contains", "title_equals", "facet", "record_type", "source_id", "url_matches", "nav_contains", "reason_contains")


def expectation_holds(check: dict[str, str]) -> Column:
    """Conjunction of up to eight optional conditions on a result."""
    out = F.lit(True)
    for name in _CHECKS:
        if (want := check.get(name)) is None:
            continue
        field, _, how = name.partition("_")
        column = {"title": "title", "url": "url", "nav": "nav_path_text", "reason": "score_reason"}.get(field, name)
        c = F.col(column)
        out = out & (F.contains(c, F.lit(want)) if how == "contains" else c.rlike(want) if how == "matches" else c == want)
    return out


def judge(ranked: DataFrame, expectation: dict) -> bool:
    """Whether ranked results (rank from 1) satisfy top1, top_n and forbid_top_n of an expectation."""
    n = expectation.get("n", 12)
    rules = []
    if "top1" in expectation:
        rules.append(F.max(F.coalesce((F.col("rank") == 1) & expectation_holds(expectation["top1"]), F.lit(False))))
    for check in expectation.get("top_n", []):
        rules.append(F.max((F.col("rank") <= n) & expectation_holds(check)))
    for check in expectation.get("forbid_top_n", []):
        rules.append(~F.max((F.col("rank") <= n) & expectation_holds(check)))
    row = ranked.filter(F.col("rank") <= n).agg(*(F.coalesce(r, F.lit(False)).alias(f"r{i}") for i, r in enumerate(rules))).first()
    return all(row)


def phase_gate(phases: DataFrame, limit_bytes: int, share: float) -> DataFrame:
    """phase and whether its bytes keep to an absolute limit or to a share of the last phase's."""
    most = phases.agg(F.max("bytes").alias("most"))
    return phases.crossJoin(F.broadcast(most)).select("phase", ((F.col("bytes") <= limit_bytes) | (F.col("bytes") <= share * F.col("most"))).alias("ok"))
