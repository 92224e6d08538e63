"""Counts, roll-ups and reports over documents, shards, packages and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import EVIDENCE_LEVELS, TRUTH_COUNTS


def counts_by(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def most_common(rows: DataFrame, group: str, value: str, order: str, n: int) -> DataFrame:
    """The n most frequent values of each group, ties by their first occurrence in `order`."""
    counted = rows.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    rank = Window.partitionBy(group).orderBy(F.desc("n"), "first", value)
    return counted.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)


def filter_options(rows: DataFrame, column: str) -> DataFrame:
    """id, count and position: by count, then label."""
    counted = rows.groupBy(F.col(column).alias("id")).agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("position", F.row_number().over(Window.orderBy(F.desc("count"), "id")))  # one row per option


def evidence_coverage(attachments: DataFrame, column: str = "evidence") -> DataFrame:
    return attachments.agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col(column) == level).alias(level) for level in EVIDENCE_LEVELS))


def quality_roll_up(packages: DataFrame) -> DataFrame:
    """Over packages: all, sum, or `mixed` where policies differ, and the latest generated_at."""
    mixed = lambda c: F.when(F.countDistinct(c) > 1, "mixed").otherwise(F.min(c)).alias(c)
    return packages.agg(F.sum("errors").alias("errors"), F.bool_and("all_outcomes").alias("all_outcomes"), mixed("attachment_policy"), mixed("external_policy"), F.max("generated_at").alias("generated_at"))


def truth_counts(packages: DataFrame, fields: list[str] = TRUTH_COUNTS) -> DataFrame:
    """Sums of the packages' counts; a count that is null, or a field that no package has, is 0."""
    total = lambda f: F.sum(F.col(f).cast("long")) if f in packages.columns else F.lit(None).cast("long")
    return packages.agg(*(F.coalesce(total(f), F.lit(0)).alias(f) for f in fields))


def coverage_roll_up(ledger: DataFrame, artifacts: DataFrame) -> DataFrame:
    """One row: shards by state, documents searched and in all, and bytes loaded by role.

    ledger has state, document_count and bytes; artifacts has role (first_screen, local_index or filter) and bytes.
    Scanned shards count as hydrated, and scanned or proved ones as searched."""
    state = lambda *names: F.col("state").isin(*names)
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    shards = ledger.agg(
        F.count_if(state("scanned")).alias("scanned_shards"), F.count_if(state("proved_no_match")).alias("proved_no_match_shards"), F.count_if(state("pending")).alias("pending_shards"), F.count_if(state("failed")).alias("failed_shards"), F.count(F.lit(1)).alias("total_shards"),
        total("document_count", state("scanned", "proved_no_match")).alias("searched_documents"), total("document_count", F.lit(True)).alias("total_documents"), total("bytes", state("scanned")).alias("hydrated_shard_bytes"), (F.count_if(state("pending", "failed")) == 0).alias("exhaustive_complete"),
    )
    loaded = artifacts.agg(*(total("bytes", F.col("role") == role).alias(f"{role}_bytes") for role in ("first_screen", "local_index", "filter")))
    both = shards.crossJoin(loaded)  # one row each
    return both.withColumn("loaded_bytes", F.col("first_screen_bytes") + F.col("local_index_bytes") + F.col("filter_bytes") + F.col("hydrated_shard_bytes"))


def size_report(shards: DataFrame) -> DataFrame:
    return shards.agg(F.count(F.lit(1)).alias("shards"), F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("max_bytes"), F.round(F.avg("bytes"), 4).alias("avg_bytes"), F.sum("document_count").alias("documents"), F.round(F.avg("document_count"), 4).alias("avg_documents"))


def run_statistics(runs: DataFrame, *group: str) -> DataFrame:
    return runs.groupBy(*group).agg(F.round(F.avg("ms"), 4).alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms"))


def compare_metrics(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """metric, both values, change and change in percent; a metric may be on one side only."""
    both = current.select("metric", F.col("value").alias("current")).join(baseline.select("metric", F.col("value").alias("baseline")), "metric", "full_outer")
    change = F.col("current") - F.col("baseline")
    return both.withColumns({"change": change, "change_pct": F.round(F.when(F.col("baseline") != 0, 100 * change / F.col("baseline")), 4)})


def cache_counters(log: DataFrame) -> DataFrame:
    """Hits, misses and bytes by layer of a log (layer, hit, bytes)."""
    return log.groupBy("layer").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.sum(F.when(F.col("hit"), F.col("bytes")).otherwise(0)).alias("hit_bytes"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("bytes"))).alias("missed_bytes"))


def coverage_progress(done, total):
    """Percent between 0 and 100, 100 for nothing to do."""
    return F.when(total <= 0, 100).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.round(100 * done / total).cast("int"))))
