"""Mixing sources to target weights; DataFrame functions only.

Targets: sources in code point order (null last) weigh 5, 2, 1, repeating; they share `share` times
the total size, and a source stops at `most` times its own size, the excess being shared again by
weight. That fixed point is min(cap, level x weight) with one water level for all sources, found from
running sums over the sources ordered by cap / weight.

Sampling: Efraimidis-Spirakis keys -ln(u) / quality, u from an MD5 of the document, smallest first.
A source is taken as often as its target holds it whole; the rest of the target is filled in key order,
and the document at the end of the budget is taken in part. The prefix sums of a source run over
fine bins of the keys, then within each bin, so no task holds a whole source. Bins are even for any
mix of qualities: a key's bin is its expected rank, the sum over the source's quality levels of
documents x (1 - exp(-key x quality)). Texts are read once; their figures are checkpointed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, n_words_of

SHARE, MOST, WEIGHTS = 1.5, 2.0, (5, 2, 1)
#: Documents a bin of keys holds on average.
BIN_ROWS = 2000
#: Quality levels that bins tell apart are multiples of 1 / LEVELS up to 1; the keys themselves are not rounded.
LEVELS = 20


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: src, source_size, n_docs, target. sizes has src and size. Sources without words get 0."""
    total = sizes.groupBy("src").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")).cast("double")
    caps = total.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    # Sources fill up in this order; the first one that its level leaves below the cap fixes the level of the rest.
    found = caps.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= F.col("cap"))
    fixed = F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("src").isNull(), F.col("src"), F.col("level").alias("level")))).over(everything)["level"]
    return found.select("src", "source_size", "n_docs", F.coalesce(F.least("cap", fixed * F.col("w")), F.col("cap")).alias("target"))


def quality_weight(text: Column) -> Column:
    """1 for clean prose, less for texts full of symbols, 0.05 at least."""
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    return F.greatest(F.lit(0.05), 1 - 4 * (F.length(text) - F.length(F.translate(text, "#*$%&|<>!", ""))) / size)


def sampling_key(doc_id: Column, text: Column, quality: Column) -> Column:
    digest = F.md5(F.concat_ws(":", doc_id.cast("string"), F.length(F.coalesce(text, F.lit(""))).cast("string")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def key_levels(rows: DataFrame) -> DataFrame:
    """One row per source: src and levels, its quality levels (LEVELS of them at most) with their documents."""
    level = F.greatest(F.least(F.round(F.col("q") * LEVELS), F.lit(float(LEVELS))), F.lit(1.0)) / LEVELS
    counts = rows.groupBy("src", level.alias("q")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return counts.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("q", "n"))).alias("levels"))


def expected_rank(key: Column, levels: Column) -> Column:
    """Documents of a source expected before a key; it grows with the key, so bins of it keep the order, and equal keys share a bin."""
    return F.aggregate(levels, F.lit(0.0), lambda a, x: a + x["n"] * (1 - F.exp(-key * x["q"])))


def mix(docs: DataFrame, text: str = "text", source: str = "source", quality: Column | None = None, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of docs.

    Null texts have size 0 and take 0; null sources form one source, last in order; equal keys (repeated
    rows) are ordered by size, and rows equal in that too share the budget in either order with the same
    set of results. A given quality that is null, zero or less counts as 1e-6. An empty table gives no
    rows. Extra columns are ignored.
    """
    worth = quality_weight(F.col(text)) if quality is None else F.greatest(quality.cast("double"), F.lit(1e-6))
    rows = docs.select("doc_id", F.col(source).alias("src"), n_words_of(F.col(text)).alias("size"), worth.alias("q"), sampling_key(F.col("doc_id"), F.col(text), worth).alias("k"))
    rows = checkpointed(rows)
    plan = targets(rows, share, most, weights).withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(int(most)))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    levels = key_levels(rows).withColumnRenamed("src", "level_src")
    plan = plan.join(levels, F.col("src").eqNullSafe(F.col("level_src"))).drop("level_src")
    both = rows.join(plan.withColumnRenamed("src", "plan_src"), F.col("src").eqNullSafe(F.col("plan_src")))
    both = both.withColumn("bin", F.floor(expected_rank(F.col("k"), F.col("levels")) / BIN_ROWS).cast("long")).drop("levels")
    bins = both.groupBy("src", "bin").agg(F.sum("size").alias("in_bin"))
    ahead = F.sum("in_bin").over(Window.partitionBy("src").orderBy("bin")) - F.col("in_bin")
    bins = bins.select(F.col("src").alias("bin_src"), F.col("bin").alias("bin_no"), ahead.alias("ahead"))
    both = both.join(bins, F.col("src").eqNullSafe(F.col("bin_src")) & (F.col("bin") == F.col("bin_no")))
    inside = F.sum("size").over(Window.partitionBy("src", "bin").orderBy("k", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    part = F.least(F.greatest(F.col("rest") - F.col("ahead") - inside, F.lit(0)), F.col("size"))
    return both.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


#: The same in DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln(((('0x' || substr(md5(concat_ws(':', doc_id::VARCHAR, length(coalesce(text, ''))::VARCHAR)), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
           / greatest(0.05, 1 - 4 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '#*$%&|<>!', ''))) / greatest(length(coalesce(text, '')), 1)::DOUBLE) AS k
  FROM documents
), s AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w, 2.0 * source_size AS cap FROM s),
r AS (SELECT *, sum(cap) OVER (ORDER BY cap / w, src NULLS LAST) - cap AS c0, sum(w) OVER (ORDER BY cap / w, src NULLS LAST) - w AS w0 FROM w),
l AS (SELECT *, (1.5 * (SELECT sum(source_size) FROM s) - c0) / ((SELECT sum(w) FROM w) - w0) AS level FROM r),
f AS (SELECT level FROM l WHERE level * w <= cap ORDER BY cap / w, src NULLS LAST LIMIT 1),
t AS (SELECT src, source_size, least(cap, coalesce((SELECT level FROM f) * w, cap)) AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS rest,
             sum(d.size) OVER (PARTITION BY d.src ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS ahead
      FROM d JOIN e ON d.src IS NOT DISTINCT FROM e.src)
SELECT doc_id, size, source_size, target, (epochs * size + least(greatest(rest - ahead, 0), size))::BIGINT AS taken FROM p
"""
