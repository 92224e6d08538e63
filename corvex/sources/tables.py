"""Adapters that present plain tables as the engine's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import local_index_id, shard_id, shard_year
from ..functions.dates import date_sort_value, resolve_date
from ..functions.text import canonical_title, normalize_text, summarize

ATTACHMENT = "array<struct<name:string,extension:string,section:string,url:string,parent_url:string>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in ("documents", "pages") else rows


def spread(rows: DataFrame) -> DataFrame:
    """Rows of texts dealt to all cores if the scan has fewer splits than cores: a small file is one row group,
    which one task would read. Tables of many files are left as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document relation over the table `documents`: its first line is the title, its language the facet,
    and dates follow from doc_id, so that every kind of date occurs. Its text is in NFKC already."""
    raw = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    day = lambda start, step, span: F.date_format(F.date_add(F.lit(start).cast("date"), (n * step % span).cast("int")), "yyyy-MM-dd")
    kind = F.when(n % 10 == 8, "attachment").when(n % 10 == 9, "external").otherwise("detail")
    return raw.select(
        n.alias("doc_index"), F.concat(F.lit("d"), n.cast("string")).alias("id"), F.col("source").alias("source_id"), F.col("lang").alias("facet"), kind.alias("record_type"),
        F.split("text", "\n")[0].alias("title"), F.col("text").alias("content"), F.concat(F.lit("sec"), (n % 13).cast("string")).alias("section"),
        F.array(F.lit("home"), F.concat(F.lit("sec"), (n % 13).cast("string"))).alias("nav_path"), F.array(F.col("lang"), F.concat(F.lit("tag"), (n % 5).cast("string"))).alias("tags"),
        F.concat(F.lit("http://"), F.col("source"), F.lit(".example.org/"), n.cast("string")).alias("url"), F.lit("broad_exploratory").alias("task_kind"), F.array().cast(ATTACHMENT).alias("attachments"),
        F.when(n % 7 != 0, day("2016-01-01", 37, 3650)).alias("published_at"), F.when(n % 11 == 0, day("2015-01-01", 53, 3650)).alias("version_date"), F.when(n % 14 == 0, day("2020-01-01", 29, 1500)).alias("recorded_at"),
    ).withColumn("nav_path_text", F.array_join("nav_path", " / "))


def with_scope(docs: DataFrame) -> DataFrame:
    """With year, shard_id and index_id."""
    out = docs.withColumn("year", shard_year(F.col("published_at"), F.col("version_date")))
    shard = shard_id(F.col("source_id"), F.col("facet"), F.col("record_type"), F.col("year"), F.col("nav_path")[0], F.col("id"), stable=True)
    return out.withColumns({"shard_id": shard, "index_id": local_index_id(F.col("source_id"), F.col("facet"), F.col("year"))})


def search_view(docs: DataFrame, stable: bool = True) -> DataFrame:
    """What ranking reads: normalized fields, dates in milliseconds, and the blob that phrases are looked up in."""
    norm = lambda c: normalize_text(c, stable)
    names = F.array_join(F.transform("attachments", lambda a: F.concat_ws(" ", a["name"], a["extension"], a["section"], a["parent_url"])), " ")
    out = docs.withColumn("summary", summarize(F.col("content"), F.col("title")))
    out = out.withColumns({
        "n_title": norm("title"), "n_canonical": norm(canonical_title("title")), "n_section": norm(F.concat_ws(" ", "section", "nav_path_text")), "n_summary": norm("summary"), "n_content": norm("content"),
        "n_tags": norm(F.array_join("tags", " ")), "n_url": norm("url"), "n_attachment": norm(names),
        "n_external": F.when(F.col("record_type") == "external", norm(F.concat_ws(" ", "title", "url", "summary"))).otherwise(""),
        "published_ms": date_sort_value("published_at"), "version_ms": date_sort_value("version_date"), "date_ms": date_sort_value(resolve_date(F.col("published_at"), F.col("version_date"), F.col("recorded_at"))["value"]),
    })
    return out.withColumn("blob", F.concat("n_title", "n_section", "n_summary", "n_content", "n_url", "n_attachment"))
