"""Sources and sinks: JSON packages, tables of exams, pages, content-addressed and idempotent writes."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.constants import EXAM_HEADERS

#: Files of a source package, and their rows' schemas.
SCHEMAS = {
    "sections": "section_id string, name string, url string, section_type string, nav_path array<string>, business_tags array<string>",
    "list_pages": "url string, section_id string",
    "detail_pages": "page_id string, url string, section_id string, title string, content_text string, published_at string, updated_at string, publisher string, page_type string, headings array<string>, content_hash string, content_status string",
    "attachments": "attachment_id string, name string, url string, extension string, parent_url string, position int",
    "external_links": "external_id string, label string, url string, category string, source_url string, source_section_id string, recorded_at string",
    "edges": "edge_id string, anchor_text string, from_url string, to_url string",
}
REQUIRED = ("manifest.json", "site.json", *(f"{n}.jsonl" for n in SCHEMAS))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects by line; blank lines are skipped, anything else that is no object fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def bad_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and text of lines that are neither blank nor an object, for messages."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.trim("value").alias("text"))
    return lines.filter((F.col("text") != "") & (F.try_parse_json("text").isNull() | ~F.startswith("text", F.lit("{"))))


def resolve_packages(config: dict, base: str, environment: str = "PACKAGE_DIRS") -> list[str]:
    """Package folders of a collection's config, or those that the environment names instead."""
    own = os.environ.get(environment)
    listed = own.split(os.pathsep) if own else [p["path"] if isinstance(p, dict) else p for p in config["packages"]]
    return [p if "://" in p or os.path.isabs(p) else os.path.normpath(os.path.join(base, p)) for p in listed]


def with_order(rows: DataFrame) -> DataFrame:
    """An ordinal that follows file order: ids of partitions and rows of one file read grow together."""
    return rows.withColumn("ordinal", F.monotonically_increasing_id())


def read_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The relations of one package, each with an ordinal."""
    out = {n: with_order(read_jsonl(spark, f"{path}/{n}.jsonl", s)) for n, s in SCHEMAS.items()}
    return out | {"manifest": read_json(spark, f"{path}/manifest.json"), "site": read_json(spark, f"{path}/site.json", "site_id string, name string, domain string, base_url string")}


def missing_files(spark: SparkSession, present: DataFrame, required=REQUIRED) -> DataFrame:
    return spark.createDataFrame([(n,) for n in required], "name string").join(present, "name", "left_anti")


def unknown_outcomes(outcomes: DataFrame) -> DataFrame:
    """url and outcome of rows whose outcome holds `unknown`."""
    return outcomes.filter(F.contains(F.lower("outcome"), F.lit("unknown")))


def match_allowlist(urls: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Urls with the first rule (by rule_no) whose pattern they match (null: unexpected), and stale rules that match none. Rules are few and broadcast."""
    hit = urls.join(F.broadcast(rules), F.expr("url rlike pattern"), "left")
    first = hit.groupBy("url").agg(F.min("rule_no").alias("rule_no"))
    return first, rules.join(first.select("rule_no").distinct(), "rule_no", "left_anti")


def manifest_faults(manifest: DataFrame) -> DataFrame:
    """rule of every quality gate that a manifest's `quality` fails."""
    q = F.col("quality")
    rules = F.array_compact(F.array(F.when(q["errors"] != 0, "errors"), F.when(~q["all_discovered_urls_have_outcomes"], "outcomes"), F.when(q["attachment_policy"] != "metadata_only", "attachment_policy"), F.when(q["external_link_policy"] != "record_only", "external_link_policy")))
    return manifest.select(F.explode(rules).alias("rule"))


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """name, expected and actual counts that differ or are on one side only."""
    both = expected.join(actual, "name", "full_outer")
    return both.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def read_exam_tables(spark: SparkSession, folder: str, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """All spreadsheets (or CSV files) of a folder as text rows with source_file and row_index, files in name order.

    Each file's columns are mapped by its own first existing header. Spreadsheets need openpyxl, which is
    looked for only when there are any; the files of one folder are small.
    """
    import pandas as pd

    headers = EXAM_HEADERS if headers is None else headers
    rows = []
    for path in sorted(p for p in Path(folder).iterdir() if p.suffix in (".xlsx", ".csv")):
        frame = pd.read_excel(path, dtype=str) if path.suffix == ".xlsx" else pd.read_csv(path, dtype=str)
        found = {f: next((h for h in names if h in frame.columns), None) for f, names in headers.items()}
        for number, row in enumerate(frame.to_dict("records"), 2):
            values = [None if h is None or pd.isna(row[h]) else str(row[h]) for h in found.values()]
            rows.append((*values, path.name, number))
    return spark.createDataFrame(rows, ", ".join([*(f"`{f}` string" for f in headers), "source_file string", "row_index int"]))


def html_links(html: Column) -> Column:
    """Struct of href and text of every anchor in order."""
    anchors = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[^>]*>.*?</a>"), F.lit(0))
    text = lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, "(?s)<[^>]*>", " "), r"\s+", " "))
    return F.transform(anchors, lambda a: F.struct(F.regexp_extract(a, r"(?is)href=[\"']?([^\"'\s>]+)", 1).alias("href"), text(a).alias("text")))


def spreadsheet_links(html: Column) -> Column:
    """Anchors to .xls or .xlsx files, with a name that is safe in a file system."""
    sheets = F.filter(html_links(html), lambda a: F.lower(a["href"]).rlike(r"\.xlsx?$"))
    return F.transform(sheets, lambda a: F.struct(a["href"].alias("href"), F.regexp_replace(a["text"], r'[\\/:*?"<>|\s]+', "_").alias("name")))


def notice_title(title: Column, required: list[str], targets: list[str], excluded: list[str]) -> Column:
    """No excluded word, all required ones, any target."""
    out = F.lit(True)
    for w in excluded:
        out = out & ~F.contains(title, F.lit(w))
    for w in required:
        out = out & F.contains(title, F.lit(w))
    any_of = F.lit(False)
    for w in targets:
        any_of = any_of | F.contains(title, F.lit(w))
    return out & any_of


def first_notice(items: DataFrame, accepted: Column) -> DataFrame:
    """The first accepted row in order of ordinal."""
    return items.filter(accepted).agg(F.min_by(F.struct(*items.columns), "ordinal").alias("r")).filter("r is not null").select("r.*")


def preferred_files(files: DataFrame, student: Column, teacher: Column) -> DataFrame:
    """Students' files of each page if it has any, else all but teachers' files."""
    some = F.max(student.cast("int")).over(Window.partitionBy("page_id")) == 1
    return files.withColumn("keep", F.when(some, student).otherwise(~teacher)).filter("keep").drop("keep")


def content_hashes(rows: DataFrame, key: str) -> DataFrame:
    """key and the sha256 of each row's JSON, columns in name order."""
    return rows.select(key, F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns)))), 256).alias("sha256"))


def table_hash(rows: DataFrame) -> str:
    """One hash of a table's rows that their order does not change: sums of the digests' four words."""
    digest = F.sha2(F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns)))), 256)
    words = [F.sum(F.conv(F.substring(digest, 16 * i + 1, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return rows.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *words), 256).alias("h")).first()["h"]


def write_hashed(rows: DataFrame, folder: str, logical: str) -> dict:
    """Write to logical.<16 hex digits of the content's hash>; a folder of that name holds the same rows already."""
    digest = table_hash(rows)
    path = f"{folder}/{logical}.{digest[:16]}"
    rows.write.mode("overwrite").parquet(path)
    return {"path": path, "sha256": digest, "role": logical, "count": rows.count()}


def write_json(rows: DataFrame, path: str, compact: bool = True) -> None:
    """Rows as JSON objects with their nulls: one a line, or indented and followed by a line end if not compact."""
    options = {"ignoreNullFields": "false", "pretty": str(not compact).lower()}
    rows.select(F.to_json(F.struct("*"), options).alias("value")).write.mode("overwrite").text(path)


def artifacts(spark: SparkSession, entries: list[dict], load: str = "on_demand") -> DataFrame:
    return spark.createDataFrame([(e["path"], e["sha256"], e["role"], load, e["count"]) for e in entries], "path string, sha256 string, role string, load string, count long")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.columns == b.columns and table_hash(a) == table_hash(b)


def write_if_changed(rows: DataFrame, path: str) -> bool:
    """Overwrite path unless it holds the same rows; whether it was written."""
    spark = rows.sparkSession
    try:
        old = spark.read.parquet(path)
        if same_rows(old, rows):
            return False
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
    rows.write.mode("overwrite").parquet(path)
    return True


def changed_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """name of files that are new or whose md5 differs; both have name and content."""
    digest = lambda d: d.select("name", F.md5("content").alias("md5"))
    return digest(new).join(digest(old), ["name", "md5"], "left_anti").select("name")


def read_expectations(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as file:
        return json.load(file)["expectations"]
