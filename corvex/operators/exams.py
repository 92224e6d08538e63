"""Exam records: header mapping, parsing, profiles, class lookup, calendars, manifest."""

from __future__ import annotations

from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import CLASS_LOOKUP, COMPLETE_CLASS, EXAM_HEADERS, EXAM_HELPER
from ..functions.dates import exam_time
from ..functions.text import exam_count, exam_text


def map_headers(rows: DataFrame, headers: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns by their first existing header; missing ones are empty. Other columns stay."""
    headers = EXAM_HEADERS if headers is None else headers
    found = {f: next((h for h in [*names, f] if h in rows.columns), None) for f, names in headers.items()}
    taken = {h for h in found.values() if h}
    keep = [c for c in rows.columns if c not in taken and c not in found]
    return rows.select(*keep, *(F.col(f"`{h}`").cast("string").alias(f) if h else F.lit("").alias(f) for f, h in found.items()))


def parse(rows: DataFrame) -> DataFrame:
    """Records from mapped rows with source_file and row_index (2 for the first row of a file)."""
    texts = [f for f in EXAM_HEADERS if f != "count"]
    clean = rows.select("source_file", "row_index", *(exam_text(f).alias(f) for f in texts), exam_count("count").alias("count"))
    timed = clean.withColumn("t", exam_time("raw_time"))
    return timed.select(F.concat_ws("-", "source_file", F.col("row_index").cast("string")).alias("id"), *clean.columns, "t.start_timestamp", "t.end_timestamp", "t.duration_minutes", "t.date", "t.parse_error")


def profile(rows: DataFrame, columns: list[str], samples: int = 3) -> DataFrame:
    """One row per column: non-null, null, share, distinct values and the first samples, in one pass; rows has row_index."""
    long = rows.select("row_index", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("row_index", "x.*")
    values = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_index").alias("first"))
    order = Window.partitionBy("column").orderBy(F.col("value").isNull(), "first")
    ranked = values.withColumn("rank", F.row_number().over(order))
    present = F.col("value").isNotNull()
    out = ranked.groupBy("column").agg(
        F.sum(F.when(present, F.col("n")).otherwise(0)).alias("non_null"), F.sum(F.when(present, 0).otherwise(F.col("n"))).alias("nulls"), F.count_if(present).alias("unique"),
        F.array_sort(F.collect_list(F.when(present & (F.col("rank") <= samples), F.struct("rank", "value")))).alias("s"),
    )
    return out.select("column", "non_null", "nulls", F.round(100 * F.col("non_null") / (F.col("non_null") + F.col("nulls")), 2).alias("pct"), "unique", F.array_join(F.transform("s", lambda x: x["value"]), " | ").alias("samples"))


def distribution(exams: DataFrame) -> DataFrame:
    """Per file: records, dates, distinct classes and courses, mean positive duration, parse results."""
    return exams.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("records"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.countDistinct("class_name").alias("classes"), F.countDistinct("course_name").alias("courses"),
        F.round(F.avg(F.when(F.col("duration_minutes") > 0, F.col("duration_minutes"))), 4).alias("mean_minutes"), F.count_if(F.col("parse_error").isNull()).alias("parsed"), F.count_if(F.col("parse_error").isNotNull()).alias("failed"),
    )


def roll_up(files: DataFrame) -> DataFrame:
    """Over files: distinct counts are added up, dates span the files' ends."""
    return files.agg(F.sum("records").alias("records"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.sum("classes").alias("classes"), F.sum("courses").alias("courses"), F.sum("parsed").alias("parsed"), F.sum("failed").alias("failed"))


def campus_counts(exams: DataFrame) -> DataFrame:
    return exams.groupBy("campus").agg(F.count(F.lit(1)).alias("n"))


def query_route(query: Column) -> Column:
    text = F.upper(F.trim(query))
    return F.when(F.length(F.trim(query)) < 2, "home").when(text.rlike(CLASS_LOOKUP) | (F.trim(query) == EXAM_HELPER), "exam").otherwise("collection")


def is_complete_class(query: Column) -> Column:
    return F.upper(F.trim(query)).rlike(COMPLETE_CLASS)


def class_search(exams: DataFrame, value: str, selected: str | None = None, complete_only: bool = False) -> tuple[str, DataFrame, DataFrame]:
    """mode (EMPTY, NOT_FOUND, LIST, DETAIL), classes and exams. complete_only: DETAIL needs a complete class name."""
    import re

    none = exams.filter(F.lit(False))
    text = value.strip()
    if len(text) < 2:
        return "EMPTY", none.select("class_name"), none
    if selected:
        rows = exams.filter(F.col("class_name") == selected)
        return ("NOT_FOUND" if rows.isEmpty() else "DETAIL"), rows.select("class_name").distinct(), rows
    rows = exams.filter(F.contains(F.upper("class_name"), F.lit(text.upper())))
    classes = rows.select("class_name").distinct().orderBy("class_name")
    n = len(classes.limit(2).collect())
    if n == 0:
        return "NOT_FOUND", classes, none
    if n == 1 and (not complete_only or re.match(COMPLETE_CLASS, text.upper())):
        return "DETAIL", classes, rows
    return "LIST", classes, none


def class_modes(exams: DataFrame, queries: DataFrame) -> DataFrame:
    """query, mode and number of classes for many queries at once; queries are broadcast, so keep them few."""
    hits = queries.join(F.broadcast(exams.select("class_name").distinct()), F.contains(F.upper("class_name"), F.upper(F.trim("query"))), "left")
    n = F.countDistinct("class_name")
    short = F.length(F.trim("query")) < 2
    return hits.groupBy("query").agg(n.alias("n")).select("query", F.when(short, "EMPTY").when(F.col("n") == 0, "NOT_FOUND").when(F.col("n") == 1, "DETAIL").otherwise("LIST").alias("mode"), F.when(short, 0).otherwise(F.col("n")).cast("long").alias("n_classes"))


def toggled(exams: DataFrame, deselected: DataFrame) -> DataFrame:
    """All exams are selected at first; deselected has the ids taken out."""
    return exams.join(deselected, "id", "left_anti")


def by_start(exams: DataFrame) -> DataFrame:
    return exams.orderBy(F.col("start_timestamp").asc_nulls_last(), "id")


def ics_stamp(iso: Column) -> Column:
    """Without zone, separators and fractions."""
    return F.split(F.translate(F.regexp_replace(iso, r"[+-]\d{2}:\d{2}$|Z$", ""), "-:", ""), r"\.")[0]


def ics_escape(text: Column) -> Column:
    out = text
    for a, b in (("\\", "\\\\"), (",", "\\,"), (";", "\\;"), ("\r\n", "\\n"), ("\r", "\\n"), ("\n", "\\n")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold(line: str, first: int = 75, rest: int = 74) -> str:
    """Lines of 75 bytes at most, then 74, never inside a character."""
    parts, now, size = [], "", 0
    for char in line:
        n = len(char.encode())
        if size + n > (rest if parts else first):
            parts.append(now)
            now, size = "", 0
        now, size = now + char, size + n
    return "\r\n ".join([*parts, now] if now or not parts else parts)


def ics_events(exams: DataFrame, stamp: str, reminders: list[int], domain: str, generator: str = "") -> DataFrame:
    """id, start and the lines of one event for every exam with a start and an end."""
    c = F.col

    @F.pandas_udf("string")
    def safe(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: quote(i, safe="!'()*-._~").replace("%", "_")).astype(object)

    @F.pandas_udf("string")
    def folded(text: pd.Series) -> pd.Series:
        return text.map(lambda t: "\r\n".join(map(fold, t.split("\r\n")))).astype(object)

    filled = lambda x, alt: F.when(x == "", alt).otherwise(x)
    about = F.concat_ws(
        "\n", F.concat(F.lit("课程代码: "), filled(c("course_code"), "-")), F.concat(F.lit("教师: "), filled(c("teacher"), "未知")), F.concat(F.lit("班级: "), c("class_name")),
        F.concat(F.lit("人数: "), c("count").cast("string")), F.when(c("notes") != "", F.concat(F.lit("备注: "), c("notes"))), F.lit(generator or None).cast("string"),
    )
    place = F.concat(F.when(c("campus") != "", F.concat(F.lit("["), c("campus"), F.lit("] "))).otherwise(""), c("location"))
    alarms = [x for m in reminders for x in ("BEGIN:VALARM", "ACTION:DISPLAY", "DESCRIPTION:Exam Reminder", f"TRIGGER:-PT{m}M", "END:VALARM")]
    lines = F.concat_ws(
        "\r\n", F.lit("BEGIN:VEVENT"), F.concat(F.lit("UID:exam-"), safe("id"), F.lit(f"@{domain}")), F.lit(f"DTSTAMP:{stamp}"),
        F.concat(F.lit("DTSTART;TZID=Asia/Shanghai:"), ics_stamp(c("start_timestamp"))), F.concat(F.lit("DTEND;TZID=Asia/Shanghai:"), ics_stamp(c("end_timestamp"))),
        F.concat(F.lit("SUMMARY:"), ics_escape(F.concat(F.lit("考试: "), c("course_name")))), F.concat(F.lit("LOCATION:"), ics_escape(place)), F.concat(F.lit("DESCRIPTION:"), ics_escape(about)),
        F.lit("STATUS:CONFIRMED"), *map(F.lit, alarms), F.lit("END:VEVENT"),
    )
    ready = exams.filter("start_timestamp is not null and end_timestamp is not null")
    return ready.select("id", "start_timestamp", folded(lines).alias("event"))


def calendar(exams: DataFrame, class_name: str, stamp: str, reminders: list[int], domain: str = "example.org", app: str = "corvex", prefix: str = "考试-") -> str:
    """One class's calendar as text; a class's exams are few, so they are collected in order."""
    events = [r["event"] for r in ics_events(exams, stamp, reminders, domain).orderBy("start_timestamp", "id").collect()]
    if not events:
        raise ValueError("no exams with a time")
    head = ["BEGIN:VCALENDAR", "VERSION:2.0", f"PRODID:-//{domain}//{app}//CN", f"X-WR-CALNAME:{prefix}{class_name}", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", "BEGIN:VTIMEZONE", "TZID:Asia/Shanghai", "X-LIC-LOCATION:Asia/Shanghai", "BEGIN:STANDARD", "TZOFFSETFROM:+0800", "TZOFFSETTO:+0800", "TZNAME:CST", "DTSTART:19700101T000000", "END:STANDARD", "END:VTIMEZONE"]
    return "\r\n".join([*map(fold, head), *events, "END:VCALENDAR"])


def calendar_name(class_name: Column) -> Column:
    return F.concat(class_name, F.lit(".ics"))


def manifest(exams: DataFrame, generated_at: str) -> DataFrame:
    return exams.agg(F.lit(generated_at).alias("generated_at"), F.array_sort(F.collect_set("source_file")).alias("files_processed"), F.count(F.lit(1)).alias("total_records"))


def violations(exams: DataFrame) -> DataFrame:
    """id and rule: repeated ids, durations that are not positive, times without their pair or unreadable."""
    ids = exams.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", F.lit("duplicate_id").alias("rule"))
    readable = lambda c: F.try_to_timestamp(F.col(c)).isNotNull()
    pair = F.col("start_timestamp").isNull() != F.col("end_timestamp").isNull()
    bad = F.col("start_timestamp").isNotNull() & F.col("end_timestamp").isNotNull() & ~(readable("start_timestamp") & readable("end_timestamp"))
    rules = F.array_compact(F.array(F.when(F.col("duration_minutes") <= 0, "duration"), F.when(pair, "unpaired"), F.when(bad, "unreadable")))
    return ids.unionByName(exams.select("id", F.explode(rules).alias("rule")))


def inventory_report(files: DataFrame, columns: DataFrame) -> str:
    """Markdown over small aggregates."""
    total = roll_up(files).first()
    out = ["# Exam data", "", f"{total['records']} records, {total['parsed']} parsed, {total['failed']} failed; {total['first_date']} to {total['last_date']}.", "", "| file | records | classes | courses | mean minutes |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {r['source_file']} | {r['records']} | {r['classes']} | {r['courses']} | {r['mean_minutes']} |" for r in files.orderBy("source_file").collect()]
    out += ["", "| column | non-null | share | distinct | samples |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {r['column']} | {r['non_null']} | {r['pct']} | {r['unique']} | {r['samples']} |" for r in columns.orderBy("column").collect()]
    return "\n".join(out)
