import json

import pytest
from pyspark.sql import functions as F

from corvex.operators import aggregates, documents, exams, quality
from corvex.sources import readers

PACKAGE = {
    "sections": [{"section_id": "s1", "name": "通知公告", "nav_path": ["首页", "通知公告"]}, {"section_id": "s1", "name": "通知", "nav_path": []}],
    "list_pages": [{"url": "http://h/list", "section_id": "s1"}],
    "detail_pages": [{"page_id": "p1", "url": "http://h/1", "section_id": "s1", "title": "期末考试安排", "content_text": "期末考试安排 时间地点", "published_at": "2024-01-05", "headings": ["h"]}, {"page_id": "p2", "url": "http://h/2", "title": "", "content_text": ""}],
    "attachments": [{"attachment_id": "a1", "name": "附件1", "url": "http://h/a.xlsx", "extension": "xlsx", "parent_url": "http://h/1"}, {"attachment_id": "a2", "name": "表20230401", "url": "http://h/b.xlsx", "extension": "xlsx", "parent_url": "http://h/list"}],
    "external_links": [{"external_id": "e1", "label": "教务系统", "url": "http://x/y", "category": "external_system_link", "source_section_id": "s9", "recorded_at": "2024-01-01T00:00:00Z"}],
    "edges": [{"edge_id": "g1", "anchor_text": "考试信息查询", "from_url": "http://h", "to_url": "http://q"}, {"edge_id": "g2", "anchor_text": "other", "from_url": "", "to_url": ""}],
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("package")
    for name, rows in PACKAGE.items():
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(r, ensure_ascii=False) + "\n\n" for r in rows))
    (folder / "manifest.json").write_text('{"quality": {"errors": 0}}')
    (folder / "site.json").write_text('{"site_id": "jwc", "name": "教务处"}')
    package = readers.read_package(spark, str(folder))
    return documents.merge_packages([documents.build_documents(package, "jwc", "教务处")]).cache()


def test_four_kinds(built):
    rows = {r["id"]: r for r in built.collect()}
    assert [rows[i]["doc_index"] for i in ("jwc-detail-p1", "jwc-detail-p2", "jwc-attachment-a2", "jwc-external-e1", "jwc-utility-g1")] == [0, 1, 2, 3, 4]
    p1 = rows["jwc-detail-p1"]
    assert (p1["facet"], p1["section"], p1["date_kind"], p1["attachment_count"], p1["task_kind"]) == ("exam", "通知", "published", 1, "exam_schedule")
    assert p1["summary"] == "时间地点" and p1["tags"][0] == "h"
    assert rows["jwc-detail-p2"]["title"] == "http://h/2" and rows["jwc-detail-p2"]["section"] == "首页"
    assert rows["jwc-attachment-a2"]["version_date"] == "2023-04-01" and rows["jwc-attachment-a2"]["section"] == "通知"
    e1 = rows["jwc-external-e1"]
    assert e1["facet"] == "system" and e1["date_kind"] == "recorded" and e1["published_at"] is None


def test_checks(spark, built):
    assert quality.document_faults(built).isEmpty()
    assert documents.local_metadata(built).columns.count("content") == 0
    assert quality.forbidden_columns(documents.local_metadata(built)) == []
    assert quality.unreachable(["期末考试", "没有这个"], built.withColumn("blob", F.col("title"))) == ["没有这个"]
    ranked = built.withColumn("rank", F.col("doc_index") + 1)
    assert quality.judge(ranked, {"top1": {"title_contains": "期末"}, "forbid_top_n": [{"facet": "news"}]})
    assert not quality.judge(ranked, {"top1": {"facet": "news"}})
    assert quality.obsolete_keys(built.schema, {"url"}) == ["$.url", "$.attachments.url", "$.attachments.parent_url"][:2]


def test_sinks(spark, built, tmp_path):
    path = str(tmp_path / "t")
    assert readers.write_if_changed(built.select("id", "title"), path)
    assert not readers.write_if_changed(built.select("id", "title").orderBy(F.desc("id")), path)
    one = readers.write_hashed(built.select("id"), str(tmp_path), "ids")
    assert one["count"] == 5 and quality.hashed_path is not None and one["path"].endswith(one["sha256"][:16])


def test_bad_lines_fail(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"url": "a"}\nnot json\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "url string").collect()
    assert readers.bad_lines(spark, str(tmp_path / "x.jsonl")).count() == 1


def test_allowlist(spark):
    urls = spark.createDataFrame([("http://a/1",), ("http://b/2",)], "url string")
    rules = spark.createDataFrame([(1, "http://a/"), (2, "/1$"), (3, "zz")], "rule_no int, pattern string")
    first, stale = readers.match_allowlist(urls, rules)
    assert {r["url"]: r["rule_no"] for r in first.collect()} == {"http://a/1": 1, "http://b/2": None}
    assert {r["rule_no"] for r in stale.collect()} == {2, 3}


def test_pages(spark):
    row = spark.createDataFrame([('<a href="/x.xlsx">学生 表</a><a class=c href=/y>y</a>',)], "h string").select(readers.spreadsheet_links(F.col("h")).alias("s"), readers.html_links(F.col("h")).alias("l")).first()
    assert [tuple(x) for x in row["s"]] == [("/x.xlsx", "学生_表")] and len(row["l"]) == 2


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("exams")
    (folder / "b.csv").write_text("班级,课程名称,考试时间,人数,备注\nB230101,数学,2024年1月5日 8:00-9:50,30,\nb230102,英语,待定,x,带笔\n")
    (folder / "a.csv").write_text("班级名称,课程,时间,人数\nB230101,物理,(2024-01-03) 10:00~12:00,31\n")
    return exams.parse(exams.map_headers(readers.read_exam_tables(spark, str(folder)))).cache()


def test_exams(records):
    rows = {r["id"]: r for r in records.collect()}
    assert set(rows) == {"a.csv-2", "b.csv-2", "b.csv-3"}
    assert rows["b.csv-2"]["class_name"] == "B230101" and rows["b.csv-2"]["duration_minutes"] == 110 and rows["b.csv-3"]["count"] == 0
    mode, classes, found = exams.class_search(records, "b2301")
    assert mode == "LIST" and classes.count() == 2
    assert exams.class_search(records, "B230101")[0] == "DETAIL" and exams.class_search(records, "zz")[0] == "NOT_FOUND" and exams.class_search(records, "b")[0] == "EMPTY"
    assert exams.class_search(records, "0101", complete_only=True)[0] == "LIST"
    assert {r["rule"] for r in exams.violations(records).collect()} == {"duration"}
    assert exams.roll_up(exams.distribution(records)).first()["records"] == 3
    text = exams.inventory_report(exams.distribution(records), exams.profile(records, ["class_name"]))
    assert "3 records" in text


def test_calendar(records):
    out = exams.calendar(records.filter("class_name = 'B230101'"), "B230101", "20240101T000000Z", [30])
    lines = out.split("\r\n")
    assert lines[0] == "BEGIN:VCALENDAR" and lines[-1] == "END:VCALENDAR" and lines.count("BEGIN:VEVENT") == 2
    assert "DTSTART;TZID=Asia/Shanghai:20240103T100000" in lines and "TRIGGER:-PT30M" in lines
    assert all(len(x.encode()) <= 75 for x in lines)
    assert exams.fold("考" * 60).replace("\r\n ", "") == "考" * 60


def test_reports(spark):
    a = spark.createDataFrame([("m", 2.0), ("n", 1.0)], "metric string, value double")
    b = spark.createDataFrame([("m", 1.0)], "metric string, value double")
    assert {r["metric"]: r["change_pct"] for r in aggregates.compare_metrics(a, b).collect()} == {"m": 100.0, "n": None}
    assert quality.set_difference(a, a).isEmpty()


def test_stream(spark, tmp_path):
    from corvex.streaming import incremental

    spark.createDataFrame([(1, "alpha beta"), (2, "校历")], "doc_index long, content string").write.parquet(str(tmp_path / "in"))
    docs = incremental.document_stream(spark, str(tmp_path / "in"), "doc_index long, content string")
    incremental.upsert_postings(docs, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert {r["term"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"alphabeta", "校历"}
