import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvex.functions import classify, dates, snippet, text
from corvex.plans import router


def one(spark, expr, value="x"):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("r")).first()["r"]


def test_clean_and_normalize(spark):
    assert one(spark, text.clean_text("v"), "  a　\xa0 b\n") == "a b"
    assert one(spark, text.clean_text("v"), None) == ""
    assert one(spark, text.normalize_text("v"), "Ａｂ Ｃ　１") == "abc1"


def test_slug_title_summary_host(spark):
    assert one(spark, text.stable_slug("v"), " Hello, World! ") == "hello-world"
    assert one(spark, text.stable_slug("v"), "!!!") == "unknown"
    assert one(spark, text.canonical_title("v"), "【通知】 - 校历 -") == "校历"
    assert one(spark, text.canonical_title("v"), "【通知】") == "【通知】"
    assert one(spark, text.summarize(F.lit("Title rest of it"), F.col("v")), "Title") == "rest of it"
    assert one(spark, text.doc_host("v"), "http://u@h.org:80/p?q") == "u@h.org:80"


def reference_tokens(value, n=3, cap=None):
    """Brute force of the documented token order and cap."""
    out = []

    def add(t):
        if t not in out:
            out.append(t)

    for run in router._RUN.findall("".join(unicodedata.normalize("NFKC", value).lower().split())):
        if run[0] >= "一":
            if len(run) <= 16:
                add(run)
            for size in range(2, n + 1):
                for i in range(len(run) - size + 1):
                    add(run[i : i + size])
                    if cap and len(out) >= cap:
                        return out
        else:
            add(run)
        if cap and len(out) >= cap:
            return out
    return out


def test_tokens(spark):
    cases = ["", "a", "附件1.xlsx 附件", "教务管理系统入口", "abc def-1 学生手册ab", "一二三四五六七八九十一二三四五六七八", "甲乙丙丁 甲乙 ab甲乙丙"]
    for cap in (None, 1, 2, 3, 5):
        rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string").select("i", text.tokens("v", 3, cap).alias("t")).collect()
        for r in rows:
            assert r["t"] == reference_tokens(cases[r["i"]], 3, cap), (cases[r["i"]], cap)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="甲乙丙ab1. ", max_size=24), min_size=1, max_size=30), st.integers(1, 8))
def test_tokens_any(spark, values, cap):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(values)], "i int, v string").select("i", text.tokens("v", 3, cap).alias("t")).collect()
    for r in rows:
        assert r["t"] == reference_tokens(values[r["i"]], 3, cap)


def test_fnv(spark):
    def brute(s, seed):
        h = (2166136261 ^ seed) & 0xFFFFFFFF
        for b in s.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    for s in ("", "a", "校历", "xlsx"):
        for seed in range(3):
            assert one(spark, text.fnv1a(F.col("v"), seed), s) == brute(s, seed)


def test_dates(spark):
    assert one(spark, dates.normalize_iso_date("v"), "2024-02-29T10:00:00Z") == "2024-02-29"
    assert one(spark, dates.normalize_iso_date("v"), "2023-02-29") is None
    assert one(spark, dates.infer_version_date("v"), "（2024年3月5日修订）") == "2024-03-05"
    assert one(spark, dates.infer_version_date("v"), "v20231301") is None
    assert one(spark, dates.infer_version_date("v", F.lit("2022-09-01")), "9.15 通知") == "2022-09-15"
    assert one(spark, dates.infer_academic_year("v"), "2023-2024学年") == "2023-2024"
    assert one(spark, dates.infer_academic_year("v"), "2023-2025") is None
    assert one(spark, dates.infer_term("v"), "第 二 学期") == "2"
    assert one(spark, dates.date_sort_value("v"), "bad") == 0
    assert one(spark, dates.format_search_date("v"), "2024-01-02T00:00") == "2024/01/02"


def test_exam_time(spark):
    r = one(spark, dates.exam_time("v"), "2024年1月5日(周五) 8:00-9:50")
    assert (r["date"], r["start_timestamp"], r["duration_minutes"], r["parse_error"]) == ("2024-01-05", "2024-01-05T08:00:00+08:00", 110, None)
    assert one(spark, dates.exam_time("v"), "(2024-1-5) 18:00~17:00")["duration_minutes"] == -60
    assert one(spark, dates.exam_time("v"), "")["parse_error"] == "Missing time data"
    assert one(spark, dates.exam_time("v"), "soon")["parse_error"] == "Unrecognized date format"
    assert one(spark, dates.exam_time("v"), "2024年13月5日 8:00-9:00")["parse_error"] == "Parsing exception"


def test_classification(spark):
    assert one(spark, classify.infer_facet(F.lit("detail"), F.col("v")), "考试与制度") == "exam"
    assert one(spark, classify.infer_facet(F.lit("external"), F.col("v"), F.lit("external_system")), "x") == "system"
    assert one(spark, classify.infer_task_kind(F.lit("xsc"), F.lit("news"), F.lit("detail"), F.col("v")), "奖学金") == "scholarship_aid"
    assert one(spark, classify.shard_year(F.lit(None).cast("string"), F.col("v")), "2021-09-01") == "2021"
    assert classify.detect_intent("双创 信息门户") == ("system_entry", ["cxcy"], "official_entry")
    assert classify.detect_intent("hello")[0] == "broad_exploratory"


def test_snippets():
    assert snippet.best_snippet({"content": "前文 " * 20 + "校历安排" + " 后文" * 80}, "校历", ["校历"])[0] == "content"
    assert snippet.highlights("ＡＢ ab", ["ab"]) == [(0, 2, "ab"), (3, 5, "ab")]
    assert snippet.plain_segments("xAbx", ["ab"]) == [("x", False), ("Ab", True), ("x", False)]
    assert snippet.best_snippet({"title": "t" * 200}, "zz", [])[2]
