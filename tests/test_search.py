import pytest
from pyspark.sql import functions as F

from corvex.operators import postings, shards
from corvex.plans import router, search
from corvex.sources.tables import ATTACHMENT, search_view, with_scope

NOW = 1_767_225_600_000
ROWS = [
    (0, "a-1", "jwc", "notice_article", "detail", "2025-2026学年校历", "校历正文 教学周历安排", "2025-09-01"),
    (1, "a-2", "jwc", "download", "detail", "附件1.xlsx 申请表", "表格下载 xlsxhttp", "2019-01-01"),
    (2, "a-3", "xsc", "policy", "detail", "奖学金管理办法", "资助 评奖评优", None),
    (3, "a-4", "jwc", "system", "external", "教务管理系统", "jwxt 入口", None),
]


@pytest.fixture(scope="module")
def view(spark):
    docs = spark.createDataFrame(ROWS, "doc_index long, id string, source_id string, facet string, record_type string, title string, content string, published_at string")
    null = F.lit(None).cast("string")
    docs = docs.withColumns({"version_date": null, "recorded_at": null, "section": F.lit("通知"), "nav_path": F.array(F.lit("通知")), "nav_path_text": F.lit("通知"), "tags": F.array(F.lit("t")), "url": F.concat(F.lit("http://h/"), "id"), "task_kind": F.lit("broad_exploratory"), "attachments": F.array().cast(ATTACHMENT), "summary": F.col("content")})
    return search_view(with_scope(docs), stable=False).cache()


def test_query_terms():
    assert router.expand_query("校历")[0] == "2025-2026学年校历"
    terms = router.query_terms("附件1", {})
    assert terms == ["附件1", "附件"]
    assert router.build_plan("B230112").route == "exam" and router.build_plan("x").route == "home"


def test_search_order_and_reason(view):
    top = search.search(view, None, "校历", NOW).collect()
    assert top[0]["id"] == "a-1" and "标题包含" in top[0]["score_reason"]
    assert search.search(view, None, "a", NOW).count() == 0
    assert search.search(view, None, "教务管理系统", NOW).first()["score_reason"].startswith("标题精确")


def test_filters(view):
    keep = lambda **f: {r["id"] for r in view.filter(router.Filters(**f).condition(NOW)).collect()}
    assert keep(source=" jwc ") == {"a-1", "a-2", "a-4"}
    assert keep(date_range="past_1y") == {"a-1"}
    assert keep(date_range="undated") == {"a-3", "a-4"}


def test_progressive_equals_exact(view):
    docs = view.withColumn("term", F.lit(""))
    light, body = postings.light_postings(docs), postings.body_postings(docs)
    events = list(search.progressive_search(view, light, body, "校历", NOW))
    assert [e.phase for e in events][0] == "plan_started" and events[-1].phase == "exhaustive_complete"
    assert events[-1].stats["complete"] and events[-1].stats["pending"] == 0
    want = [(r["id"], round(r["score"], 4)) for r in search.search(view, light.unionByName(body), "校历", NOW).collect()]
    got = [(r["id"], round(r["score"], 4)) for r in events[-1].results.collect()]
    assert got == want and got


def test_cancel(view):
    light = postings.light_postings(view)
    steps = search.progressive_search(view, light, light, "校历", NOW, cancelled=lambda: True)
    with pytest.raises(search.Cancelled):
        next(steps)


def test_safe_proof_never_rules_out_a_match(view):
    maps = shards.filter_bitmaps(shards.filter_bits(view))
    for phrase in ("xlsx", "校历", "++", "奖学金管理办法", "教学周历安排"):
        proved = {r["shard_id"] for r in shards.proved_empty(maps, [phrase]).collect()}
        held = {r["shard_id"] for r in view.filter(F.contains("blob", F.lit(phrase))).collect()}
        assert not proved & held
    assert shards.proved_empty(maps, ["不存在的"]).count() > 0


def test_packed_roundtrip(view):
    rows = postings.body_postings(view)
    back = postings.unpack(postings.pack(rows))
    assert rows.exceptAll(back).isEmpty() and back.exceptAll(rows).isEmpty()
    assert [postings.decode_varints(postings.encode_varint(n)) for n in (0, 127, 128, 1 << 40)] == [[0], [127], [128], [1 << 40]]


def test_budget_skips_but_goes_on():
    refs = [{"bytes": b} for b in (5, 9, 3, 1)]
    assert router.within_budget(refs, 9, 1) == [refs[0], refs[2], refs[3]]
    assert router.within_budget(refs, 1, 2) == refs[:2]


def test_chosen_indexes(spark):
    rows = [("a__en__2025", "a", "en", "2025", 30, 2048), ("a__en__2016", "a", "en", "2016", 30, 2048), ("b__en__2025", "b", "en", "2025", 30, 2048), ("b__fr__undated", "b", "fr", "undated", 6, 100)]
    indexes = spark.createDataFrame(rows, "index_id string, source_id string, facet string, year string, doc_count long, bytes long")
    plan = router.QueryPlan("q", ["q"], ["q", "r"], "broad_exploratory", ["b"], "balanced")
    free = {r["index_id"]: (r["position"], r["utility"]) for r in router.select_refs(indexes, plan, NOW).collect()}
    assert free == {"b__en__2025": (1, 5.0), "a__en__2025": (2, 2.5), "b__fr__undated": (3, 1.2), "a__en__2016": (4, 0.5)}
    routes = spark.createDataFrame([("r", ["a__en__2016"], ["a"], ["en"]), ("other", ["b__en__2025"], ["b"], ["fr"])], "term string, likely_local_index array<string>, likely_source array<string>, likely_facet array<string>")
    assert [(r["index_id"], r["turn"], r["utility"]) for r in router.select_refs(indexes, plan, NOW, routes).collect()] == [("a__en__2016", 1, 6.0)]
    assert router.select_refs(indexes.limit(0), plan, NOW, routes).count() == 0


def test_progressive_in_chosen_indexes(view):
    light, body = postings.light_postings(view), postings.body_postings(view)
    indexes = router.local_indexes(view)
    phases = {e.phase: e.results for e in search.progressive_search(view, light, body, "校历", NOW, indexes=indexes, batches=2)}
    assert phases["first_trusted_results"].first()["id"] == "a-1"
    assert [r["id"] for r in phases["exhaustive_complete"].collect()] == [r["id"] for r in search.search(view, light.unionByName(body), "校历", NOW).collect()]


def test_failed_shards_are_in_the_ledger(view):
    light, body = postings.light_postings(view), postings.body_postings(view)
    shards_of = view.select("shard_id", F.pmod(F.xxhash64("shard_id"), F.lit(2)).alias("b")).distinct().collect()
    bad = shards_of[0]["b"]
    broken = lambda rows, batch: rows.withColumn("title", F.raise_error(F.lit("lost")).cast("string")) if batch == bad else rows
    phrase = "通知"  # the section of every document
    events = list(search.progressive_search(view, light, body, phrase, NOW, batches=2, scan=broken))
    last = events[-1]
    assert not last.stats["complete"] and last.stats["failed"] == sum(r["b"] == bad for r in shards_of) and last.stats["pending"] == 0
    good = {r["shard_id"] for r in shards_of if r["b"] != bad}
    assert {r["shard_id"] for r in last.results.collect()} <= good
    assert any("failed_batch" in e.stats for e in events)
