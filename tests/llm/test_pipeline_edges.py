"""Every stage of the pipeline on nulls, repeated rows, clashing names and empty tables; what run() leaves behind."""

import shutil
from pathlib import Path
from urllib.parse import urlparse

import corpus_pipeline
from corvex.llm import mixing

GOOD = " ".join(f"word{i}" for i in range(30))
THIRD = " ".join(f"third{i * i}" for i in range(25))
SF = "/root/testdata/sf0.001"


def test_stages_on_odd_rows(spark):
    other = " ".join(f"other{i}" for i in range(40))
    rows = [(1, GOOD, None), (2, GOOD, "s"), (2, GOOD, "s"), (None, GOOD, "s"), (None, THIRD, None), (None, THIRD, None), (3, None, "s"), (4, "", "s"), (5, other + " mail a@b.org", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("host_bad", "kept_id", "bad_row", "pii_row", "row", "fp", "rejected_host"):
        docs = docs.selectExpr("*", f"'clash' AS {name}")
    none = docs.filter("false")
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs, none = stage(spark, docs, SF), stage(spark, none, SF)
        assert none.count() == 0 and docs.count() > 0
        if number < 4:
            assert docs.columns == none.columns and {"host_bad", "fp"} <= set(docs.columns)
        if number == 1:
            assert sorted(map(str, (r["doc_id"] for r in docs.collect()))) == ["1", "5", "None"]
        if number == 3:
            assert [r["text"][-7:] for r in docs.collect() if r["doc_id"] == 5] == ["<email>"]
    assert {"taken", "target"} <= set(docs.columns)


def test_run_leaves_its_result_only(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).columns
    rows = [r.asDict() for r in out.collect()]
    assert rows and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    (folder,) = {Path(urlparse(f).path).parents[1] for f in out.inputFiles()}
    assert [p.name for p in folder.iterdir()] == ["4"]
    shutil.rmtree(folder)
