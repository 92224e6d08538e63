import json

from corvex.operators import aggregates, documents
from corvex.plans import router
from corvex.sources import readers


def test_truth_counts(spark):
    rows = spark.createDataFrame([(2, None), (None, 3), (5, None)], "sections int, edges int")
    got = aggregates.truth_counts(rows).first().asDict()
    assert len(got) == 10 and {k: v for k, v in got.items() if v} == {"sections": 7, "edges": 3}
    assert set(aggregates.truth_counts(rows.limit(0)).first().asDict().values()) == {0}


def test_coverage_roll_up(spark):
    ledger = spark.createDataFrame([("scanned", 3, 30), ("scanned", 1, 10), ("proved_no_match", 5, 50), ("failed", 7, 70), ("out_of_scope", 9, 90)], "state string, document_count long, bytes long")
    artifacts = spark.createDataFrame([("first_screen", 1), ("local_index", 2), ("local_index", 4), ("filter", 8)], "role string, bytes long")
    got = aggregates.coverage_roll_up(ledger, artifacts).first()
    assert (got.scanned_shards, got.proved_no_match_shards, got.failed_shards, got.total_shards, got.searched_documents, got.total_documents) == (2, 1, 1, 5, 9, 25)
    assert (got.hydrated_shard_bytes, got.local_index_bytes, got.loaded_bytes, got.exhaustive_complete) == (40, 6, 55, False)
    none = aggregates.coverage_roll_up(ledger.limit(0), artifacts.limit(0)).first()
    assert none.loaded_bytes == 0 and none.exhaustive_complete


def test_source_manifests(spark):
    docs = spark.createDataFrame([("a", "s1", "xy"), ("a", "s2", "é"), ("a", "s1", None), ("c", "s3", "z")], "source_id string, shard_id string, content string")
    files = spark.createDataFrame([("a",), ("b",), ("b",)], "source_id string")
    sources = spark.createDataFrame([("a",), ("b",), ("b",)], "source_id string")
    got = {r.source_id: tuple(r)[1:] for r in documents.source_manifests(sources, docs, files=files).collect()}
    assert got == {"a": (3, 2, 4, 1), "b": (0, 0, 0, 2)}


def test_unique_refs(spark):
    refs = spark.createDataFrame([("x", 2, "late"), ("y", 1, "only"), ("x", 0, "early"), ("x", 0, "tie")], "index_id string, position int, via string")
    assert sorted(map(tuple, router.unique_refs(refs).collect())) == [("x", 0, "early"), ("y", 1, "only")]


def test_write_json(spark, tmp_path):
    rows = spark.createDataFrame([("附件", None)], "name string, n int").coalesce(1)
    for compact in (True, False):
        readers.write_json(rows, str(tmp_path / "out"), compact)
        text = next((tmp_path / "out").glob("part-*")).read_text(encoding="utf-8")
        assert json.loads(text) == {"name": "附件", "n": None} and "附件" in text and text.endswith("\n")
        assert (len(text.splitlines()) == 1) is compact
