"""Licenses near each other are all retrieved: every result is that of the exact SQL, wherever windows fall."""

import duckdb
import pytest

from corvex.llm import license_scan

TEXTS = [t for _, t in license_scan.TEMPLATES]
STEP = 16  # shingles of the longest template, and so the period of windows


def test_pairs_of_licenses_at_all_offsets(spark):
    pairs = [" ".join(["word"] * k + [a, b]) for a in TEXTS for b in TEXTS for k in range(STEP + 1)]
    three = [" ".join(["word"] * k + [TEXTS[1], b, c]) for b in TEXTS for c in TEXTS for k in (0, 5, 11)]
    docs = spark.createDataFrame(list(enumerate(pairs + three)), "doc_id long, text string")
    documents = docs.toPandas()  # read by DuckDB under this name
    want = duckdb.sql(license_scan.ORACLE).fetchall()
    got = license_scan.license_scan(docs).collect()
    assert len(documents) == len(pairs + three)
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("n, containment, size", [(1, 0.8, 1), (5, 0.8, 2), (16, 0.8, 4), (10, 0.7, 4), (10, 1.0, 1), (3, 0.0, 3)])
def test_sketch_holds_what_no_containment_misses(spark, n, containment, size):
    from pyspark.sql import functions as F

    got = spark.range(1).select(license_scan._sketch(F.array(*map(F.lit, range(n, 0, -1))), containment)).first()[0]
    assert got == list(range(1, size + 1))
