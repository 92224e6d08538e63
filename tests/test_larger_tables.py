"""What makes queries grow with the texts no faster than these do: texts are made ready once, and hashed fast."""

import duckdb
import pytest
from pyspark.sql import functions as F

from corvex.functions import text
from corvex.operators import postings, shards
from corvex.plans import router, search
from corvex.queries import NOW, ORACLES, QUERIES, view_of

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_canonical_title_of_empty_first_lines(spark, tmp_path):
    rows = [(1, "\nbody", "en", "src1", 5), (2, " - _ \nbody", "en", "src1", 9), (3, "- a title -\nbody", "en", "src1", 9), (4, "", "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["canonical_title"]).fetchall())
    assert sorted(map(tuple, QUERIES["canonical_title"](spark, str(tmp_path)).collect())) == want == [(1, ""), (2, ""), (3, "a title"), (4, "")]


def test_canonical_title_keeps_a_title_that_is_a_label(spark):
    row = spark.createDataFrame([("【通知】 -",)], "t string").select(text.canonical_title("t").alias("a"), text.canonical_title("t", whole=False).alias("b")).first()
    assert tuple(row) == ("【通知】 -", "")


def test_blank_characters_are_those_of_the_pattern(spark):
    every = spark.createDataFrame([("a" + "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x10000)])) + "b",)], "t string")
    row = every.select(text.normalize_text("t", stable=True).alias("got"), F.regexp_replace(F.lower("t"), text.BLANKS, "").alias("want")).first()
    assert row["got"] == row["want"]


def test_snippets_are_made_of_the_top_rows_only(spark):
    plan = plan_of(QUERIES["snippets"](spark, SF))
    assert plan.index("ArrowEvalPython") < plan.index("GlobalLimit")  # the plan is written from the top


def test_phrases_are_looked_up_in_a_blob_made_once(spark):
    found = search.holding(view_of(spark, SF), ["withth", "ersteth"]).select("id")
    assert all("lower(" not in line for line in plan_of(found).replace("\n,", ",").split("\n") if "Filter" in line and "Contains" in line)
    assert plan_of(found).count("lower(coalesce(text") + plan_of(found).count("lower(coalesce(content") == 1


def test_bloom_bits_are_those_of_fnv1a(spark):
    tokens = ["a", "the.", "校历", "x" * 300, "the.-_9", ""]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select(*((text.fnv1a(F.col("t"), s) % shards.BLOOM_BITS).alias(f"b{s}") for s in range(shards.BLOOM_HASHES))).collect()
    assert shards.bits_of(tokens).T.tolist() == [list(r) for r in rows]
    assert shards.bits_of([]).shape == (shards.BLOOM_HASHES, 0)


@pytest.mark.parametrize(("name", "scans"), [("route_summary", 2), ("index_utility", 3), ("chosen_indexes", 3)])
def test_texts_are_read_once_for_the_directory(spark, name, scans):
    """Once for the matches, and once for the bytes of each index, in the directory and beside it."""
    assert plan_of(QUERIES[name](spark, SF)).count("Relation [") <= scans


def test_tokens_prepare_a_text_once(spark):
    rows = spark.createDataFrame([("A b",)], "t string").select(F.size(text.tokens(F.lower("t"), normalized=True)).alias("n"))
    assert plan_of(rows).count("lower(") == 1


def test_progressive_search_proves_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(value):
        seen.add(1)
        return value

    view = view_of(spark, SF).limit(40).cache()
    bits = shards.filter_bits(view.withColumn("blob", counted.asNondeterministic()("blob")))
    docs = view.select("doc_index", "title", "content")
    light = docs.select(F.lit("the").alias("term"), F.lit("t").alias("field"), "doc_index")
    events = list(search.progressive_search(view, light, light.withColumn("field", F.lit("c")), "the", NOW, filters_of=shards.filter_bitmaps(bits)))
    assert events[-1].stats["complete"] and seen.value == view.count()


def test_indexes_of_one_name_stay_apart(spark):
    rows = [("x__en__2025", "x", "en", "2025", 3, 10), ("x__en__2025", "x__en", None, "2025", 4, 20)]
    indexes = spark.createDataFrame(rows, "index_id string, source_id string, facet string, year string, doc_count long, bytes long")
    routes = spark.createDataFrame([("q", ["x__en__2025"], ["x"], ["en"])], "term string, likely_local_index array<string>, likely_source array<string>, likely_facet array<string>")
    plan = router.QueryPlan("q", ["q"], ["q"], "broad_exploratory", [], "balanced")
    assert sorted(r["doc_count"] for r in router.with_utility(indexes, plan, routes).collect()) == [3, 4]


def test_remaining_impact_adds_each_block_once(spark, monkeypatch):
    """A frame that ends at the last row is added up anew for each row, so time grows with the square of the blocks."""
    monkeypatch.setattr(postings, "RUN_OF_BLOCKS", 3)
    lists = [(1, "the", "c", 11, 10), (1, "and", "c", 11, 7), (1, "and", "t", 11, 1), (1, "with", "c", 12, 3), (2, "the", "c", 11, 4), (2, None, "c", 11, 4), (3, "le", None, None, 2)]
    rows = [(q, t, f, b, i, 32) for q, t, f, i, n in lists for b in range(n)] + [(4, "own", "c", b, 20 - b % 7, 32) for b in range(20)]
    got = postings.remaining_impact(spark.createDataFrame(rows, "query_id int, term string, field string, block int, impact int, n int"))
    assert got.columns == ["query_id", "term", "field", "block", "impact", "n", "remaining"] and "unboundedfollowing" not in plan_of(got).lower()
    first = lambda v: (v is not None, v or "")
    rows.sort(key=lambda r: (r[0], r[4] is None, -(r[4] or 0), first(r[1]), first(r[2]), r[3]))
    want = {r[:6]: None if r[4] is None else sum(x[4] for x in rows[k:] if x[0] == r[0] and x[4] is not None) for k, r in enumerate(rows)}
    assert {tuple(r)[:6]: r["remaining"] for r in got.collect()} == want and got.count() == len(rows)


def test_remaining_impact_makes_the_blocks_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(value):
        seen.add(1)
        return value

    docs = spark.range(2000).select(F.lit("the").alias("term"), F.lit("c").alias("field"), counted.asNondeterministic()("id").alias("doc_index"))
    rows = postings.remaining_impact(postings.blocks(docs).withColumn("query_id", F.lit(1))).select("term", "field", "block", "remaining").collect()
    assert seen.value == 2000 and len(rows) == 63 and max(r["remaining"] for r in rows) == 63 * min(r["remaining"] for r in rows)
