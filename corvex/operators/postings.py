"""Inverted index in long form (term, field, doc_index): building, scoring, top candidates, packed form."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.constants import BLOCK_SIZE, CANDIDATES, FALLBACK_BELOW, FALLBACK_BOOST, FIELD_IMPACTS
from ..functions.text import clean_text, tokens

#: Blocks of a list in a run of them, whose impacts one task adds up.
RUN_OF_BLOCKS = 4096


def impact_of(field: Column, term: Column) -> Column:
    """The field's impact and the term's length, up to 8."""
    out = F
    for code, impact in FIELD_IMPACTS.items():
        out = out.when(field == code, impact)
    return (out.otherwise(0) + F.least(F.length(term), F.lit(8))).cast("int")


def _spread(docs: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """One pass over docs: tokens of all fields, exploded. Tokens are distinct within a field, so no shuffle is needed."""
    listed = F.flatten(F.array(*(_tagged(code, value) for code, value in fields.items())))
    return docs.select("doc_index", F.explode(listed).alias("p")).select("p.term", "p.field", "doc_index")


def _tagged(code: str, value: Column) -> Column:
    return F.transform(value, lambda t: F.struct(F.lit(code).alias("field"), t.alias("term")))


def light_postings(docs: DataFrame, stable: bool = False) -> DataFrame:
    """Postings of title, section, path, tags, attachments, and of external and system entries."""
    none = F.array().cast("array<string>")
    joined = lambda *c: F.concat_ws(" ", *c)
    attachment = F.array_join(F.transform(F.coalesce("attachments", F.array().cast(dict(docs.dtypes)["attachments"])), lambda a: joined(clean_text(a["name"]), clean_text(a["extension"]), clean_text(a["section"]))), " ")
    system = (F.col("record_type") == "utility") | (F.col("facet") == "system")
    return _spread(docs, {
        "t": tokens("title", 4, 120, stable),
        "s": tokens(joined("section", "nav_path_text"), 4, 80, stable),
        "n": tokens(F.array_join("nav_path", " "), 4, 80, stable),
        "g": tokens(F.array_join("tags", " "), 4, None, stable),
        "a": tokens(attachment, 4, 80, stable),
        "e": F.when(F.col("record_type") == "external", tokens(joined("title", "url"), 5, None, stable)).otherwise(none),
        "y": F.when(system, tokens(joined("title", "url", "section"), 5, None, stable)).otherwise(none),
    })


def body_postings(docs: DataFrame, stable: bool = False) -> DataFrame:
    return _spread(docs, {"m": tokens("summary", 4, 80, stable), "c": tokens("content", 3, 180, stable)})


def write_postings(postings: DataFrame, path: str, files: int) -> None:
    """Parquet sorted by term, so that a filter on terms reads few row groups."""
    postings.repartitionByRange(files, "term").sortWithinPartitions("term", "field", "doc_index").write.mode("overwrite").parquet(path)


def postings_for(postings: DataFrame, terms: list[str]) -> DataFrame:
    """Only the query's terms: the filter reaches the Parquet scan."""
    return postings.filter(F.col("term").isin(terms))


def impact_scores(postings: DataFrame, terms: list[str]) -> DataFrame:
    """doc_index and the exact sum of impacts over all the query's postings."""
    hits = postings_for(postings, terms)
    return hits.groupBy("doc_index").agg(F.sum(impact_of(F.col("field"), F.col("term"))).cast("long").alias("light_score"))


def with_fallback(scores: DataFrame, meta: DataFrame, query: str) -> DataFrame:
    """With fewer than FALLBACK_BELOW candidates, documents whose title or path holds the query get a boost, once."""
    few = scores.limit(FALLBACK_BELOW).agg((F.count(F.lit(1)) < FALLBACK_BELOW).alias("few"))
    held = meta.filter(F.contains("meta_blob", F.lit(query))).select("doc_index", F.lit(FALLBACK_BOOST).cast("long").alias("light_score"))
    held = held.crossJoin(F.broadcast(few)).filter("few").drop("few")  # one row on the right
    return scores.unionByName(held).groupBy("doc_index").agg(F.sum("light_score").alias("light_score"))


def top_candidates(scores: DataFrame, k: int = CANDIDATES) -> DataFrame:
    return scores.orderBy(F.desc("light_score"), "doc_index").limit(k)


def top_per_query(scores: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The same for many queries at once; scores has query_id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("light_score"), "doc_index")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocks(postings: DataFrame, size: int = BLOCK_SIZE) -> DataFrame:
    """Postings cut into blocks of `size` ids with the impact that bounds them, as block-max pruning reads them."""
    order = Window.partitionBy("term", "field").orderBy("doc_index")
    numbered = postings.withColumn("block", ((F.row_number().over(order) - 1) / size).cast("int"))
    out = numbered.groupBy("term", "field", "block").agg(F.count(F.lit(1)).alias("n"), F.min("doc_index").alias("first_doc"), F.max("doc_index").alias("last_doc"))
    return out.withColumn("impact", impact_of(F.col("field"), F.col("term")))


def remaining_impact(blocks_of_query: DataFrame) -> DataFrame:
    """Impact that blocks from each one on can still add, in order of impact.

    Summed from the last block up, because Spark adds up a frame that ends at the last row anew for each row, and in runs
    of a list's blocks first, so that the one task that adds up a query's runs gets a row of each, not its blocks.
    """
    dealt = blocks_of_query.repartition("query_id", "term", "field", F.floor(F.col("block") / RUN_OF_BLOCKS))
    rows = dealt.withColumn("_run", F.floor(F.col("block") / RUN_OF_BLOCKS))
    keys = ["query_id", "impact", "term", "field", "_run"]
    last_first = [F.asc("impact"), F.desc("term"), F.desc("field")]
    before = Window.partitionBy("query_id").orderBy(*last_first, F.desc("_run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(*keys).agg(F.sum("impact").alias("_sum")).withColumn("_later", F.sum("_sum").over(before))
    runs = runs.select(*(F.col(k).alias(f"_of_{k}") for k in keys), "_later")
    within = Window.partitionBy(*keys).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, 0)
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    out = rows.withColumn("_within", F.sum("impact").over(within)).join(runs, same)
    return out.select(*blocks_of_query.columns, (F.col("_within") + F.coalesce("_later", F.lit(0))).alias("remaining"))


def threshold(scores: DataFrame, k: int) -> DataFrame:
    """The k-th largest score of each query, 0 with fewer."""
    order = Window.partitionBy("query_id").orderBy(F.desc("light_score"))
    return scores.withColumn("r", F.row_number().over(order)).groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("r") == k, F.col("light_score"))), F.lit(0)).alias("threshold"))


def encode_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def decode_varints(data: bytes) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in data:
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(value)
            value = shift = 0
    return out


def pack(postings: DataFrame) -> DataFrame:
    """term, field and its sorted doc ids as varints of their gaps; a term's list is one row, so use it for terms of bounded length."""

    def gaps(ids: list) -> bytes:
        last, out = 0, b""
        for i in ids:
            out += encode_varint(int(i) - last)
            last = int(i)
        return out

    @F.pandas_udf("binary")
    def code(ids: pd.Series) -> pd.Series:
        return ids.map(gaps)

    return postings.groupBy("term", "field").agg(F.array_sort(F.collect_set("doc_index")).alias("ids")).select("term", "field", F.size("ids").alias("n"), code("ids").alias("packed"))


def unpack(packed: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Postings again, of some terms only if given."""

    @F.pandas_udf("array<long>")
    def ids(data: pd.Series) -> pd.Series:
        return data.map(lambda d: pd.Series(decode_varints(d)).cumsum().tolist())

    rows = packed if terms is None else packed.filter(F.col("term").isin(terms))
    return rows.select("term", "field", F.explode(ids("packed")).alias("doc_index"))


def statistics(packed: DataFrame) -> DataFrame:
    return packed.agg(F.countDistinct("term").alias("terms"), F.count(F.lit(1)).alias("lists"), F.sum("n").alias("postings"), F.sum(F.length("packed")).alias("bytes"))
