"""Shards: catalog, Bloom filters as long-form bits or bitmaps, proofs that a shard has no match, the ledger."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import BLOOM_BITS, BLOOM_HASHES, FNV_BASIS, FNV_PRIME
from ..functions.text import fnv1a, phrase_tokens, tokens


def catalog(docs: DataFrame) -> DataFrame:
    """One row per shard: sorted distinct facets, types, years, 24 sections at most, documents and bytes."""
    sets = lambda c: F.array_sort(F.collect_set(c))
    return docs.groupBy("shard_id").agg(sets("facet").alias("facets"), sets("record_type").alias("record_types"), F.slice(sets("section"), 1, 24).alias("sections"), sets("year").alias("years"), F.count(F.lit(1)).alias("document_count"), F.sum(F.octet_length("content")).alias("bytes"))


def bits_of(tokens: list[str]) -> np.ndarray:
    """fnv1a of every token by each seed, modulo the filter's bits: one row per seed. All tokens go on by one byte at a time."""
    coded = [t.encode() for t in tokens]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    start, order = np.cumsum(size) - size, np.argsort(-size, kind="stable")
    data, start, size = np.frombuffer(b"".join(coded), np.uint8), start[order], size[order]
    h = np.empty((BLOOM_HASHES, len(coded)), np.uint32)
    h[:] = np.array([(FNV_BASIS ^ seed) & 0xFFFFFFFF for seed in range(BLOOM_HASHES)], np.uint32)[:, None]
    at, longer = 0, int((size > 0).sum())
    while longer:
        part = h[:, :longer]
        part ^= data[start[:longer] + at]
        part *= np.uint32(FNV_PRIME)
        at += 1
        while longer and size[longer - 1] <= at:
            longer -= 1
    out = np.empty(h.shape, np.int32)
    out[:, order] = h % BLOOM_BITS
    return out


def filter_bits(docs: DataFrame, blob: str = "blob") -> DataFrame:
    """shard_id and bit: the distinct Bloom bits of the tokens of its documents. Bits are made distinct within
    each document first, so a shard shuffles at most 16,384 rows from each task. Bytes of tokens are hashed by
    an Arrow UDF, since column expressions take some hundred nanoseconds for each byte and seed. It and its argument
    count as not deterministic: else Spark folds the tokens' lambdas into the UDF, where it can't run them, and
    runs both once more in a filter on empty lists."""

    @F.pandas_udf("array<int>")
    def bits(lists: pd.Series) -> pd.Series:
        ends = np.cumsum([0, *map(len, lists)])
        every = bits_of([t for tokens in lists for t in tokens])
        return pd.Series([np.unique(every[:, a:b]) for a, b in zip(ends, ends[1:])], dtype=object)

    listed = docs.select("shard_id", F.when(F.monotonically_increasing_id() >= 0, tokens(blob, 5, normalized=True)).alias("tokens"))
    own = listed.select("shard_id", bits.asNondeterministic()("tokens").alias("bits")).select("shard_id", F.explode("bits").alias("bit"))
    return own.distinct()


def filter_bitmaps(bits: DataFrame) -> DataFrame:
    """shard_id and its 16,384 bits as 4 KiB of binary (bit 0 of byte 0 first)."""
    return bits.groupBy("shard_id").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bitset"), F.count(F.lit(1)).alias("bits_set"))


def may_contain(bitset: Column, token: Column) -> Column:
    """Whether all of a token's bits are set."""
    def one(seed: int) -> Column:
        bit = (fnv1a(token, seed) % BLOOM_BITS).cast("int")
        byte = F.conv(F.hex(F.substring(bitset, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, bit % 8) == 1

    out = one(0)
    for seed in range(1, BLOOM_HASHES):
        out = out & one(seed)
    return out


def proof_tokens(phrase: Column, safe: bool = True) -> Column:
    """Tokens whose absence proves that no document of a shard holds the phrase.

    safe: only n-grams of CJK runs, which every document with the phrase has indexed; a run of ASCII may be
    part of a longer one there, and a phrase without such tokens proves nothing. Otherwise all tokens, the
    phrase itself included: more shards are ruled out, some of them wrongly.
    """
    every = phrase_tokens(phrase)
    return F.filter(every, lambda t: t.rlike(r"^[一-鿿]{2,5}$")) if safe else every


def proved_empty(filters: DataFrame, phrases: list[str], safe: bool = True) -> DataFrame:
    """shard_id of shards in which every phrase has an absent token. phrases are normalized."""
    checks = F.lit(True)
    for phrase in phrases:
        checks = checks & F.exists(proof_tokens(F.lit(phrase), safe), lambda t: ~may_contain(F.col("bitset"), t))
    return filters.filter(checks).select("shard_id")


def ledger(shards: DataFrame, proved: DataFrame, scanned: DataFrame | None = None, failed: DataFrame | None = None) -> DataFrame:
    """shard_id, state and documents; shards has in_scope."""
    out = shards.join(proved.select("shard_id", F.lit(True).alias("proved")), "shard_id", "left")
    for name, rows in (("scanned", scanned), ("failed", failed)):
        out = out.withColumn(name, F.lit(False)) if rows is None else out.join(rows.select("shard_id", F.lit(True).alias(name)), "shard_id", "left")
    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    state = F.when(~F.col("in_scope"), "out_of_scope").when(true("failed"), "failed").when(true("scanned"), "scanned").when(true("proved"), "proved_no_match").otherwise("pending")
    return out.select("shard_id", state.alias("state"), "document_count", "bytes")


def ledger_summary(rows: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.agg(*(count(s) for s in ("pending", "scanned", "proved_no_match", "failed", "out_of_scope")), F.count(F.lit(1)).alias("total"), (F.count_if(F.col("state").isin("pending", "failed")) == 0).alias("complete"))
