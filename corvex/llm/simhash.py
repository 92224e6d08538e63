"""SimHash near-dedup with BK-trees.

Fingerprints of distinct texts that differ in `radius` bits or fewer agree, cut into blocks, in all but
`radius` blocks at least; so each fingerprint is filed in one shard per choice of agreeing blocks, and
every link lies within a shard. A shard holds a BK-tree (children keyed by their integer Hamming distance
to the parent); its own fingerprints query it, following only edges within the radius of the distance.
A shard of more than `shard_rows` fingerprints is dealt out as several trees, and each of these is
queried by all of the shard's fingerprints in blocks.

The trees are not broadcast: the set of all fingerprints grows with the corpus, so trees and queries
meet by a shuffle on the shard key. Each tree returns a forest of its links, at most one per query, and
components are found by alternating star contractions over those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_python, checkpointed, own_name, partitions, strings

RADIUS, SHINGLE, SHARD_ROWS = 3, 3, 4096
_LOWER = {i: i + 32 for i in range(65, 91)}
_BLANKS = dict.fromkeys((9, 10, 11, 12, 13), 32)


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    import xxhash

    words = [w for w in (text or "").translate(_LOWER | _BLANKS).split(" ") if w]
    if not words:
        return 0
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    whole = b" ".join(coded)
    ends = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) + 1)
    starts = np.concatenate(([0], ends[:-1])).tolist()
    ends = (ends - 1).tolist()
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    hashes = np.fromiter((digest(whole[a:b], 42) for a, b in zip(starts, last, strict=False)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a bounded piece of the bit matrix at a time
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and key (a hash of the text) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"doc_id": strings(batch["doc_id"]), "fp": fps.view(np.int64), "key": batch["key"]})

    rows = docs.select("doc_id", F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    return by_python(rows, run, "fp long, key long", more=("key",))


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of the bits that agree, one for each choice of blocks - radius blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]


class BKTree:
    """Values in a list; children of a node by their distance to it."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        if len(self.values) == 1:
            return
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = len(self.values) - 1
                return
            at = self.children[at][d]

    def near(self, value: int, radius: int) -> Iterator[int]:
        stack = [0] if self.values else []
        while stack:
            at = stack.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                yield at
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def _forest(trees: list[tuple[int, int]], queries: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Links that join what the tree's and the queries' links join: at most one for each of both."""
    tree, nodes, parent = BKTree(), [], {}
    for value, node in trees:
        tree.add(value)
        nodes.append(node)

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for value, node in queries:
        for hit in tree.near(value, radius):
            a, b = root(node), root(nodes[hit])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node, nodes[hit]))
    return out


def near_links(nodes: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between nodes (fp, node), fp distinct, that join all fingerprints within the radius."""
    spark = nodes.sparkSession
    if blocks is None:  # more rows need longer agreeing keys, so that a shard of unrelated fingerprints stays small
        n = nodes.count()
        blocks = radius + 1
        while blocks < radius + 4 and n / 2 ** (64 * (blocks - radius) / blocks) > 64:
            blocks += 1
    # masks as signed longs
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(radius, blocks)]
    keyed = nodes.select("fp", "node", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks))).alias("mask", "key"))
    sizes = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    trees = F.ceil(F.col("n") / shard_rows).cast("int")
    filed = keyed.join(sizes, ["mask", "key"]).withColumn("trees", trees).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int"))
    # a fingerprint is in the tree `own` and queries the trees up to it; so each pair meets once at least
    filed = filed.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("own"))))
    filed = filed.select("mask", "key", "tree", (F.col("own") != F.col("tree")).alias("asks"), "fp", "node")
    count = max(partitions(nodes), spark.sparkContext.defaultParallelism)
    dealt = filed.repartition(count, "mask", "key", "tree").sortWithinPartitions("mask", "key", "tree", "asks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, tree, queries = None, [], []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for mask, key, number, asks, fp, node in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
                if (mask, key, number) != shard:
                    out += _forest(tree, tree + queries, radius)
                    shard, tree, queries = (mask, key, number), [], []
                fp &= (1 << 64) - 1
                if not asks:
                    tree.append((fp, node))
                else:
                    queries.append((fp, node))
                    if len(queries) >= shard_rows:  # queries pass through in blocks
                        out += _forest(tree, queries, radius)
                        queries = []
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(_forest(tree, tree + queries, radius), columns=["a", "b"], dtype="int64")

    return dealt.mapInPandas(run, "a long, b long").filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reachable.

    Alternates two contractions, each linear in the links: neighbours above a node move to its smallest
    neighbour, then neighbours below do. The links are checkpointed each round, and the rounds, about the
    logarithm of the longest chain, end when no link changes.
    """
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    print_ = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = checkpointed(small.filter("a != b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == print_:
            return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node")
        print_ = now


def simhash_groups(docs: DataFrame, text: str = "text", radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs; doc_id must be an integer column.

    Texts without words have fingerprint zero and link like any other. Rows with the same doc_id are
    separate rows that share their smallest component; null doc_ids link texts but never name a
    component, so a component of null doc_ids only has a null id. An empty table gives no rows; extra
    columns are not read. The links between distinct fingerprints are a forest, not all pairs.
    """
    prints = checkpointed(fingerprints(docs, text))
    return grouped(prints.drop("key"), radius, blocks, shard_rows)


def grouped(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """simhash_groups for rows (doc_id, fp) that have their fingerprints already; more columns are kept."""
    # Fingerprints are nodes named by themselves while linking, and components get their smallest doc_id at the end.
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = components(near_links(nodes.select("fp", F.col("fp").alias("node")), radius, blocks, shard_rows))
    named = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("c"))
    smallest = named.groupBy("c").agg(F.min("first").alias("component_id"))
    labels = named.join(smallest, "c").select("fp", "component_id")
    out = prints.join(labels, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *(c for c in prints.columns if c not in ("doc_id", "fp")))


def one_of_each(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """The rows of docs with the smallest doc_id of their group, one row each; rows with a null doc_id stay only if their group has no other, one row per text."""
    groups = grouped(checkpointed(fingerprints(docs, text)), **how)
    name, key = own_name(docs, "kept_id"), own_name(docs, "kept_key")
    keep = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias(name), F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    keep = checkpointed(keep)
    rows = docs.join(keep.select(name, key), docs["doc_id"].eqNullSafe(keep[name]) & (F.xxhash64(docs[text]) == keep[key]), "left_semi")
    # seen from the fingerprints, without another pass over texts; ids with two texts to keep count as well
    if keep.groupBy(name, F.when(F.col(name).isNull(), F.col(key))).agg(F.sum("n").alias("n")).filter("n > 1").isEmpty():
        return rows
    null_id = F.when(F.col("doc_id").isNull(), F.xxhash64(text))
    order = Window.partitionBy("doc_id", null_id).orderBy(F.xxhash64(text))
    turn = own_name(docs, "turn")
    return rows.withColumn(turn, F.row_number().over(order)).filter(F.col(turn) == 1).select(*docs.columns)
