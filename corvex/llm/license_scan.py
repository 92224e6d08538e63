"""License scans by MinHash bands over overlapping text windows; DataFrame functions only.

Words are runs of a-z and 0-9 of the lower-cased text; shingles are five words. Only shingles that
some template has decide containment, so a window is reduced to those before its MinHash: a window
that holds a template then has a high Jaccard similarity to it however much other text is around.
With one row per band and `bands` bands, a window at similarity s is retrieved with probability
1 - (1 - s) ** bands, which is no guarantee: beside a template of 16 shingles, one of a single shingle
has s = 1/17 and is retrieved at 32 bands with probability 0.86. So a template is also looked up by its
sketch, its lowest n - m + 1 of n shingles where m are enough: a window with m of the n has one of
the sketch, whatever else it holds. Exact shingle containment then decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 32
BROADCAST_SHINGLES = 100_000
#: Notice lines of public licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
)


def _shingles(text: Column) -> Column:
    """Hashes of all five-word shingles in order; a shorter text is one shingle of all its words, a text without words has none."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))
    many = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    short = lambda w: F.array(F.xxhash64(F.array_join(w, " ")))
    return F.when(clean == "", F.array().cast("array<bigint>")).otherwise(let(F.split(clean, " "), lambda w: F.when(F.size(w) >= SHINGLE, many(w)).otherwise(short(w))))


def _bands(shingles: Column, bands: int) -> Column:
    def low(band: int) -> Column:
        return F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(band))))

    return F.array(*(F.struct(F.lit(b).alias("band"), low(b).alias("low")) for b in range(bands)))


def _keys(bands: Column, shingles: Column) -> Column:
    """Bands, and shingles as keys of a band of their own, -1."""
    return F.concat(bands, F.transform(shingles, lambda h: F.struct(F.lit(-1).alias("band"), h.alias("low"))))


def _sketch(want: Column, containment: float) -> Column:
    """The lowest shingles of a template, so many that no `containment` of it misses them all."""
    enough = F.ceil(F.size(want) * F.lit(float(containment)) - 1e-9)  # a rounding error must not shorten the sketch
    return F.slice(F.array_sort(want), 1, (F.size(want) - F.greatest(enough, F.lit(1)) + 1).cast("int"))


def standard_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def license_scan(docs: DataFrame, templates: DataFrame | None = None, text: str = "text", containment: float = CONTAINMENT, bands: int = BANDS) -> DataFrame:
    """One row per document and license found: doc_id, license, containment (of the best window), n_windows, first_shingle.

    Windows span twice the longest template's shingles and start at every multiple of that template's
    length, so each template lies whole in a window. Rows with the same doc_id are scanned as one
    document each and reported once per license with their best figures; null texts and texts shorter
    than a shingle match only an equally short template; null doc_ids are reported as null. An empty
    table gives no rows; extra columns are ignored; templates without words are never found. Templates
    of up to BROADCAST_SHINGLES shingles are broadcast, which is checked; more of them meet the texts by shuffles.
    """
    spark = docs.sparkSession
    templates = standard_templates(spark) if templates is None else templates
    known = templates.select("license", F.array_distinct(_shingles(F.col("text"))).alias("want")).filter(F.size("want") > 0)
    held = known.agg(F.sum(F.size("want")).alias("n"), F.max(F.size("want")).alias("longest")).first()
    step = int(held["longest"] or 1)
    sent = F.broadcast if (held["n"] or 0) <= BROADCAST_SHINGLES else lambda df: df
    vocabulary = known.select(F.explode("want").alias("h")).distinct()
    rows = docs.select("doc_id", F.xxhash64(F.col(text)).alias("row"), F.posexplode(_shingles(F.col(text))).alias("at", "h"))
    hits = rows.join(sent(vocabulary), "h", "left_semi")
    spread = hits.withColumn("win", F.explode(F.array(F.floor(F.col("at") / step), F.floor(F.col("at") / step) - 1)))
    windows = spread.groupBy("doc_id", "row", "win").agg(F.collect_set("h").alias("have"), F.min("at").alias("at"))
    found = windows.select("doc_id", "row", "win", "at", "have", F.explode(_keys(_bands(F.col("have"), bands), F.col("have"))).alias("b")).select("doc_id", "row", "win", "at", "have", "b.*")
    index = known.select("license", "want", F.explode(_keys(_bands(F.col("want"), bands), _sketch(F.col("want"), containment))).alias("b")).select("license", "want", "b.*")
    pairs = found.join(sent(index), ["band", "low"]).dropDuplicates(["doc_id", "row", "win", "license"])
    share = F.size(F.array_intersect("have", "want")) / F.size("want")
    good = pairs.withColumn("containment", share).filter(F.col("containment") >= containment)
    return good.groupBy("doc_id", "license").agg(F.round(F.max("containment"), 6).alias("containment"), F.count(F.lit(1)).alias("n_windows"), F.min("at").cast("long").alias("first_shingle"))


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES)
    clean = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g'))"
    grams = "CASE WHEN c = '' THEN [] WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] ELSE [c] END"
    return f"""
WITH lic(license, text) AS (VALUES {values}),
t0 AS (SELECT license, {clean} AS c, string_split({clean}, ' ') AS w FROM lic),
t1 AS (SELECT DISTINCT license, unnest({grams}) AS g FROM t0),
n AS (SELECT license, count(*) AS n FROM t1 GROUP BY license),
m AS (SELECT max(n) AS step FROM n),
d0 AS (SELECT doc_id, {clean} AS c, string_split({clean}, ' ') AS w FROM documents),
d1 AS (SELECT doc_id, {grams} AS gs FROM d0),
d2 AS (SELECT doc_id, unnest(gs) AS g, unnest(range(0, len(gs))) AS pos FROM d1),
h AS (SELECT DISTINCT d2.doc_id, d2.g, d2.pos FROM d2 WHERE d2.g IN (SELECT g FROM t1)),
v AS (SELECT doc_id, g, pos, floor(pos / step)::BIGINT - b AS win FROM h, m, (VALUES (0), (1)) AS o(b)),
a AS (SELECT doc_id, win, min(pos) AS pos FROM v GROUP BY doc_id, win),
k AS (SELECT v.doc_id, v.win, t1.license, count(DISTINCT v.g) AS c FROM v JOIN t1 ON v.g = t1.g GROUP BY v.doc_id, v.win, t1.license)
SELECT k.doc_id, k.license, round(max(k.c / n.n::DOUBLE), 6) AS containment, count(*)::BIGINT AS n_windows, min(a.pos)::BIGINT AS first_shingle
FROM k JOIN n ON k.license = n.license JOIN a ON a.doc_id = k.doc_id AND a.win = k.win
WHERE k.c / n.n::DOUBLE >= 0.8 GROUP BY k.doc_id, k.license
"""


ORACLE = _oracle()
