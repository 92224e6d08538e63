"""Quality rules with host-level verdicts; DataFrame functions only.

Base rules fail a document with too few words or too much repeated text. Failures are then
aggregated by host (the source column), of each rule and of the rules together; each host's rates are
shrunk with a beta prior fitted to the hosts' own rates by the method of moments, less the noise of
hosts of few documents, and hosts with a shrunk rate of `host_limit` or more lose all their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, checkpointed, let, own_name

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A host is rejected when nearly all of its documents fail, so that clean documents of mixed hosts stay.
HOST_LIMIT = 0.9
#: Rejected hosts are broadcast up to this many bytes of names; beyond, they meet the documents by a shuffle.
BROADCAST_BYTES = 8 << 20
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def _repeat_words(words: Column) -> Column:
    """Words within a WINDOW-word window that the text has twice or more, the first one included.

    Sorting (hash, position) pairs brings equal windows together; the positions of windows with an
    equal neighbour, sorted again, cover min(WINDOW, gap) words each. Texts without a repeat stop at a set's size.
    """
    count = F.size(words) - (WINDOW - 1)
    hashes = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        def starts(s: Column) -> Column:
            same = lambda k, x: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, k: same(k - 1, x) | same(k + 1, x)), lambda x: x["i"]))
        total = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
        return let(pairs, lambda s: let(starts(s), total))

    whole = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(count < 2, 0).otherwise(whole).cast("long")


def _word_figures(text: Column) -> Column:
    """Struct of n (words) and r (repeated words) of one text; a null text counts as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")
    return let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))


def _facts(text: Column) -> Column:
    """Struct of the base figures of one text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    packed = F.struct(
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _word_figures(text).alias("w"),
    )
    return packed


#: Rules over the word figures of a text, by name.
RULES = {"short": lambda f: f["n"] < MIN_WORDS, "repeated": lambda f: 100 * f["r"] > MAX_REPEAT_PERCENT * f["n"]}
#: What is aggregated by host: each rule, and whether any fails.
RATES = (*RULES, "failed")


def failures(figures: Column) -> Column:
    """Struct of each rule's verdict on the word figures of a text, and of `failed`, the base verdict."""
    one = {name: rule(figures) for name, rule in RULES.items()}
    return F.struct(*(v.alias(k) for k, v in one.items()), (one["short"] | one["repeated"]).alias("failed"))


def host_verdicts(judged: DataFrame, host: str = "source", base: str = "failures", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host: n_docs, and for each of RATES n_<rate> and rate_<rate> (shrunk), and host_bad: some rate reaches host_limit.

    The beta prior of a rate has the mean m of all documents. The variance v of the hosts' rates holds
    binomial noise of about m (1 - m) a, a the mean of 1 / n_docs, so the hosts' own variance is
    w = (v - m (1 - m) a) / (1 - a), and the prior's strength m (1 - m) / w - 1, held between 1 and 1000;
    where no variance is left (equal rates, or hosts of one document each) it is 1000. A null host is one host.
    """
    counted = [F.sum(F.col(base)[k].cast("long")).alias(f"n_{k}") for k in RATES]
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n_docs"), *counted)
    n = F.col("n_docs")
    figures = [x for k in RATES for x in ((F.sum(f"n_{k}") / F.sum(n)).alias(f"m_{k}"), F.var_pop(F.col(f"n_{k}") / n).alias(f"v_{k}"))]
    prior = hosts.agg(*figures, F.avg(1 / n).alias("a"))

    def strength(k: str) -> Column:
        spread = F.col(f"m_{k}") * (1 - F.col(f"m_{k}"))
        own = (F.col(f"v_{k}") - spread * F.col("a")) / (1 - F.col("a"))
        return F.when((F.col("a") < 1) & (own > 1e-12), F.least(F.greatest(spread / own - 1, F.lit(1.0)), F.lit(1000.0))).otherwise(1000.0)

    # one row of prior, so this product has one row per host
    both = hosts.crossJoin(F.broadcast(prior.select(*(f"m_{k}" for k in RATES), *(strength(k).alias(f"s_{k}") for k in RATES))))
    both = both.withColumns({f"rate_{k}": (F.col(f"n_{k}") + F.col(f"m_{k}") * F.col(f"s_{k}")) / (n + F.col(f"s_{k}")) for k in RATES})
    worst = F.greatest(*(F.col(f"rate_{k}") for k in RATES))
    return both.select("host", "n_docs", *(f"n_{k}" for k in RATES), *(f"rate_{k}" for k in RATES), (worst >= host_limit).alias("host_bad"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per row of docs, repeated rows included: its key columns, figures, base_failed, host_rate and kept.

    Null texts have no words and fail; null hosts share one verdict; an empty table gives no rows;
    extra columns are ignored. Windows of words are compared by 64-bit hashes.
    """
    facts = docs.select("doc_id", F.col(host).alias("host_of"), _facts(F.col(text)).alias("f"))
    judged = facts.select(
        "doc_id", "host_of", F.col("f.w.n").alias("n_words"), F.col("f.word_chars"), F.col("f.n_symbols"), F.col("f.n_dup_lines"),
        F.col("f.w.r").alias("n_repeat_words"), failures(F.col("f.w")).alias("failures"),
    )
    judged = checkpointed(judged)  # a few figures a document, so that hosts and verdicts read texts once
    hosts = host_verdicts(judged, "host_of", host_limit=host_limit)
    return (
        judged.join(hosts, judged["host_of"].eqNullSafe(hosts["host"]), "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("failures.failed").alias("base_failed"),
            F.round("rate_failed", 6).alias("host_rate"), (~F.col("failures.failed") & ~F.coalesce("host_bad", F.lit(False))).alias("kept"),
        )
    )


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that quality_rules keeps, with the columns of docs.

    Texts are never shuffled by host, of which one may hold a third of them, unless the rejected hosts'
    names exceed BROADCAST_BYTES.
    """
    bad_text = let(_word_figures(F.col(text)), lambda f: failures(f)["failed"])
    judged = docs.select(F.col(host).alias("host_of"), let(_word_figures(F.col(text)), failures).alias("failures"))
    rejected = checkpointed(host_verdicts(judged, "host_of", host_limit=host_limit).filter("host_bad").select("host"))
    size = rejected.agg(F.sum(F.coalesce(F.octet_length(F.col("host").cast("string")), F.lit(0)) + 16)).first()[0] or 0
    good = docs.filter(~bad_text)
    if size == 0:
        return good
    name = own_name(docs, "rejected_host")
    rejected = rejected.withColumnRenamed("host", name)
    return good.join(F.broadcast(rejected) if size <= BROADCAST_BYTES else rejected, good[host].eqNullSafe(rejected[name]), "left_anti")


#: The same in DuckDB SQL.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS g, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n FROM r, (VALUES (0), (1), (2), (3), (4)) AS o(k) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
p AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (SELECT d.doc_id, d.source, len(d.w)::BIGINT AS n_words, length(regexp_replace(d.t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols, coalesce(p.n, 0)::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id),
b AS (SELECT *, n_words < 10 AS r0, 100 * n_repeat_words > 20 * n_words AS r1, r0 OR r1 AS base_failed FROM f),
u AS (SELECT source, unnest([r0, r1, base_failed]) AS bad, unnest([0, 1, 2]) AS rule FROM b),
h AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(bad::INTEGER)::DOUBLE AS k FROM u GROUP BY source, rule),
m AS (SELECT rule, sum(k) / sum(n) AS m, var_pop(k / n) AS v, avg(1 / n) AS a FROM h GROUP BY rule),
o AS (SELECT rule, m, a, CASE WHEN a < 1 THEN (v - m * (1 - m) * a) / (1 - a) ELSE 0 END AS w FROM m),
s AS (SELECT rule, m, CASE WHEN w > 1e-12 THEN least(greatest(m * (1 - m) / w - 1, 1), 1000) ELSE 1000 END AS s FROM o),
x AS (SELECT source, max(CASE WHEN h.rule = 2 THEN (k + m * s) / (n + s) END) AS rate, max((k + m * s) / (n + s)) AS worst FROM h JOIN s ON h.rule = s.rule GROUP BY source)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate, NOT base_failed AND NOT worst >= 0.9 AS kept
FROM b JOIN x ON b.source IS NOT DISTINCT FROM x.source
"""
