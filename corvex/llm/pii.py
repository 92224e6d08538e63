"""Personal data: base expressions, then bootstrapped contextual extraction; DataFrame functions only.

Base entities (emails, addresses, cards, phones) are the seeds, whatever blanks they have. Lexical patterns
are the words around an entity: the two before it, the two after it, or one on either side. Words with a
digit or an @ are alike in a pattern, and so is what lies before the text; patterns of words after an entity
hold no such words, which by themselves tell too little. Every base entity, and every other word with a
digit or an @, is an instance; patterns and instances form a graph, and each round scores a pattern by the
mean score of its distinct instances and an instance by 1 - product(1 - score) of its accepted patterns,
seeds staying at 1. Scores only grow, and rounds go on until none moves by a thousandth. Instances that end
at `accept` or more in an accepted pattern, and that no base entity covers, are new spans of the kind `context`.

Expressions are written so that Java's matcher neither recurses nor rescans a run: separators between
digits (and dots between labels) are first replaced by one private character, in a copy that keeps all
places, so that loops are over single characters. \\G admits a match right after the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let, own_name

KINDS = ("email", "ip", "card", "phone", "context")
MARK, OTHER = "\ue000", "\ue001"
PATTERN_SCORE, ACCEPT, SUPPORT = 0.8, 0.8, 3
#: Matches whose places are summed up in one go: arrays grow by copying, so long ones are made of such blocks.
BLOCK = 256
_LOCAL = f"A-Za-z0-9._%+{MARK}-"
EXPRESSIONS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": rf"[0-9{MARK}]{{2,}}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Words with a digit or an @, found from their first character only.
MARKED = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"


BLANKS = r"[\x20\x09-\x0D]+"


def _digits(s: Column) -> Column:
    return F.translate(s, f" ().+-{MARK}", "")


def _luhn(d: Column) -> Column:
    def one(i: Column) -> Column:
        x = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + one(i)) % 10 == 0


def _is_byte(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+(?=.)", "")
    return (F.length(short) <= 3) & (short.try_cast("int") <= 255)


VALID = {
    "email": lambda h: F.lit(True),
    "ip": lambda h: F.forall(F.split(h, r"\."), _is_byte),
    "card": lambda h: let(_digits(h), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)),
    "phone": lambda h: F.length(_digits(h)).between(8, 15),
}
_SPANS = "array<struct<a:int,b:int>>"


def _matches(text: Column, pattern: str) -> Column:
    """g (the gap before) and h of every match in order, and last the rest of the text, with a null h."""
    return F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, h: F.struct(g.alias("g"), h.alias("h")))


def _placed(matches: Column) -> Column:
    """h and at (its place in code points) of every match, in time linear in their number but for a small part."""
    size = lambda x: F.length(x["g"]) + F.coalesce(F.length(x["h"]), F.lit(0))
    none = F.array().cast("array<int>")

    def running(values: Column, first: Column) -> Column:
        """Sums of what comes before each value."""
        step = lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
        return F.aggregate(values, F.struct(first.alias("at"), none.alias("out")), step)["out"]

    def placed(m: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.transform(F.slice(m, i + 1, BLOCK), size))

        def starts(b: Column) -> Column:
            before = running(F.transform(b, lambda v: F.aggregate(v, F.lit(0), lambda a, x: a + x)), F.lit(0))
            return F.flatten(F.zip_with(b, before, running))

        at = lambda s: F.zip_with(m, s, lambda x, a: F.struct(x["h"].alias("h"), (a + F.length(x["g"])).alias("at")))
        return F.filter(let(let(blocks, starts), at), lambda x: x["h"].isNotNull())

    return let(matches, placed)


def _spans(kind: str, text: Column) -> Column:
    """(a, b) of every valid match of a kind."""
    plain = F.translate(text, MARK, OTHER)  # a mark of the text itself belongs to no expression
    if kind == "email":
        copy, guard = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK), F.contains(text, F.lit("@"))
    elif kind == "card":
        copy, guard = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", MARK), text.rlike("[0-9][0-9 -]{14,}[0-9]")
    elif kind == "ip":
        copy, guard = text, text.rlike(r"[0-9]\.[0-9]")
    else:
        copy, guard = text, F.contains(text, F.lit("+"))
    found = lambda c: F.transform(F.filter(_placed(_matches(c, EXPRESSIONS[kind])), lambda x: VALID[kind](x["h"])), lambda x: F.struct(x["at"].alias("a"), (x["at"] + F.length(x["h"])).alias("b")))
    # a guard that holds for few texts spares the others the copy and the matcher
    return F.when(guard, let(copy, found)).otherwise(F.array().cast(_SPANS))


#: Stands for a word with a digit or an @ in a pattern, for the text's start, and for its end.
LIKE_ENTITY, START, END = "#", "^", "$"


def _shown(word: Column, outside: Column) -> Column:
    """A word as part of a pattern: lower case without punctuation, LIKE_ENTITY for one with a digit or an @, `outside` for none."""
    return F.when(word == "", outside).when(word.rlike("[0-9@]"), LIKE_ENTITY).otherwise(F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]+", " "))


def _marked(text: Column) -> Column:
    """Words with a digit or an @: place, the word, the two words before it and the two after it ('' beyond the text)."""
    none = F.array().cast("array<struct<at:int,hit:string,before:array<string>,after:array<string>>>")
    pad = F.array(F.lit(""), F.lit(""))
    ends = lambda w: F.struct(F.slice(w, 1, 2).alias("first"), F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2).alias("last"))

    def around(m: Column) -> Column:
        gaps = F.transform(m, lambda x: let(F.filter(F.split(x["g"], BLANKS), lambda w: w != ""), ends))

        def joined(g: Column) -> Column:
            hit = lambda k: F.coalesce(F.array_compact(F.array(F.get(m, k)["h"])), F.array().cast("array<string>"))
            gap = lambda k, end: F.coalesce(F.get(g, k)[end], F.array().cast("array<string>"))
            before = lambda k: F.slice(F.concat(pad, hit(k - 2), gap(k - 1, "last"), hit(k - 1), gap(k, "last")), -2, 2)
            after = lambda k: F.slice(F.concat(gap(k + 1, "first"), hit(k + 1), gap(k + 2, "first"), hit(k + 2), pad), 1, 2)
            return F.transform(_placed(m), lambda x, k: F.struct(x["at"].alias("at"), x["h"].alias("hit"), before(k).alias("before"), after(k).alias("after")))

        return let(gaps, joined)

    return F.when(text.rlike("[0-9@]"), let(_matches(text, MARKED), around)).otherwise(none)


_INSTANCE = "array<struct<a:int,b:int,word:string,contexts:array<string>,seed:boolean>>"


def _instances(seen: Column, spans: Column) -> Column:
    """What the marked words of a text give, as a, b, word, contexts, seed: each base span that starts in one is a seed; a word that no span covers is itself one."""
    lettered = r"[\p{L}\p{N}]"

    def contexts(words: Column) -> Column:
        """Patterns of the two words before and the two after, in the form of _shown."""
        real = lambda *at: F.forall(F.array(*(words[k] for k in at)), lambda x: x.rlike(r"\p{L}"))
        put = lambda kind, *at: F.concat_ws(" ", F.lit(kind), *(F.trim(words[k]) for k in at))
        return F.array_compact(F.array(put("b", 0, 1), F.when(real(1, 2), put("m", 1, 2)), F.when(real(2, 3), put("a", 2, 3))))

    def item(a: Column, b: Column, word: Column, words: Column, seed: bool) -> Column:
        shown = F.transform(words, lambda w, k: _shown(w, F.when(k < 2, START).otherwise(END)))
        return F.struct(a.alias("a"), b.alias("b"), word.alias("word"), let(shown, contexts).alias("contexts"), F.lit(seed).alias("seed"))

    def of_word(s: Column) -> Column:
        end = s["at"] + F.length(s["hit"])
        head = lambda x: F.substring(s["hit"], F.lit(1), x["a"] - s["at"])
        before = lambda h: F.when(h.rlike(lettered), F.array(s["before"][1], h)).otherwise(s["before"])

        def after(x: Column, last: Column) -> Column:
            follows = lambda tail: F.when(tail.rlike(lettered), F.array(tail, last["after"][0])).otherwise(last["after"])
            return let(F.substring(last["hit"], x["b"] - last["at"] + 1, F.length(last["hit"])), follows)

        def seed(x: Column) -> Column:
            # the marked word in which the span ends
            last = F.element_at(F.filter(seen, lambda w: (w["at"] < x["b"]) & (w["at"] >= s["at"])), -1)
            return item(x["a"], x["b"], x["word"], F.concat(let(head(x), before), let(last, lambda w: after(x, w))), True)

        seeds = F.transform(F.filter(spans, lambda x: (x["a"] >= s["at"]) & (x["a"] < end)), seed)
        core = F.regexp_replace(s["hit"], "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")
        first = s["at"] + F.length(F.regexp_extract(s["hit"], "^[^A-Za-z0-9]+", 0))
        covered = F.exists(spans, lambda x: (x["a"] < first + F.length(core)) & (first < x["b"]))
        own = F.when(~covered & core.rlike("[0-9@]"), F.array(item(first, first + F.length(core), core, F.concat(s["before"], s["after"]), False))).otherwise(F.array().cast(_INSTANCE))
        return F.concat(seeds, own)

    return F.flatten(F.transform(seen, of_word))


def base_spans(text: Column) -> Column:
    """Struct of the base spans of each kind; a null text has none."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(*(_spans(k, text).alias(k) for k in KINDS[:4]))


def _listed(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["a"].cast("string"), s["b"].cast("string")))


def found_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, row, base spans and instances of every row of docs, checkpointed: texts are read once."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", text).alias("row"), base_spans(F.col(text)).alias("base"), _marked(t).alias("seen"), t.alias("t"))
    word = lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), F.substring(F.col("t"), s["a"] + 1, s["b"] - s["a"]).alias("word"))
    held = F.transform(F.concat(*(F.col(f"base.{k}") for k in KINDS[:4])), word)
    return checkpointed(rows.select("doc_id", "row", "base", "seen", held.alias("held")))


def scored(edges: DataFrame, pattern_score: float = PATTERN_SCORE, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Scores of words (word, score) and accepted patterns (context, p, n) of a graph (context, word, seed: 1 or 0), when no pattern's score moves any more."""
    words = edges.groupBy("word").agg(F.max("seed").alias("score"))
    last = None
    while True:
        patterns = edges.join(words, "word").groupBy("context").agg(F.avg("score").alias("p"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= support) & (F.col("p") >= pattern_score))
        patterns = checkpointed(patterns)  # which cuts the lineage of the words below as well
        # 1 - product(1 - p), held off 0 for the logarithm
        reach = edges.join(patterns, "context", "left").groupBy("word").agg(F.max("seed").alias("seed"), F.sum(F.log(F.greatest(1 - F.coalesce("p", F.lit(0.0)), F.lit(1e-9)))).alias("l"))
        words = reach.select("word", F.greatest("seed", 1 - F.exp("l")).alias("score"))
        # scores only grow, so equal sums are equal scores
        now = patterns.agg(F.count(F.lit(1)), F.sum(F.round("p", 3).cast("decimal(20,3)"))).first()
        if now == last or not now[0]:
            return words, patterns
        last = now


def discovered(rows: DataFrame, accept: float = ACCEPT, pattern_score: float = PATTERN_SCORE, support: int = SUPPORT) -> DataFrame:
    """row and context spans (an array) of rows in which accepted patterns find unseen identifiers."""
    seen = rows.dropDuplicates(["row"]).filter(F.size("seen") > 0).select("row", F.explode(_instances(F.col("seen"), F.col("held"))).alias("i"))
    graph = checkpointed(seen.select("row", "i.*"))
    edges = checkpointed(graph.select(F.explode("contexts").alias("context"), "word", F.col("seed").cast("double").alias("seed")).groupBy("context", "word").agg(F.max("seed").alias("seed")))
    words, patterns = scored(edges, pattern_score, support)
    new = graph.filter("not seed").select("row", "a", "b", "word", F.explode("contexts").alias("context"))
    new = new.join(patterns.select("context"), "context", "left_semi").join(words.filter(F.col("score") >= accept), "word")
    return new.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("context"))


def pii_spans(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context for every row of docs.

    Null and empty texts have no spans; equal rows get equal results, and count once in the graph; null
    doc_ids stay null; an empty table gives no rows; extra columns are not read.
    """
    rows = found_rows(docs, text)
    more = discovered(rows, **how)
    both = rows.join(more.withColumnRenamed("row", "more_row"), rows["row"] == F.col("more_row"), "left")
    both = both.withColumn("context", F.coalesce("context", F.array().cast(_SPANS)))
    base = F.concat(*(_listed(k, F.col(f"base.{k}")) for k in KINDS[:4]))
    return both.select(
        "doc_id", *(F.size(f"base.{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]), F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _listed("context", F.col("context"))), ",").alias("spans"), F.size("context").cast("long").alias("n_context"),
    )


def redacted(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with every span of its texts replaced by its kind in angle brackets; of overlapping spans the first stands, the longer of two that start together."""
    rows = found_rows(docs, text)
    more = discovered(rows, **how)
    key, row, spans = (own_name(docs, n) for n in ("pii_row", "more_row", "pii_spans"))
    tagged = lambda kind, s: F.transform(s, lambda x: F.struct(x["a"].alias("a"), (-x["b"]).alias("b"), F.lit(kind).alias("k")))
    every = rows.dropDuplicates(["row"]).join(more, "row", "left")
    every = every.select(F.col("row").alias(row), F.array_sort(F.concat(*(tagged(k, F.col(f"base.{k}")) for k in KINDS[:4]), tagged("context", F.coalesce("context", F.array().cast(_SPANS))))).alias(spans))
    every = every.filter(F.size(spans) > 0)

    def replaced(t: Column, s: Column) -> Column:
        step = lambda acc, x: F.when(x["a"] < acc["at"], acc).otherwise(F.struct((-x["b"]).alias("at"), F.concat(acc["out"], F.substring(t, acc["at"] + 1, x["a"] - acc["at"]), F.lit("<"), x["k"], F.lit(">")).alias("out")))
        done = F.aggregate(s, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(t, acc["at"] + 1, F.length(t))))
        return F.when(s.isNull(), t).otherwise(done)

    joined = docs.withColumn(key, F.xxhash64("doc_id", text)).join(every, F.col(key) == F.col(row), "left")
    return joined.withColumn(text, replaced(F.col(text), F.col(spans))).select(*docs.columns)
