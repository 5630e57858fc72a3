"""Vocabulary, n-gram and lexicon statistics; tries as flat prefix tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions.text import exact_edges


def word_counts(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """(word, n) over an array column; null and empty arrays add nothing."""
    return tokens.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def floored_counts(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Counts with every lexicon word at least 1."""
    floor = lexicon.select("word", F.lit(1).cast("long").alias("n"))
    seen = counts.unionByName(floor.join(counts, "word", "left_anti").distinct())
    return seen.groupBy("word").agg(F.sum("n").alias("n"))


def bigram_counts(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """(prev, next, n) of neighbours inside one array only."""
    pairs = F.arrays_zip(F.slice(column, 1, F.greatest(F.size(column) - 1, F.lit(0))).alias("prev"), F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0))).alias("next"))
    rows = tokens.where(F.size(column) > 1).select(F.explode(pairs).alias("g"))
    return rows.groupBy(F.col("g.prev").alias("prev"), F.col("g.next").alias("next")).agg(F.count("*").alias("n"))


def top_per_context(bigrams: DataFrame, k: int = 12) -> DataFrame:
    """The k most frequent followers of each word; ties to the later word. The rank limit runs before the shuffle too."""
    w = Window.partitionBy("prev").orderBy(F.desc("n"), F.desc("next"))
    return bigrams.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def char_grams(texts: DataFrame, column: str, size: int, bos: str = "^") -> DataFrame:
    """(gram, n) of ``size`` characters; shorter contexts at the start are padded with ``bos``."""
    padded = F.concat(F.lit(bos * (size - 1)), F.col(column))
    grams = F.transform(F.sequence(F.lit(1), F.length(column)), lambda i: F.substring(padded, i, F.lit(size)))
    return texts.where(F.length(column) > 0).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def backoff_logp(queries: DataFrame, c1: DataFrame, c2: DataFrame, c3: DataFrame, lam: float = 0.4) -> DataFrame:
    """Adds logp of ``ch`` after ``ctx`` (two characters): trigram, else lam times bigram, else lam squared times the unigram with one added.

    Context totals are sums over the gram tables, joined by key.
    """
    size3 = c3.groupBy(F.substring("gram", 1, 2).alias("ctx")).agg(F.sum("n").alias("t3"))
    size2 = c2.groupBy(F.substring("gram", 1, 1).alias("c")).agg(F.sum("n").alias("t2"))
    total = c1.agg(F.sum("n").alias("t1"), F.count("*").alias("v")).first()
    q = queries.withColumn("g3", F.concat("ctx", "ch")).withColumn("g2", F.concat(F.substring("ctx", 2, 1), F.col("ch"))).withColumn("c", F.substring("ctx", 2, 1))
    q = q.join(c3.select(F.col("gram").alias("g3"), F.col("n").alias("n3")), "g3", "left").join(size3, "ctx", "left")
    q = q.join(c2.select(F.col("gram").alias("g2"), F.col("n").alias("n2")), "g2", "left").join(size2, "c", "left")
    q = q.join(c1.select(F.col("gram").alias("ch"), F.col("n").alias("n1")), "ch", "left")
    p1 = (F.coalesce("n1", F.lit(0)) + 1.0) / F.lit(max(1, (total.t1 or 0) + total.v))
    p = F.when(F.col("n3").isNotNull(), F.col("n3") / F.col("t3")).when(F.col("n2").isNotNull(), F.lit(lam) * F.col("n2") / F.col("t2")).otherwise(F.lit(lam * lam) * p1)
    return q.select(*queries.columns, F.log(p).alias("logp"))


def prefix_weights(counts: DataFrame) -> DataFrame:
    """(prefix, pass_weight, word_weight): a trie as rows. pass_weight sums the
    counts of all words through the prefix, word_weight is the word's own."""
    rows = counts.where(F.length("word") > 0).select(
        "word", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(F.col("word"), F.lit(1), i))).alias("prefix")
    )
    return rows.groupBy("prefix").agg(
        F.sum("n").alias("pass_weight"), F.sum(F.when(F.col("prefix") == F.col("word"), F.col("n")).otherwise(0)).alias("word_weight")
    )


def coverage(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """One row: share of types and of tokens that the lexicon has; 0 for no words."""
    known = lexicon.select("word").distinct().withColumn("known", F.lit(1))
    j = counts.join(known, "word", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    return j.agg(
        F.count("*").alias("types"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.coalesce(F.avg("known"), F.lit(0.0)).alias("type_coverage"),
        F.coalesce(F.try_divide(F.sum(F.col("known") * F.col("n")), F.sum("n")), F.lit(0.0)).alias("token_coverage"),
    )


def mine_lexicon(counts: DataFrame, least: int, core: list[str]) -> DataFrame:
    """Words counted ``least`` times or more, or of the core list."""
    return counts.where((F.col("n") >= least) | F.col("word").isin(*core))


def weighted_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """(word, weight): a's counts plus b's scaled to a's total, each b word adding at least 1."""
    x, y = (df.agg(F.sum("n").alias("t")).first().t or 0 for df in (a, b))
    scaled = b.select("word", F.greatest(F.lit(1.0), F.col("n") * F.lit(x / y if y else 0.0)).alias("w"))
    return a.select("word", F.col("n").cast("double").alias("w")).unionByName(scaled).groupBy("word").agg(F.sum("w").alias("weight"))


def overlap_report(a: DataFrame, b: DataFrame) -> DataFrame:
    """(part, n): words in both, only in a, only in b."""
    x = a.select("word").distinct().withColumn("a", F.lit(1))
    y = b.select("word").distinct().withColumn("b", F.lit(1))
    part = F.when(F.col("b").isNull(), "only_a").when(F.col("a").isNull(), "only_b").otherwise("both")
    return x.join(y, "word", "full_outer").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def longest_match(texts: DataFrame, key: str, text: str, lexicon: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """(key, name): the longest lexicon name standing as whole words in the text, the earlier of equals.

    Names are looked up by their first word, so only names that share a word
    with the text are tried. ``text`` and names must be in lexicon form.
    """
    words = texts.select(key, text, F.explode(F.array_distinct(F.split(text, " "))).alias("w"))
    names = lexicon.select(F.col(name).alias("__name"), F.col(seq).alias("__seq"), F.element_at(F.split(name, " "), 1).alias("w"))
    hits = words.join(names, "w").where(F.contains(F.concat(F.lit(" "), F.col(text), F.lit(" ")), F.concat(F.lit(" "), F.col("__name"), F.lit(" "))))
    return hits.groupBy(key).agg(F.max_by("__name", F.struct(F.length("__name").alias("l"), (-F.col("__seq")).alias("s"))).alias(name))


# The patterns of each field class, in order.
FIELD_GRAMMAR = {
    "money": (
        r"[£$€]\s?-?\s?\d[\d,]*(?:\.\d{2})?",
        r"\b(?:GBP|USD|EUR)\s?-?\s?\d[\d,]*(?:\.\d{2})?",
        r"\b\d[\d,]*\.\d{2}\b",
        r"-\s?[£$€]?\s?\d[\d,]*(?:\.\d{2})?",
    ),
    "date": (
        r"\b(?:0?[1-9]|[12]\d|3[01])/(?:0?[1-9]|1[0-2])/(?:\d{2}|\d{4})\b",
        r"\b(?:0?[1-9]|[12]\d|3[01])-(?:0?[1-9]|1[0-2])-(?:\d{2}|\d{4})\b",
        r"\b(?:0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{4}\b",
        r"\b\d{4}-(?:0?[1-9]|1[0-2])-(?:0?[1-9]|[12]\d|3[01])\b",
    ),
    "dosage": (r"\b\d{1,4}(?:\.\d+)?\s?(?:MG|MCG|ML|G|TABLETS?|CAPSULES?)\b",),
    "frequency": (
        r"\bEVERY\s+\d+\s*(?:HOURS?|HRS?)\b",
        r"\b\d+\s*TIMES?\s*(?:A\s*)?DAY\b",
        r"\bONCE DAILY\b|\bTWICE DAILY\b|\bTHREE TIMES DAILY\b|\bAT BEDTIME\b",
    ),
    "account_masked": (r"\bENDING\s*(?:IN\s*)?\d{4}\b", r"\b[*X]{2,}\s*\d{4}\b"),
    "sort_code": (r"\b\d{2}-\d{2}-\d{2}\b", r"\b\d{2}\s\d{2}\s\d{2}\b"),
    "case_ref": (r"\b\d{4}-[A-Z]{2}-\d{3,8}\b",),
    "iban": (r"\bGB\d{2}\s?[A-Z]{4}\s?[\dA-Z]{4}\s?\d{4}[\dA-Z]?\s?\d{4}\b",),
}


def _grammar(pattern: str) -> str:
    return "(?i)" + exact_edges(pattern, r"\p{L}\p{N}_")


def grammar_classes(token: Column) -> Column:
    """All field classes with a pattern that stands somewhere in the token, in fixed order; none for null."""
    t = F.upper(F.trim(F.coalesce(token, F.lit(""))))
    fits = lambda patterns: reduce(or_, (t.rlike(_grammar(p)) for p in patterns))
    return F.array_compact(F.array(*[F.when(fits(p), F.lit(n)) for n, p in FIELD_GRAMMAR.items()]))


def mined_classes(lines: DataFrame, text: str) -> DataFrame:
    """(class, value, n): every stretch of the lines that fits a class, upper case, and how often it stands there."""

    def tagged(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(_grammar(pattern)), F.lit(0)), lambda v: F.struct(F.lit(name).alias("class"), F.upper(F.trim(v)).alias("value")))

    found = [tagged(n, p) for n, patterns in FIELD_GRAMMAR.items() for p in patterns]
    rows = lines.where(F.col(text).isNotNull()).select(F.explode(F.concat(*found)).alias("e")).select("e.*")
    return rows.where("value <> ''").groupBy("class", "value").agg(F.count("*").alias("n"))


def word_bigram_logp(asked: DataFrame, bigrams: DataFrame, eps: float = 0.5) -> DataFrame:
    """(prev, next, logp) of each asked (prev, next): log of the pair's share of its first word, smoothed by ``eps``.

    ``bigrams`` has (prev, next, n). A repeated word, and a first word never seen, say
    nothing: 0. The vocabulary is that of all words in pairs.
    """
    totals = bigrams.groupBy("prev").agg(F.sum("n").alias("t"))
    size = bigrams.select(F.explode(F.array("prev", "next")).alias("w")).agg(F.count_distinct("w").alias("v"))
    met = asked.join(bigrams.groupBy("prev", "next").agg(F.sum("n").alias("n")), ["prev", "next"], "left").join(totals, "prev", "left").join(F.broadcast(size))
    logp = F.log((F.coalesce("n", F.lit(0)) + eps) / (F.col("t") + eps * F.col("v")))
    return met.select("prev", "next", F.when(F.col("prev").eqNullSafe(F.col("next")) | F.col("t").isNull(), 0.0).otherwise(logp).alias("logp"))


def top_bigrams(bigrams: DataFrame, least: int = 3, cap: int = 12_000) -> DataFrame:
    """The export form: pairs counted ``least`` times or more, the ``cap`` commonest (a top-k report)."""
    return bigrams.where(F.col("n") >= least).orderBy(F.desc("n"), "prev", "next").limit(cap)


def combined_logp(scored: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``scored`` with ``logp``: the weighted sum of its model columns; a model without opinion (null) adds 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * w
    return scored.withColumn("logp", total)
