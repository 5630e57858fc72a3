"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.llm.pages import source_name
from foliolake.llm.tokens import VOCABULARY, token_count
from foliolake.operators.prefix import prefix_sums
from foliolake.session import cut, spread

#: Copies are counted in units of 2**-SCALE_BITS, so prefix sums are exact integers.
SCALE_BITS = 20
#: Texts of a source lie in order of size, by so many classes per power of two, each in so many hash buckets.
CLASSES = 16
#: A size class of a source is cut into hash buckets of about this many texts, each sorted by itself.
BUCKET_TEXTS = 50_000
#: Rounds in which a source may give or take one copy to come nearer to its share.
CORRECTIONS = 3
#: The rates, one row per target source, are broadcast; more sources than this raise.
MAX_TARGETS = 100_000


def sized_texts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of the non-blank texts; sources in one spelling."""
    live = spread(documents.select("doc_id", "text", "source").where(F.col("text").rlike(r"\S")))
    tokens = token_count(documents.sparkSession, F.col("text"), path)
    return live.select("doc_id", source_name(F.col("source")).alias("source"), tokens.alias("tokens"))


def rates(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, source_tokens, rate): copies expected of each text.

    Without ``total_tokens`` the mix is the largest in which every source
    with texts can meet its share under its cap. With it, a source that
    cannot supply its share is used max_repeats times and falls short, which
    the report shows. Shares are normalised over the targets; null or
    negative shares or caps count as 0.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("source_tokens"))
    clean = targets.select(
        source_name(F.col("source")).alias("source"),
        F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
        F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"),
    )
    everything = Window.partitionBy()  # over the targets, one row per source
    clean = clean.withColumn("target_share", F.try_divide("target_share", F.sum("target_share").over(everything)))
    known = clean.join(have, "source", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    usable = (F.col("target_share") > 0) & (F.col("source_tokens") > 0) & (F.col("max_repeats") > 0)
    reach = F.when(usable, F.col("source_tokens") * F.col("max_repeats") / F.col("target_share"))
    size = F.lit(float(total_tokens)) if total_tokens is not None else F.min(reach).over(everything)
    rate = F.least(F.col("target_share") * size / F.col("source_tokens"), F.col("max_repeats").cast("double"))
    return known.withColumn("rate", F.when(usable, rate).otherwise(F.lit(0.0)))


def offset(source: Column, seed: int) -> Column:
    """One pseudo-random start in [0, 1) per source, in units of 2**-SCALE_BITS."""
    return F.pmod(F.xxhash64(source, F.lit(seed)), F.lit(1 << SCALE_BITS))


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, source, tokens, copies) for every sized text.

    Within a source, texts lie in order of size class and hash; the prefix sum
    of expected copies plus one offset crosses integers, and a text is used
    once per crossing: floor(rate) or ceil(rate) times, so never above the
    cap. A source whose sum misses its share by more than a text's size then
    loses or gains one copy of the text that comes nearest, CORRECTIONS times
    at most. Texts of no target source, or of none, get 0 copies. Equal texts
    under different ids are sampled separately.
    """
    rate = rates(sized, targets, total_tokens)
    unit = F.round(F.col("rate") * (1 << SCALE_BITS)).cast("long").alias("unit")
    aim = F.round(F.col("rate") * F.col("source_tokens")).cast("long").alias("aim")
    few = rate.select("source", unit, "max_repeats", aim).limit(MAX_TARGETS + 1).collect()
    if len(few) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} target sources")
    units = sized.sparkSession.createDataFrame([tuple(r) for r in few], "source string, unit long, cap int, aim long")
    buckets = max(4, -(-sized.count() // BUCKET_TEXTS))
    rows = sized.join(F.broadcast(units), "source", "left")
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    size_class = F.floor(F.log2(F.greatest(F.col("tokens"), F.lit(1))) * CLASSES).cast("int")
    coarse = size_class.cast("long") * buckets + F.pmod(order, F.lit(buckets))
    laid = prefix_sums(rows, "source", "unit", coarse, [F.col("tokens"), order, F.col("doc_id")], "before")
    start = F.col("before") + offset(F.coalesce("source", F.lit("")), seed)
    crossed = F.shiftright(start + F.coalesce("unit", F.lit(0)), SCALE_BITS) - F.shiftright(start, SCALE_BITS)
    mixed = laid.select("doc_id", "source", "tokens", crossed.cast("int").alias("copies"))
    for _ in range(CORRECTIONS):
        mixed = _nearer(cut(mixed), F.broadcast(units.select("source", "cap", "aim")))
    return mixed


def _nearer(mixed: DataFrame, units: DataFrame) -> DataFrame:
    """``mixed`` with one copy more or less per source, where that brings its sum nearer to its aim."""
    sums = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("now"))
    over = sums.join(units, "source").select("source", "cap", (F.col("now") - F.col("aim")).alias("over")).where("over <> 0")
    may = F.when(F.col("over") > 0, F.col("copies") > 0).otherwise(F.col("copies") < F.col("cap"))
    left = F.abs(F.abs("over") - F.col("tokens"))
    # One row per target source on the one side, one per source on the other: both within MAX_TARGETS.
    asked = mixed.join(F.broadcast(over), "source").where(may & (left < F.abs("over")) & F.col("doc_id").isNotNull())
    change = asked.groupBy("source").agg(F.min(F.struct(left.alias("left"), F.col("doc_id").alias("who"), (-F.signum("over")).cast("int").alias("step"))).alias("c"))
    picked = F.broadcast(change.select(F.col("source").alias("s"), "c.who", "c.step"))
    met = mixed.join(picked, (F.col("source") == F.col("s")) & (F.col("doc_id") == F.col("who")), "left")
    return met.select("doc_id", "source", "tokens", (F.col("copies") + F.coalesce("step", F.lit(0))).alias("copies"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, actual_tokens, texts_used, most_copies, actual_share, deviation) per target source.

    deviation is actual_share less the normalised target share.
    """
    used = mixed.groupBy("source").agg(
        F.sum(F.col("tokens") * F.col("copies")).alias("actual_tokens"),
        F.sum((F.col("copies") > 0).cast("long")).alias("texts_used"),
        F.max("copies").alias("most_copies"),
    )
    rows = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").join(used, "source", "left")
    rows = rows.fillna(0, ["actual_tokens", "texts_used", "most_copies"])
    whole = F.sum("actual_tokens").over(Window.partitionBy())
    target = F.coalesce(F.try_divide(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).over(Window.partitionBy())), F.lit(0.0))
    rows = rows.withColumn("actual_share", F.coalesce(F.try_divide("actual_tokens", whole), F.lit(0.0)))
    return rows.withColumn("deviation", F.col("actual_share") - target)


def sized_once(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Sizes kept in the shared folder: both the rates and the sampling read them."""
    return cut(sized_texts(documents, path))
