"""Scoring of recognition records, grouped reports and run-against-run comparison.

A record table has (doc, profile, expected_category, category,
expected_fields, fields, expected_text, ocr_text, ocr_confidence, error).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions import metrics
from foliolake.functions.text import norm_label

#: Profiles no human can read; reported, but kept out of headlines.
SUB_HUMAN = ("worst_case",)


def record_scores(records: DataFrame) -> DataFrame:
    """One row per record with its scores; failed records score 0 but keep their denominators.

    Adds failed, n_expected, n_recovered, class_ok, word_acc, cer. Null texts
    count as empty, null lists as empty, a null category is never right. An
    empty table gives an empty table.
    """
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    live = lambda c: F.when(failed, F.lit(0.0)).otherwise(c)
    cer = F.when(F.col("n_bench") == 0, F.col("m_bench").cast("double")).otherwise(F.col("d_bench") / F.col("n_bench"))
    return metrics.with_distances(records, "expected_text", "ocr_text", ("bench",)).select(
        *records.columns,
        failed.alias("failed"),
        F.size(F.coalesce("expected_fields", F.array().cast("array<string>"))).alias("n_expected"),
        F.when(failed, 0).otherwise(metrics.recovered_count(F.col("expected_fields"), F.col("fields"))).alias("n_recovered"),
        (~failed & F.coalesce(F.col("category") == F.col("expected_category"), F.lit(False))).cast("int").alias("class_ok"),
        live(metrics.word_accuracy(F.col("expected_text"), F.col("ocr_text"))).alias("word_acc"),
        live(cer).alias("cer"),
    )


def _rates() -> list:
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        F.sum(F.col("failed").cast("long")).alias("errors"),
        F.coalesce(F.try_divide(F.sum("n_recovered"), F.sum("n_expected")), F.lit(0.0)).alias("field_recovery"),
        F.avg("class_ok").alias("classification"),
        F.avg("word_acc").alias("word_accuracy"),
        F.avg("cer").alias("cer"),
    ]


def by_profile(scores: DataFrame) -> DataFrame:
    """Rates per profile (scope 'profile'), for all, headline (readable profiles) and sub_human.

    One pass: each record is expanded to the scopes it belongs to, then
    grouped once. Field recovery is a ratio of sums, the rest are means.
    """
    poor = F.coalesce(F.col("profile").isin(*SUB_HUMAN), F.lit(False))
    scopes = F.array(
        F.struct(F.lit("all").alias("scope"), F.lit(None).cast("string").alias("p")),
        F.struct(F.lit("profile").alias("scope"), F.col("profile").alias("p")),
        F.struct(F.when(poor, "sub_human").otherwise("headline").alias("scope"), F.lit(None).cast("string").alias("p")),
    )
    slim = scores.select("failed", "n_recovered", "n_expected", "class_ok", "word_acc", "cer", F.explode(scopes).alias("s"))
    return slim.groupBy(F.col("s.scope").alias("scope"), F.col("s.p").alias("profile")).agg(*_rates())


def grouping_set_rates(scores: DataFrame) -> DataFrame:
    """The same rates for every profile and the grand total, as GROUPING SETS."""
    return (
        scores.groupingSets([[F.col("profile")], []], F.col("profile"))
        .agg(F.grouping("profile").cast("int").alias("is_total"), *_rates())
    )


def arm_means(long: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """Mean per key, rounded half to even; null means stay null."""
    return long.groupBy(*keys).agg(F.bround(F.avg(value), digits).alias("mean"), F.count(value).alias("n"))


def mean_of_means(means: DataFrame, keys: list[str], digits: int = 4) -> DataFrame:
    """Mean of the already rounded per-profile means, unreadable profiles left out."""
    kept = means.where(~F.coalesce(F.col("profile").isin(*SUB_HUMAN), F.lit(False)))
    return kept.groupBy(*keys).agg(F.bround(F.avg("mean"), digits).alias("headline"), F.count("*").alias("n_profiles"))


def confusion_counts(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """(truth, guess, n) in long form; null guesses count as '(none)', null truths are left out."""
    return (
        df.where(F.col(truth).isNotNull())
        .groupBy(F.col(truth).alias("truth"), F.coalesce(guess, F.lit("(none)")).alias("guess"))
        .agg(F.count("*").alias("n"))
    )


def class_report(confusion: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) per truth label; undefined rates are 0."""
    sides = confusion.select(F.explode(F.array(
        F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col("guess").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")),
    )).alias("s"), (F.col("truth") == F.col("guess")).alias("hit"), "n")
    per = sides.groupBy(F.col("s.label").alias("label")).agg(
        F.sum("s.support").alias("support"),
        F.sum("s.claimed").alias("claimed"),
        F.sum(F.when(F.col("hit") & (F.col("s.support") > 0), F.col("n")).otherwise(0)).alias("right"),
    ).where("support > 0")
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = per.select("label", "support", rate("right", "claimed").alias("precision"), rate("right", "support").alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def macro_f1(report: DataFrame) -> DataFrame:
    """(accuracy, macro_f1): plain mean over labels, and recall weighted by support."""
    return report.agg(
        F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1")
    )


def occurrence_ids(df: DataFrame, keys: list[str], order: list[str], out: str = "uid") -> DataFrame:
    """``key|key#i``, i counting repeats of the key in the given order from 0."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return df.withColumn(out, F.concat(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), F.lit("#"), rn.cast("string")))


def item_outcomes(scores: DataFrame) -> DataFrame:
    """(metric, item, ok): one item per record for classification, one per expected field for recovery."""
    records = scores.select(
        F.lit("classification").alias("metric"), F.col("uid").alias("item"), (F.col("class_ok") == 1).alias("ok")
    )
    got = F.coalesce("fields", F.array().cast("array<string>"))
    fields = scores.select("uid", "failed", got.alias("got"), F.posexplode("expected_fields").alias("j", "e"))
    found = ~F.col("failed") & F.exists("got", lambda g: metrics.recovered(F.col("e"), g))
    return records.unionByName(
        fields.select(
            F.lit("field_recovery").alias("metric"),
            F.concat(F.col("uid"), F.lit("#f"), F.col("j").cast("string")).alias("item"),
            F.coalesce(found, F.lit(False)).alias("ok"),
        )
    )


def compare_runs(old: DataFrame, new: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row per metric of two item tables (metric, item, ok), higher being better.

    The item sets license a paired exact test only when they are equal;
    otherwise the intervals decide, and a metric of one run only is N/A.
    Items must be unique per metric (use occurrence_ids).
    """
    a = old.select("metric", "item", F.col("ok").alias("o"), F.lit(True).alias("in_o"))
    b = new.select("metric", "item", F.col("ok").alias("w"), F.lit(True).alias("in_w"))
    both = a.join(b, ["metric", "item"], "full_outer")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = both.groupBy("metric").agg(
        one(F.col("in_o")).alias("n_old"),
        one(F.col("in_w")).alias("n_new"),
        one(F.col("o")).alias("k_old"),
        one(F.col("w")).alias("k_new"),
        F.bool_and(F.col("in_o").isNotNull() & F.col("in_w").isNotNull()).alias("same_items"),
        one(F.col("o") & ~F.col("w")).alias("lost"),
        one(~F.col("o") & F.col("w")).alias("won"),
    )
    per = per.withColumn(
        "method",
        F.when((F.col("n_old") == 0) | (F.col("n_new") == 0), "none").when(F.col("same_items"), "mcnemar").otherwise("wilson"),
    )
    per = (
        per.withColumn("old_rate", F.try_divide("k_old", "n_old"))
        .withColumn("new_rate", F.try_divide("k_new", "n_new"))
        .withColumn("old_ci", metrics.wilson(F.col("k_old"), F.col("n_old")))
        .withColumn("new_ci", metrics.wilson(F.col("k_new"), F.col("n_new")))
        .withColumn("p", F.when(F.col("method") == "mcnemar", metrics.mcnemar_exact("lost", "won")))
    )
    judged = metrics.verdict(F.col("method"), F.col("new_rate") - F.col("old_rate"), F.lit(True), F.col("p"), F.col("old_ci"), F.col("new_ci"), alpha)
    only = F.when(F.col("n_old") == 0, "N/A (only in new)").when(F.col("n_new") == 0, "N/A (only in old)")
    return per.withColumn("verdict", F.coalesce(only, judged))


def discordance(pairs: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """The four cells of two boolean columns per key."""
    x, y = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    cell = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    return pairs.groupBy(*keys).agg(cell(x & y, "both"), cell(x & ~y, "only_a"), cell(~x & y, "only_b"), cell(~x & ~y, "neither"))


def char_confusions(lines: DataFrame, ref: str, hyp: str) -> DataFrame:
    """(ch, n): in how many wrong lines each distinct reference character stands."""
    wrong = lines.where(norm_label(F.col(ref)) != norm_label(F.coalesce(hyp, F.lit(""))))
    chars = F.filter(F.array_distinct(F.split(norm_label(F.col(ref)), "")), lambda c: c != "")
    return wrong.select(F.explode(chars).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))


def seed_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, population deviation, least and most of a value per key."""
    return df.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most")
    )


def second_reader(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Agreement of two readers per key: agree, differ, only_first, only_second (full outer)."""
    from foliolake.functions.text import norm

    x = a.select(*keys, F.col(value).alias("va"))
    y = b.select(*keys, F.col(value).alias("vb"))
    kind = (
        F.when(F.col("vb").isNull(), "only_first")
        .when(F.col("va").isNull(), "only_second")
        .when(norm(F.col("va")) == norm(F.col("vb")), "agree")
        .otherwise("differ")
    )
    return x.join(y, keys, "full_outer").withColumn("kind", kind)


def value_hits(said: DataFrame, truth: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, spoken, truths, hits, recovered, wrong): values against a page's true ones, both ways.

    A hit is a said value that matches some truth, recovered counts matched
    truths, wrong is the rest of the said ones (the anti join). Lists are
    gathered per page, so pages meet once and no pairs leave a row.
    """
    gather = lambda df, name: df.groupBy(key).agg(F.collect_list(value).alias(name))
    none = F.array().cast("array<string>")
    j = gather(said, "s").join(gather(truth, "t"), key, "full_outer").withColumn("s", F.coalesce("s", none)).withColumn("t", F.coalesce("t", none))
    hits = F.size(F.filter("s", lambda a: F.exists("t", lambda b: metrics.matches_value(a, b))))
    found = F.size(F.filter("t", lambda b: F.exists("s", lambda a: metrics.matches_value(a, b))))
    return j.select(key, F.size("s").alias("spoken"), F.size("t").alias("truths"), hits.alias("hits"), found.alias("recovered"), (F.size("s") - hits).alias("wrong"))


def precision_recall(hits: DataFrame) -> DataFrame:
    """One row over value_hits: precision of what was said, recall of what was true; 0 where undefined."""
    rate = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    return hits.agg(rate("hits", "spoken").alias("precision"), rate("recovered", "truths").alias("recall"), F.coalesce(F.sum("wrong"), F.lit(0)).alias("wrong"))


def wrong_values(said: DataFrame, truth: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(key, value) that match no truth of their page; pages without truths have all of theirs."""
    t = truth.groupBy(key).agg(F.collect_list(value).alias("t"))
    return said.join(t, key, "left").where(~F.coalesce(F.exists("t", lambda b: metrics.matches_value(F.col(value), b)), F.lit(False))).select(key, value)


def gated_precision(df: DataFrame, keep, right) -> DataFrame:
    """Rows scanned and kept, and how often each is right; the two are counted apart."""
    k, r = F.coalesce(keep, F.lit(False)), F.coalesce(right, F.lit(False))
    return df.agg(
        F.count("*").alias("scanned"), F.sum(k.cast("long")).alias("kept"), F.avg(r.cast("int")).alias("scanned_precision"),
        F.coalesce(F.avg(F.when(k, r.cast("int"))), F.lit(0.0)).alias("kept_precision"),
    )


def line_metrics(aligned: DataFrame) -> DataFrame:
    """Per page of align_lines: cer, detection_recall, exact lines, missed and spurious.

    Missed lines add their characters to the denominator but no edits, as
    the original definition has it.
    """
    both = F.col("want").isNotNull() & F.col("got").isNotNull()
    w = norm_label(F.coalesce("want", F.lit("")))
    d = F.when(both, metrics.edits(w, norm_label(F.coalesce("got", F.lit(""))))).otherwise(0)
    count = lambda c: F.sum(c.cast("long"))
    paired, missed = F.col("want_index").isNotNull() & F.col("got_index").isNotNull(), F.col("got_index").isNull()
    return aligned.groupBy("page_id").agg(
        F.coalesce(F.try_divide(F.sum(d), F.sum(F.when(F.col("want_index").isNotNull(), F.greatest(F.length(w), F.lit(1))).otherwise(0))), F.lit(0.0)).alias("cer"),
        F.coalesce(F.try_divide(count(paired), count(paired | missed)), F.lit(0.0)).alias("detection_recall"),
        count(both & (metrics.exact_strict(F.col("want"), F.col("got")))).alias("exact_lines"), count(missed).alias("missed"),
        count(F.col("want_index").isNull()).alias("spurious"),
    )


def edit_pairs(ref: str, hyp: str) -> list[tuple[str, str]]:
    """(true, read) characters of one optimal alignment, '' for a lost or invented one; substitutions before losses."""
    n, m = len(ref), len(hyp)
    t = np.zeros((n + 1, m + 1), dtype=np.int32)
    t[:, 0], t[0, :] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i, j] = min(t[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]), t[i - 1, j] + 1, t[i, j - 1] + 1)
    out, i, j = [], n, m
    while i or j:
        if i and j and t[i, j] == t[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append((ref[i], hyp[j]))
        elif i and t[i, j] == t[i - 1, j] + 1:
            i -= 1
            out.append((ref[i], ""))
        else:
            j -= 1
            out.append(("", hyp[j]))
    return out[::-1]


def confusion_pairs(lines: DataFrame, ref: str, hyp: str) -> DataFrame:
    """(true, read, n) over all aligned lines, equal characters included. Meant for lines: the alignment is quadratic in length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [p for a, b in zip(pdf["a"], pdf["b"]) for p in edit_pairs(a, b)]
            yield pd.DataFrame(rows, columns=["true", "read"])

    slim = lines.select(F.coalesce(ref, F.lit("")).alias("a"), F.coalesce(hyp, F.lit("")).alias("b"))
    return slim.mapInPandas(run, "true string, read string").groupBy("true", "read").agg(F.count("*").alias("n"))


def bootstrap_ci(df: DataFrame, key: str, value: str, resamples: int = 4000, seed: int = 0) -> DataFrame:
    """(key, mean, low, high): percentile interval of the mean over resampled items.

    Only counts of distinct values reach a group's task, and a resample is a
    multinomial draw over them, so a group may be of any size.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v")
        v, n = pdf["v"].to_numpy(), pdf["n"].to_numpy()
        total = int(n.sum())
        means = np.random.default_rng(seed).multinomial(total, n / total, size=resamples) @ v / total
        low, high = np.percentile(means, [2.5, 97.5])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "mean": [float(v @ n / total)], "low": [low], "high": [high]})

    return counts.groupBy(key).applyInPandas(run, f"{key} {dict(df.dtypes)[key]}, mean double, low double, high double")


def elect_best(candidates: DataFrame, key: str, structure: str, confidence: str, rank: str, text: str) -> DataFrame:
    """Per key the candidate with most structure, then confidence, then least rank; empty texts don't stand."""
    order = F.struct(F.col(structure), F.nanvl(F.coalesce(F.col(confidence).cast("double"), F.lit(0.0)), F.lit(0.0)), -F.col(rank))
    rows = F.struct(*[c for c in candidates.columns if c != key])
    return candidates.where(F.trim(F.coalesce(text, F.lit(""))) != "").groupBy(key).agg(F.max_by(rows, order).alias("b")).select(key, "b.*")


def best_variant(variants: DataFrame, key: str) -> DataFrame:
    """Per key the (name, exact, cer) with most exact, then least cer, then first name."""
    return variants.groupBy(key).agg(F.min_by("name", F.struct((-F.col("exact")).alias("e"), "cer", "name")).alias("name"))


def top_k(df: DataFrame, value: str, k: int) -> DataFrame:
    """(value, n) of the k most frequent values, ties by value (a report of fixed size)."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


def count_maps(df: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, counts): a map of how often each kind stands per key, merged from partial counts."""
    per = df.groupBy(key, kind).agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "n")))).alias("counts"))


def ratio_profile(df: DataFrame, key: str, ratio, low: float = 0.85, high: float = 1.15) -> DataFrame:
    """(key, p10, p50, p90, inside): percentiles of a ratio and the share within bounds."""
    r = df.withColumn("__r", ratio.cast("double"))
    q = lambda p: F.percentile("__r", F.lit(p))
    return r.groupBy(key).agg(q(0.1).alias("p10"), q(0.5).alias("p50"), q(0.9).alias("p90"), F.avg(F.col("__r").between(low, high).cast("int")).alias("inside"))
