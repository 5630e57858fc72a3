"""Error rates, set and multiset accuracies, intervals and paired tests.

Five character error rates are in use and differ in normal form and in what an
empty reference scores; they share one primitive and keep their names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolake.functions.text import comparison_form, norm, norm_label, words

#: Two-sided 95 %.
Z = 1.959963984540054


def edits(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


#: Normal forms in which texts are compared, by name.
FORMS = {"label": norm_label, "bench": norm, "receipt": comparison_form, "raw": lambda c: c}


def with_distances(df: DataFrame, ref: str, hyp: str, forms: tuple[str, ...] = tuple(FORMS)) -> DataFrame:
    """``df`` with, per form, the lengths and the edit distance: n_<form>, m_<form>, d_<form>.

    Each normal form is made once and each pair compared once, whatever rates
    are taken from it afterwards. Null texts count as empty.
    """
    made = {f"{side}_{f}": FORMS[f](_blank(F.col(c))) for f in forms for side, c in (("__a", ref), ("__b", hyp))}
    rows = df.select("*", *[c.alias(n) for n, c in made.items()])
    # Exact at any length: first within a narrow band, then a wider one, then in full. Each step
    # is a projection of its own, so that no distance is taken twice.
    for width in (1, 3, 0):
        step = {}
        for f in forms:
            x, y, d = F.col(f"__a_{f}"), F.col(f"__b_{f}"), F.col(f"d_{f}")
            band = (F.lit(24) + F.floor(F.length(x) / 24).cast("int")) * width
            here = F.call_function("levenshtein", x, y, band) if width else F.levenshtein(x, y)
            step[f"d_{f}"] = here if width == 1 else F.when(d >= 0, d).otherwise(here)
        rows = rows.withColumns(step)
    sizes = {f"{n}_{f}": F.length(F.col(f"{side}_{f}")) for f in forms for n, side in (("n", "__a"), ("m", "__b"))}
    return rows.select(*df.columns, *[c.alias(n) for n, c in sizes.items()], *[f"d_{f}" for f in forms])


def edits_capped(a: Column, b: Column, cap: int) -> Column:
    """Edit distance, or cap + 1 for anything above the cap."""
    d = F.levenshtein(a, b, cap)
    return F.when(d < 0, cap + 1).otherwise(d)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def cer_bench(ref: Column, hyp: Column) -> Column:
    """Scoring form; an empty reference scores the hypothesis' length."""
    r, h = norm(_blank(ref)), norm(_blank(hyp))
    return F.when(F.length(r) == 0, F.length(h).cast("double")).otherwise(edits(r, h) / F.length(r))


def cer_label(ref: Column, hyp: Column) -> Column:
    """Label form; an empty reference scores 0 or 1."""
    r, h = norm_label(_blank(ref)), norm_label(_blank(hyp))
    return F.when(F.length(r) == 0, (F.length(h) > 0).cast("double")).otherwise(edits(r, h) / F.length(r))


def cer_aggregate(ref: Column, hyp: Column) -> Column:
    """Aggregate over rows: edits over characters in label form; an empty reference counts one character."""
    r, h = norm_label(_blank(ref)), norm_label(_blank(hyp))
    return F.sum(edits(r, h)) / F.sum(F.greatest(F.length(r), F.lit(1)))


def cer_repair(ref: Column, hyp: Column) -> Column:
    """Texts as they are."""
    return edits(_blank(ref), _blank(hyp)) / F.greatest(F.length(_blank(ref)), F.lit(1))


def cer_receipt(ref: Column, hyp: Column) -> Column:
    """Upper case, blanks collapsed; undefined (null) for an empty reference."""
    r, h = comparison_form(_blank(ref)), comparison_form(_blank(hyp))
    return F.try_divide(edits(r, h), F.length(r))


def bound(f, *cols: Column) -> Column:
    """f(*cols) with each column evaluated once: inside a lambda an outer expression would be evaluated for every element."""
    names = [f"c{i}" for i in range(len(cols))]
    one = F.transform(F.array(F.struct(*[c.alias(n) for c, n in zip(cols, names)])), lambda s: f(*[s[n] for n in names]))
    return F.element_at(one, 1)


def word_accuracy(ref: Column, hyp: Column) -> Column:
    """Share of reference words, repeats counted, whose scoring form is among the hypothesis' words.

    0 for a reference without words. Words of punctuation only have the empty
    form, which may match another such word.
    """
    strip = lambda w: norm(w)
    g, h = F.transform(words(_blank(ref)), strip), F.transform(words(_blank(hyp)), strip)
    share = lambda g, h: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(F.size(F.filter(g, lambda w: F.array_contains(h, w))) / F.size(g))
    return bound(share, g, h)


def set_word_accuracy(ref: Column, hyp: Column) -> Column:
    """Share of the reference's distinct words found; 1 for none."""
    g, h = F.array_distinct(words(_blank(ref))), F.array_distinct(words(_blank(hyp)))
    return F.when(F.size(g) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(g, h)) / F.size(g))


def multiset_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays with repeats."""
    common = lambda a, b: F.aggregate(
        F.array_distinct(a),
        F.lit(0),
        lambda n, w: n + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))),
    )
    return bound(common, a, b)


def exact_label(ref: Column, hyp: Column) -> Column:
    return norm_label(_blank(ref)) == norm_label(_blank(hyp))


def exact_strict(ref: Column, hyp: Column) -> Column:
    return F.upper(F.trim(_blank(ref))) == F.upper(F.trim(_blank(hyp)))


def recovered(expected: Column, got: Column) -> Column:
    """Equal in scoring form, or the found value has four characters or more and ends the expected one."""
    e, g = norm(expected), norm(got)
    return (F.length(e) > 0) & (F.length(g) > 0) & ((e == g) | ((F.length(g) >= 4) & F.endswith(e, g)))


def recovered_count(expected: Column, got: Column) -> Column:
    """How many expected values some found value recovers; null lists are empty."""
    none = F.array().cast("array<string>")
    g = F.coalesce(got, none)
    return F.size(F.filter(F.coalesce(expected, none), lambda e: F.exists(g, lambda x: recovered(e, x))))


def matches_value(a: Column, b: Column) -> Column:
    """Equal in scoring form, or one of at least four characters inside the other."""
    x, y = norm(a), norm(b)
    inside = ((F.length(x) >= 4) & y.contains(x)) | ((F.length(y) >= 4) & x.contains(y))
    return (F.length(x) > 0) & (F.length(y) > 0) & ((x == y) | inside)


def wilson(k: Column, n: Column, z: float = Z) -> Column:
    """struct(low, high) of a binomial share; (0, 0) without trials."""
    n_, k_ = n.cast("double"), k.cast("double")
    p = k_ / n_
    d = 1.0 + F.lit(z * z) / n_
    centre = (p + F.lit(z * z / 2) / n_) / d
    half = F.lit(z) * F.sqrt(p * (1.0 - p) / n_ + F.lit(z * z / 4) / (n_ * n_)) / d
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    live = n_ > 0
    return F.struct(F.when(live, low).otherwise(0.0).alias("low"), F.when(live, high).otherwise(0.0).alias("high"))


def overlaps(a: Column, b: Column) -> Column:
    """Do two struct(low, high) intervals overlap? True when either is null."""
    return F.coalesce((a["low"] <= b["high"]) & (b["low"] <= a["high"]), F.lit(True))


def successes(value: Column, n: Column) -> Column:
    """round(value * n) to even, kept within 0..n."""
    return F.greatest(F.lit(0), F.least(n.cast("long"), F.bround(value * n).cast("long")))


@F.pandas_udf(T.DoubleType())
def mcnemar_exact(b: pd.Series, c: pd.Series) -> pd.Series:
    """Exact two-sided p of b against c discordant pairs, in whole numbers throughout.

    Runs on aggregated counts: one row per comparison.
    """

    def p(x, y) -> float:
        if pd.isna(x) or pd.isna(y):
            return math.nan
        x, y = int(x), int(y)
        n, term, tail = x + y, 1, 0
        for i in range(min(x, y) + 1):
            tail += term
            term = term * (n - i) // (i + 1)
        return 1.0 if n == 0 else min(1.0, 2 * tail / (1 << n))

    return pd.Series([p(x, y) for x, y in zip(b, c)], dtype="float64")


def verdict(method: Column, delta: Column, higher_better: Column, p: Column, old_ci: Column, new_ci: Column, alpha: float = 0.05) -> Column:
    """IMPROVED, REGRESSED or INCONCLUSIVE; a zero difference never wins."""
    side = F.when((delta > 0) == higher_better, "IMPROVED").otherwise("REGRESSED")
    clear = F.when(method == "mcnemar", F.coalesce(p <= alpha, F.lit(False))).when(method == "wilson", ~overlaps(old_ci, new_ci)).otherwise(False)
    return F.when(clear & (delta != 0), side).otherwise("INCONCLUSIVE")
