"""Alignment and matching of ordered lines, boxes and values.

The sequential matchers work on one page at a time with applyInPandas; a page
is bounded by what one photograph holds.
"""

from __future__ import annotations

import difflib
from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAIR_SCHEMA = "page_id string, want_index int, got_index int, want string, got string"


def _clean(s) -> str:
    return "" if s is None else str(s).strip().upper()


def pair_lines(got: list, want: list) -> list[tuple[int | None, int | None]]:
    """(want index, got index) pairs: exact lines first, never crossing, then what
    is left in order; unmatched lines pair with None. Every line appears once."""
    pairs, next_got, free_want = [], 0, []
    places: dict[str, list[int]] = {}
    for i, g in enumerate(got):
        places.setdefault(_clean(g), []).append(i)
    taken = set()
    for wi, w in enumerate(want):
        at = places.get(_clean(w), [])
        n = bisect_left(at, next_got)
        if n == len(at):
            free_want.append(wi)
            continue
        k = at[n]
        pairs.append((wi, k))
        taken.add(k)
        next_got = k + 1
    free_got = [i for i in range(len(got)) if i not in taken]
    both = min(len(free_got), len(free_want))
    pairs += list(zip(free_want[:both], free_got[:both]))
    pairs += [(None, g) for g in free_got[both:]] + [(w, None) for w in free_want[both:]]
    end = (len(want), len(got))
    return sorted(pairs, key=lambda p: (end[0] if p[0] is None else p[0], end[1] if p[1] is None else p[1]))


def difflib_pairs(got: list, want: list) -> list[tuple[int | None, int | None]]:
    """Pairs along the longest matching blocks; replaced lines pair in order."""
    out = []
    m = difflib.SequenceMatcher(None, [_clean(g) for g in got], [_clean(w) for w in want], autojunk=False)
    for _, g0, g1, w0, w1 in m.get_opcodes():
        n = min(g1 - g0, w1 - w0)
        out += [(w0 + i, g0 + i) for i in range(n)]
        out += [(None, g) for g in range(g0 + n, g1)] + [(w, None) for w in range(w0 + n, w1)]
    return out


def align_lines(lines: DataFrame, method: str = "monotone") -> DataFrame:
    """Pairs per page from (page_id, side 'want' or 'got', line_index, text).

    method is monotone or difflib. Spurious lines have a null want_index,
    missed ones a null got_index; null texts align as empty ones.
    """
    pair = {"monotone": pair_lines, "difflib": difflib_pairs}[method]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["line_index", *order], kind="stable")
        want = pdf.loc[pdf["side"] == "want", "text"].tolist()
        got = pdf.loc[pdf["side"] == "got", "text"].tolist()
        page = pdf["page_id"].iloc[0]
        rows = [(page, w, g, None if w is None else want[w], None if g is None else got[g]) for w, g in pair(got, want)]
        out = pd.DataFrame(rows, columns=["page_id", "want_index", "got_index", "want", "got"])
        return out.astype({"want_index": "Int32", "got_index": "Int32"})

    order = [c for c in ("crop_id",) if c in lines.columns]  # breaks ties of the line
    return lines.select("page_id", "side", "line_index", "text", *order).groupBy("page_id").applyInPandas(run, PAIR_SCHEMA)


def iou_1d(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals; 0 when the union is empty."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.coalesce(F.try_divide(inter, (a1 - a0) + (b1 - b0) - inter), F.lit(0.0))


def match_boxes(a: DataFrame, b: DataFrame, least: float = 0.5, cell: int = 64) -> DataFrame:
    """(page_id, a_id, b_id, iou): greedy one-to-one matches of vertical intervals (page_id, id, y0, y1).

    Candidates meet on shared grid cells of ``cell`` units, so intervals of a
    page are not paired wholesale; the greedy choice, best overlap first and
    ids breaking ties, runs per page.
    """
    grid = lambda df: df.select("page_id", "id", "y0", "y1", F.explode(F.sequence(F.floor(F.col("y0") / cell), F.floor(F.col("y1") / cell))).alias("c"))
    x, y = grid(a).alias("x"), grid(b).alias("y")
    met = x.join(y, ["page_id", "c"]).select(
        "page_id", F.col("x.id").alias("a_id"), F.col("y.id").alias("b_id"),
        iou_1d(F.col("x.y0"), F.col("x.y1"), F.col("y.y0"), F.col("y.y1")).alias("iou"),
    ).where(F.col("iou") >= least).distinct()

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["iou", "a_id", "b_id"], ascending=[False, True, True])
        used_a, used_b, keep = set(), set(), []
        for i, (x_id, y_id) in enumerate(zip(pdf["a_id"], pdf["b_id"])):
            if x_id not in used_a and y_id not in used_b:
                used_a.add(x_id)
                used_b.add(y_id)
                keep.append(i)
        return pdf.iloc[keep]

    return met.groupBy("page_id").applyInPandas(greedy, met.schema)


def ordinal_join(a: DataFrame, b: DataFrame, page: str, order_a: str | list[str], order_b: str | list[str], equal_only: bool = True) -> DataFrame:
    """Pairs rows of a page by position. With ``equal_only``, pages whose counts
    differ are dropped; otherwise the longer side is cut."""
    def numbered(df: DataFrame, order: str | list[str], tag: str) -> DataFrame:
        w = Window.partitionBy(page)
        out = df.withColumn("__i", F.row_number().over(w.orderBy(order))).withColumn("__n", F.count("*").over(w))
        return out.select(F.col(page), "__i", F.col("__n").alias(f"__n_{tag}"), F.struct(*[c for c in df.columns if c != page]).alias(tag))

    j = numbered(a, order_a, "a").join(numbered(b, order_b, "b"), [page, "__i"])
    if equal_only:
        j = j.where("__n_a = __n_b")
    return j.select(page, F.col("__i").alias("ordinal"), "a", "b")


def nearest_below(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, label_index, value_index): the line that starts at or below a label's
    lower edge, topmost, then leftmost, then first; the next line where boxes are missing.

    Lines are (page_id, line_index, text, x0, y0, y1), labels (page_id,
    line_index). Labels and lines of a page are sorted together once, from the
    bottom up, and the last line is carried along: no pairs are formed. A line
    of no height is never its own value.
    """
    at = labels.select("page_id", F.col("line_index").alias("label_index")).join(
        lines.select("page_id", F.col("line_index").alias("label_index"), F.col("y1").alias("edge")), ["page_id", "label_index"]
    )
    cand = lines.where(F.trim("text") != "").select("page_id", F.col("line_index").alias("i"), "x0", "y0")
    asks = at.where("edge is not null").select("page_id", F.col("edge").alias("y"), F.lit(1).alias("ask"), "label_index")
    both = cand.select("page_id", F.col("y0").alias("y"), F.lit(0).alias("ask"), "x0", "i").unionByName(asks, allowMissingColumns=True)
    # Below an equal edge the lines come first; of equal lines the leftmost, then first, is the last one seen.
    w = Window.partitionBy("page_id").orderBy(F.desc("y"), "ask", F.desc("x0"), F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    seen = both.withColumn("v", F.last("i", ignorenulls=True).over(w))
    placed = seen.where("ask = 1 and v is not null and v <> label_index").select("page_id", "label_index", F.col("v").alias("value_index"))
    after = at.where("edge is null").withColumn("i", F.col("label_index") + 1).join(cand.select("page_id", "i"), ["page_id", "i"])
    return placed.unionByName(after.select("page_id", "label_index", F.col("i").alias("value_index")))


def last_at_or_before(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, value: str) -> DataFrame:
    """As-of join: each point with the value of the last mark at or before it.

    Points and marks of a key are sorted together once and the last mark is
    carried along, so no pairs are formed.
    """
    both = points.select("*", F.lit(1).alias("__kind"), F.lit(None).alias("__v"), F.col(at).alias("__t")).unionByName(
        marks.select(key, F.lit(0).alias("__kind"), F.struct(F.col(value).alias("v")).alias("__v"), F.col(mark).alias("__t")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("__l", F.last("__v", ignorenulls=True).over(w)).where("__kind = 1").select(*points.columns, F.col("__l.v").alias(value))


def bag_overlap(a: DataFrame, b: DataFrame, key: str, word: str = "word") -> DataFrame:
    """(key, common, recall, precision): words in common with repeats, order aside; a is the truth."""
    x = a.groupBy(key, word).agg(F.count("*").alias("na"))
    y = b.groupBy(key, word).agg(F.count("*").alias("nb"))
    j = x.join(y, [key, word], "full_outer").fillna(0, ["na", "nb"])
    out = j.groupBy(key).agg(F.sum(F.least("na", "nb")).alias("common"), F.sum("na").alias("a"), F.sum("nb").alias("b"))
    rate = lambda n: F.coalesce(F.try_divide("common", n), F.lit(0.0))
    return out.select(key, "common", rate("a").alias("recall"), rate("b").alias("precision"))


def reading_order(lines: DataFrame) -> DataFrame:
    """(page_id, text): lines of a page joined top to bottom, then left to right."""
    rows = F.array_sort(F.collect_list(F.struct("y0", "x0", "line_index", "text")))
    return lines.groupBy("page_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("text"))


def consensus(aligned: DataFrame, most: float = 0.35) -> DataFrame:
    """Pairs of align_lines whose label-form error rate is at most ``most``: lines two readings agree on."""
    from foliolake.functions.metrics import cer_label

    both = aligned.where("want is not null and got is not null")
    return both.withColumn("cer", cer_label(F.col("want"), F.col("got"))).where(F.col("cer") <= most)


def carrier_lines(values: DataFrame, lines: DataFrame) -> DataFrame:
    """(page_id, value, line_index): the first line of the page that holds the value in scoring form.

    Lines of a page are gathered once; values look through that list, so a
    page's values and lines are never expanded into pairs.
    """
    from foliolake.functions.text import norm

    listed = lines.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("line_index", norm(F.col("text")).alias("t")))).alias("ls"))
    v = norm(F.col("value"))
    hits = F.filter("ls", lambda x: (F.length(v) > 0) & F.contains(x["t"], v))
    return values.join(listed, "page_id").select("page_id", "value", F.try_element_at(hits, F.lit(1))["line_index"].alias("line_index")).where("line_index is not null")


def local_confidence(fields: DataFrame, words: DataFrame) -> DataFrame:
    """(page_id, field, confidence): least confidence of the words that stand in a field's value; none gives 0."""
    bag = words.groupBy("page_id", F.upper("word").alias("w")).agg(F.min(F.nanvl(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0))).alias("c"))
    parts = fields.select("page_id", "field", F.explode_outer(F.filter(F.split(F.upper("value"), r"\s+"), lambda x: x != "")).alias("w"))
    return parts.join(bag, ["page_id", "w"], "left").groupBy("page_id", "field").agg(F.coalesce(F.min("c"), F.lit(0.0)).alias("confidence"))


def flatten_panels(df: DataFrame, key: str, sections: str, order: list[str], least: int = 4, cap: int = 60) -> DataFrame:
    """(key, line, text): a map of sections as numbered lines in the given order, at most ``cap`` per key."""
    listed = F.concat(*[F.when(F.col(sections)[n].isNotNull(), F.array(F.col(sections)[n])).otherwise(F.array().cast("array<string>")) for n in order])
    lines = F.filter(F.flatten(F.transform(listed, lambda t: F.split(t, "\n"))), lambda t: F.length(F.trim(t)) >= least)
    return df.select(key, F.posexplode(F.slice(F.transform(lines, lambda t: F.trim(t)), 1, cap)).alias("line", "text"))
