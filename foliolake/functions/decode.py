"""Sequence decoding and vector functions on arrays."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The recogniser's alphabet; class 0 is the blank.
CHARSET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ "
BLANK = 0
#: The largest exponent step the log domain treats as nothing.
_FLOOR = -1e30


def encode(text: Column) -> Column:
    """Class numbers of the characters in the alphabet; others are left out."""
    pos = F.transform(F.split(text, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(CHARSET), c)))
    return F.filter(pos, lambda p: p > 0)


def decode_greedy(classes: Column, limit: int | None = None) -> Column:
    """Repeats collapsed, then blanks dropped. ``limit`` cuts the sequence first, not the output."""
    seq = F.slice(classes, 1, limit) if limit is not None else classes
    before = F.concat(F.array(F.lit(-1)), F.slice(seq, 1, F.greatest(F.size(seq) - 1, F.lit(0))))
    kept = F.filter(F.zip_with(seq, before, lambda c, p: F.when((c != p) & (c != BLANK), c)), lambda c: c.isNotNull())
    return F.array_join(F.transform(kept, lambda c: F.substring(F.lit(CHARSET), c.cast("int"), F.lit(1))), "")


def argmax_path(scores: Column) -> Column:
    """Best class of every step of an array of score arrays; the first of equals."""
    return F.transform(scores, lambda row: (F.array_position(row, F.array_max(row)) - 1).cast("int"))


def softmax(v: Column) -> Column:
    e = F.transform(v, lambda x: F.exp(x - F.array_max(v)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def log_softmax(v: Column) -> Column:
    top = F.array_max(v)
    total = F.log(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    return F.transform(v, lambda x: x - total)


def mask_scores(row: Column, allowed: list[int]) -> Column:
    """Scores of classes outside ``allowed`` (the blank always stays) become minus infinity."""
    ok = F.array(*[F.lit(i) for i in sorted({BLANK, *allowed})])
    return F.transform(row, lambda x, i: F.when(F.array_contains(ok, i), x).otherwise(F.lit(float("-inf"))))


def l2_normalise(v: Column) -> Column:
    """Unit vector; the zero vector stays."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(length > 0, x / length).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def path_confidence(scores: Column) -> Column:
    """Mean best probability over the steps that yield a character; 0 if none does.

    Rows that don't sum to one are taken as raw scores and normalised first.
    """
    total = lambda row: F.aggregate(row, F.lit(0.0), lambda a, x: a + x)
    probs = F.transform(scores, lambda row: F.when(F.abs(total(row) - 1.0) < 1e-3, row).otherwise(softmax(row)))
    path = argmax_path(probs)
    best = F.transform(probs, lambda row: F.array_max(row))
    before = F.concat(F.array(F.lit(-1)), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))
    keep = F.zip_with(path, before, lambda c, p: (c != p) & (c != BLANK))
    kept = F.filter(F.zip_with(best, keep, lambda b, k: F.when(k, b)), lambda x: x.isNotNull())
    return F.when(F.size(kept) == 0, F.lit(0.0)).otherwise(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept))


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    if a < b:
        a, b = b, a
    return a if b <= _FLOOR else a + math.log1p(math.exp(b - a))


def beam_decode(log_probs: np.ndarray, beam: int = 4, score: Callable[[str, str], float] | None = None, alpha: float = 0.25) -> str:
    """Prefix beam search over (steps, classes) log probabilities.

    ``score(prefix, char)`` adds ``alpha`` times a language model's log
    probability when a prefix grows; equal scores keep the older prefix.
    Without one, only a row's best classes, a prefix's last character and the
    prefixes already held can survive a step, so no others are grown.
    """
    beams: dict[str, tuple[float, float]] = {"": (0.0, _FLOOR)}
    for row in np.asarray(log_probs, dtype=float).tolist():
        grown: dict[str, tuple[float, float]] = {}

        def put(prefix: str, blank: float, char: float) -> None:
            b, c = grown.get(prefix, (_FLOOR, _FLOOR))
            grown[prefix] = (_add(b, blank), _add(c, char))

        classes = range(1, len(row))
        best = set(classes) if score else set(sorted(classes, key=lambda k: -row[k])[: beam + 1])
        held = {p[:-1]: set() for p in beams if p}
        for p in beams:
            if p:
                held[p[:-1]].add(CHARSET.index(p[-1]) + 1)
        for prefix, (b, c) in beams.items():
            put(prefix, _add(b, c) + row[BLANK], _FLOOR)
            for k in sorted(best | held.get(prefix, set()) | ({CHARSET.index(prefix[-1]) + 1} if prefix else set())):
                if row[k] <= _FLOOR or math.isinf(row[k]):
                    continue
                ch = CHARSET[k - 1]
                bonus = alpha * score(prefix, ch) if score else 0.0
                if prefix and prefix[-1] == ch:
                    put(prefix, _FLOOR, c + row[k])
                    put(prefix + ch, _FLOOR, b + row[k] + bonus)
                else:
                    put(prefix + ch, _FLOOR, _add(b, c) + row[k] + bonus)
        beams = dict(sorted(grown.items(), key=lambda x: -_add(*x[1]))[:beam])
    return max(beams.items(), key=lambda x: _add(*x[1]))[0]


def beam_rows(df: DataFrame, key: str, scores: str, beam: int = 4, grams: dict[str, float] | None = None, alpha: float = 0.25) -> DataFrame:
    """(key, decoded): beam search over an array<array<double>> column, in Arrow batches.

    ``grams`` maps context + character to a log probability (a small
    character model, shipped with the function); unknown pairs score -8. A
    null array gives null, an array without steps the empty string.
    """

    def lm(prefix: str, ch: str) -> float:
        return grams.get(prefix[-1:] + ch, -8.0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            decoded = [
                None if r is None else beam_decode(np.array([list(x) for x in r], dtype=float), beam, lm if grams else None, alpha) if len(r) else ""
                for r in pdf[scores]
            ]
            yield pd.DataFrame({key: pdf[key], "decoded": decoded})

    return df.select(key, scores).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, decoded string")
