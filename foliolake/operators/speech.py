"""Cutting text to pieces of bounded length."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"[\s\S]+?(?:[.!?](?:\s+|$)|[。！？]|$)")


def chunk(text: str | None, most: int = 180) -> list[str]:
    """Whole sentences packed greedily up to ``most`` characters; a longer sentence is cut hard."""
    src = re.sub(r"\s+", " ", text or "").strip()
    out: list[str] = []
    held = ""
    for s in _SENTENCE.findall(src):
        joined = f"{held} {s}".strip()
        if len(joined) <= most:
            held = joined
            continue
        if held:
            out.append(held)
        held = s.strip() if len(s) <= most else ""
        if len(s) > most:
            out += [s[i : i + most] for i in range(0, len(s), most)]
    return out + [held] if held else out


def chunks(text: Column, most: int = 180) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t, most))

    return run(text)


def wrapped(text: Column, width: int = 28) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: textwrap.wrap(t or "", width))

    return run(text)


def pack_pages(lines: DataFrame, key: str, order: str, per_page: int) -> DataFrame:
    """Adds page: lines of a key in order, ``per_page`` to a page."""
    return lines.withColumn("page", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / per_page))
