"""Sizes in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary lies by default; every function takes the path as a parameter.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encodings: dict[int, object] = {}


def encoding(raw: bytes):
    import tiktoken

    key = hash(raw)
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_count(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """Number of tokens of ``text`` (null for null).

    The vocabulary file, under 2 MB, is read on the driver and broadcast, so
    executors need no copy of it.
    """
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 8_000_000:
        raise ValueError("vocabulary files are broadcast and must stay under 8 MB")
    shared = spark.sparkContext.broadcast(raw)

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(shared.value)
        for texts in batches:
            yield pd.Series([None if t is None else len(enc.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(text)
