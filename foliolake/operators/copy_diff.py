"""Field-by-field differences between two copies of a keyed table.

Every key of either side gets a shared ordinal (hash bucket, then dense rank
inside the bucket, so no global sort and no driver involvement). Presence per
side is a set of 32,768-bit bitmap blocks; empty blocks do not exist, which is
the compression. AND-NOT of two blocks yields the ordinals missing on a side,
AND yields the ordinals to compare, and the comparison is aligned by ordinal.
Values travel as 128-bit digests of their canonical form, never as texts.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foliolake.operators.current import newest
from foliolake.session import parallelism

#: Ordinals of one hash bucket start at bucket * 2**32; blocks hold 2**15 bits.
BUCKET_BITS = 32
BLOCK_BITS = 32768


def canonical_list(col: Column) -> Column:
    """A list as an order-free, repeat-keeping string; null equals empty."""
    parts = F.transform(F.coalesce(col, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("\x00")))
    return F.concat_ws("\x1f", F.array_sort(parts))


def canonical_text(col: Column) -> Column:
    """CR LF as LF, no blanks at line ends; null equals empty."""
    text = F.replace(F.coalesce(col, F.lit("")), F.lit("\r\n"), F.lit("\n"))
    return F.regexp_replace(text, r"[ \t]+(?=\n|\z)", "")


@F.pandas_udf(
    T.StructType(
        [
            T.StructField("only_left", T.ArrayType(T.LongType())),
            T.StructField("only_right", T.ArrayType(T.LongType())),
            T.StructField("both", T.ArrayType(T.LongType())),
        ]
    )
)
def _block_algebra(block: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """AND-NOT both ways and AND of two presence blocks, as ordinals."""
    zero = bytes(BLOCK_BITS // 8)
    rows = []
    for b, x, y in zip(block, left, right):
        a = np.frombuffer(zero if x is None else x, dtype=np.uint8)
        c = np.frombuffer(zero if y is None else y, dtype=np.uint8)
        first = (int(b) - 1) * BLOCK_BITS + 1
        rows.append(
            [(np.flatnonzero(np.unpackbits(m, bitorder="little")) + first).tolist() for m in (a & ~c, c & ~a, a & c)]
        )
    return pd.DataFrame(rows, columns=["only_left", "only_right", "both"])


def diff_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, Column],
    fields: Mapping[str, Column],
    order: list[Column],
    left_name: str = "left",
    right_name: str = "right",
) -> DataFrame:
    """Rows ``(*keys, field, kind)`` telling where two copies disagree.

    ``keys`` and ``fields`` map output names to expressions valid on both
    sides (``fields`` already canonical; equal strings mean equal values).
    ``order`` holds the expressions whose largest values mark the current
    version of a key. kind is
    ``missing_in_<side>`` with an empty field, or ``differs``.

    Null key parts count as empty strings; repeated deliveries and older
    versions are dropped; two empty tables give no rows; further columns of
    either side are never read.
    """
    names = list(keys)
    spark = left.sparkSession

    def side(df: DataFrame, flag: bool) -> DataFrame:
        cols = [F.coalesce(e.cast("string"), F.lit("")).alias(n) for n, e in keys.items()]
        values = [F.md5(F.coalesce(e, F.lit(""))).alias(f"__v_{n}") for n, e in fields.items()]
        ranks = [f"__o{i}" for i in range(len(order))]
        slim = df.select(*cols, *values, *[o.alias(r) for o, r in zip(order, ranks)])
        current = newest(slim, [F.col(n) for n in names], [F.col(r).desc_nulls_last() for r in ranks])
        return current.drop(*ranks).withColumn("__left", F.lit(flag))

    both = side(left, True).unionByName(side(right, False))
    buckets = parallelism(spark)
    both = both.withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(buckets)))
    dense = F.dense_rank().over(Window.partitionBy("__bucket").orderBy(*names))
    both = both.withColumn("__ord", F.shiftleft(F.col("__bucket").cast("long"), BUCKET_BITS) + dense)

    position = F.bitmap_bit_position(F.col("__ord"))
    blocks = (
        both.groupBy("__bucket", F.bitmap_bucket_number(F.col("__ord")).alias("__block"))
        .agg(
            F.bitmap_construct_agg(F.when(F.col("__left"), position)).alias("l"),
            F.bitmap_construct_agg(F.when(~F.col("__left"), position)).alias("r"),
        )
        .select("__bucket", _block_algebra("__block", "l", "r").alias("x"))
    )
    tagged = blocks.select(
        "__bucket",
        F.explode(
            F.concat(
                F.transform("x.only_left", lambda o: F.struct(o.alias("o"), F.lit(f"missing_in_{right_name}").alias("k"))),
                F.transform("x.only_right", lambda o: F.struct(o.alias("o"), F.lit(f"missing_in_{left_name}").alias("k"))),
                F.transform("x.both", lambda o: F.struct(o.alias("o"), F.lit("both").alias("k"))),
            )
        ).alias("e"),
    ).select("__bucket", F.col("e.o").alias("__ord"), F.col("e.k").alias("__k"))

    aligned = both.groupBy("__bucket", "__ord").agg(
        *[F.first(n).alias(n) for n in names],
        *[F.max(F.when(F.col("__left"), F.col(f"__v_{n}"))).alias(f"l_{n}") for n in fields],
        *[F.max(F.when(~F.col("__left"), F.col(f"__v_{n}"))).alias(f"r_{n}") for n in fields],
    )
    verdicts = aligned.join(tagged, ["__bucket", "__ord"]).withColumn(
        "__out",
        F.when(
            F.col("__k") == "both",
            F.filter(
                F.array(
                    *[
                        F.when(
                            F.col(f"l_{n}") != F.col(f"r_{n}"),
                            F.struct(F.lit(n).alias("field"), F.lit("differs").alias("kind")),
                        )
                        for n in fields
                    ]
                ),
                lambda s: s.isNotNull(),
            ),
        ).otherwise(F.array(F.struct(F.lit("").alias("field"), F.col("__k").alias("kind")))),
    )
    return verdicts.select(*names, F.explode("__out").alias("o")).select(*names, "o.field", "o.kind")

