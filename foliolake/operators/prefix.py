"""Prefix sums inside keys without a single-task window over a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_sums(df: DataFrame, key: str, amount: str, coarse: Column, fine: list[Column], out: str) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all earlier rows of the row's key.

    The order is ``coarse`` (an integer bucket), then ``fine``, which should
    be total. Sums per (key, bucket) are taken first; only those small rows
    meet in a window over the whole key, so a key holding a third of all rows
    is spread over its buckets. Null amounts count as zero; null keys form one
    key; an empty table stays empty.
    """
    rows = df.withColumn("__b", coarse).withColumn("__a", F.coalesce(F.col(amount), F.lit(0)))
    totals = rows.groupBy(key, "__b").agg(F.sum("__a").alias("__t"))
    upto = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        F.col(key).alias("__k"), F.col("__b").alias("__kb"), F.coalesce(F.sum("__t").over(upto), F.lit(0)).alias("__s")
    )
    inside = Window.partitionBy(key, "__b").orderBy(*fine).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__w", F.coalesce(F.sum("__a").over(inside), F.lit(0)))
    joined = rows.join(starts, F.col(key).eqNullSafe(F.col("__k")) & (F.col("__b") == F.col("__kb")))
    return joined.withColumn(out, F.col("__s") + F.col("__w")).drop("__b", "__a", "__k", "__kb", "__s", "__w")
