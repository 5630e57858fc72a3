"""A keyed store with latest-wins updates, as Parquet snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.operators.current import newest


def upsert_latest(stored: DataFrame, incoming: DataFrame, key: str, version: str, tie: list[Column] | None = None) -> DataFrame:
    """Stored and incoming rows, one per key, the highest version winning; null versions lose."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    return newest(both, [F.col(key)], [F.col(version).desc_nulls_last(), F.col("__new").desc(), *(tie or [])]).drop("__new")


def delete_keys(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys.select(key).distinct(), key, "left_anti")


def get(stored: DataFrame, key: str, value) -> DataFrame:
    return stored.where(F.col(key) == value)


def listed(stored: DataFrame, stamp: str, fallback: str) -> DataFrame:
    """All rows, newest first; rows without a stamp go by the fallback."""
    return stored.orderBy(F.coalesce(stamp, fallback).desc_nulls_last())
