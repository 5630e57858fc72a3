"""Sinks with the guards that keep good results from being overwritten by worse ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RefusedWrite(ValueError):
    """A write was refused; nothing was changed."""


def write_partitioned(df: DataFrame, path: str, by: str = "split", mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(by).parquet(path)


def write_nonempty(df: DataFrame, path: str, only: tuple[str, object] | None = None) -> None:
    """Refuses an empty table, and rows whose column differs from ``only`` (name, value)."""
    if not df.limit(1).count():
        raise RefusedWrite("no rows to write")
    if only and df.where(~F.col(only[0]).eqNullSafe(F.lit(only[1]))).limit(1).count():
        raise RefusedWrite(f"rows with {only[0]} other than {only[1]}")
    df.write.mode("overwrite").parquet(path)


def write_growing(df: DataFrame, path: str, force: bool = False) -> None:
    """Refuses to replace a result by one with fewer rows, unless forced."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(p) and not force:
        old, new = spark.read.parquet(path).count(), df.count()
        if new < old:
            raise RefusedWrite(f"{new} rows would replace {old}")
    df.write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, one object each."""
    df.write.mode("overwrite").json(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """word<TAB>n, most frequent first, then by word; range-sorted files in order."""
    counts.orderBy(F.desc("n"), "word").select("word", "n").write.mode("overwrite").csv(path, sep="\t", quote="")


def write_sorted(df: DataFrame, path: str, *order) -> None:
    df.orderBy(*order).write.mode("overwrite").csv(path, header=True)
