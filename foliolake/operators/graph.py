"""Connected components without a graph library."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.session import cut


def components(members: DataFrame, record: str = "record", entity: str = "entity") -> DataFrame:
    """(record, group) for every record of ``members`` (record, entity).

    The group is the least record id reachable through shared entities. Null
    records or entities tie nothing and are dropped; repeats don't matter; an
    empty table gives an empty result.
    """
    edges = members.select(F.col(record).alias("r"), F.col(entity).alias("e")).where("r is not null and e is not null").distinct()
    edges = cut(edges)
    labels = cut(edges.select("r").distinct().withColumn("l", F.col("r")))
    while True:
        by_entity = edges.join(labels, "r").groupBy("e").agg(F.min("l").alias("el"))
        heard = edges.join(by_entity, "e").groupBy("r").agg(F.min("el").alias("h"))
        stepped = labels.join(heard, "r", "left").select("r", F.col("l").alias("was"), F.least("l", "h").alias("l"))
        roots = stepped.select(F.col("r").alias("l"), F.col("l").alias("root"))
        jumped = stepped.join(roots, "l", "left").select("r", "was", F.least("l", F.coalesce("root", "l")).alias("l"))
        jumped = cut(jumped)
        changed = jumped.where("l <> was").limit(1).count()
        labels = jumped.select("r", "l")
        if not changed:
            return labels.select(F.col("r").alias(record), F.col("l").alias("group"))


def grid_components(cells: DataFrame, key: str, row: str = "row", column: str = "col") -> DataFrame:
    """(key, row, col, component): set cells of a grid that touch side to side; the
    component is its least cell in reading order. Null coordinates are left out."""
    at = lambda r, c: F.concat_ws("\x1f", F.col(key), F.format_string("%09d", r), F.format_string("%09d", c))
    r, c = F.col(row).cast("int"), F.col(column).cast("int")
    live = cells.where(r.isNotNull() & c.isNotNull() & F.col(key).isNotNull())
    # A cell belongs to its own tie and to those with its right and lower neighbour.
    ties = F.array(F.concat(F.lit("o"), at(r, c)), F.concat(F.lit("h"), at(r, c)), F.concat(F.lit("h"), at(r, c - 1)), F.concat(F.lit("v"), at(r, c)), F.concat(F.lit("v"), at(r - 1, c)))
    members = live.select(at(r, c).alias("record"), F.explode(ties).alias("entity"))
    found = components(members)
    return live.withColumn("record", at(r, c)).join(found, "record").select(key, row, column, F.col("group").alias("component"))


def regions_of(grid: list[list[int | None] | None]) -> tuple[int, int]:
    """(regions, cells): dark cells of a grid (bytes below 128) and their groups that touch side to side."""
    up: dict[tuple[int, int], tuple[int, int]] = {}

    def root(x: tuple[int, int]) -> tuple[int, int]:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for r, line in enumerate(grid):
        for c, v in enumerate(line or ()):
            if v is not None and v % 256 < 128:
                up[r, c] = (r, c)
                for near in ((r - 1, c), (r, c - 1)):
                    if near in up:
                        up[root((r, c))] = root(near)
    return sum(k == v for k, v in up.items()), len(up)


def grid_regions(crops: DataFrame, key: str, grid: str) -> DataFrame:
    """(key, regions, cells) of every row whose grid has a dark cell. A grid is
    labelled inside its own row, so nothing is shuffled; the key becomes a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *regions_of(g)) for k, g in zip(*(c.to_pylist() for c in batch.columns)) if g is not None]
            cols = list(zip(*(x for x in rows if x[2]))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], type=pa.string()), pa.array(cols[1], type=pa.int64()), pa.array(cols[2], type=pa.int64())], names=[key, "regions", "cells"]
            )

    return crops.select(F.col(key).cast("string").alias(key), grid).mapInArrow(run, f"{key} string, regions long, cells long")
