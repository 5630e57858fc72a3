"""Corpus construction: deduplication, splits, caps, funnels, distributions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row per key in the given (total) order; which one survives is part of the result."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def case_blind_key(text: Column) -> Column:
    return F.lower(F.trim(text))


def crc_seed(name: Column, base: int) -> Column:
    """Seed from a stable 31-bit name hash."""
    return F.lit(base * 7919) + F.pmod(F.crc32(name.cast("binary")).bitwiseAND(0x7FFFFFFF), F.lit(100003))


def pick_by_hash(name: Column, n: int, step: int = 0) -> Column:
    """Index below n from the name's hash; ``step`` gives further, different picks."""
    return F.pmod(F.crc32(name.cast("binary")) + F.lit(step * 7919), F.lit(n)).cast("int")


def positional_split(groups: DataFrame, key: str, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """(key, split) by position among the sorted keys: rounded half to even, train and val at least one group.

    Ranks come from range-partitioned counts, not from one window over all
    groups: keys are sorted into ranges, ranges counted, and only the counts
    meet on one task.
    """
    keys = groups.select(key).where(F.col(key).isNotNull()).distinct()
    ranked = global_rank(keys, key)
    n = ranked.agg(F.max("rank").alias("n")).first().n or 0
    train, val = max(1, round(n * shares[0])), max(1, round(n * shares[1]))
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + val, "val").otherwise("test")
    return ranked.select(key, split.alias("split"))


def global_rank(keys: DataFrame, key: str, pieces: int = 64) -> DataFrame:
    """Adds rank (from 1) in key order, computed over range partitions."""
    ranged = keys.repartitionByRange(pieces, key).withColumn("__p", F.spark_partition_id())
    from foliolake.session import cut

    ranged = cut(ranged)
    w = Window.partitionBy("__p").orderBy(key)
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__p", before.alias("__s"))  # one row per range
    return ranged.withColumn("__r", F.row_number().over(w)).join(starts, "__p").select(*keys.columns, (F.col("__r") + F.col("__s")).alias("rank"))


def hashed_split(df: DataFrame, key: str, seed: int = 0, shares: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """Adds split from the hash of the key alone: no shuffle, and all rows of a key agree.

    Shares hold in expectation. Null keys form one group.
    """
    u = F.pmod(F.crc32(F.concat_ws("|", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))).cast("binary")), F.lit(10_000)) / 10_000
    return df.withColumn("split", F.when(u < shares[0], "train").when(u < shares[0] + shares[1], "val").otherwise("test"))


def stratified_folds(df: DataFrame, stratum: str, key: str, k: int, seed: int = 0) -> DataFrame:
    """Adds fold 0..k-1, dealt round in hash order within each stratum."""
    order = [F.crc32(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), F.col(key)]
    return df.withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy(stratum).orderBy(*order)) - 1, F.lit(k)))


def split_leaks(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Keys found in more than one split; empty means disjoint."""
    return df.groupBy(key).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a <> b").select(key)


def cap_per_group(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """At most ``cap`` rows per group, the first in order (a sampling operator)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def strided_sample(df: DataFrame, group: str, order: list, cap: int) -> DataFrame:
    """Every (n // cap)-th row of a group, up to ``cap`` (a sampling operator).

    Group sizes come from partial counts; the numbering streams through each
    group in order.
    """
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count("*").alias("__n"))
    r = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)
    r = r.join(sizes, F.col(group).eqNullSafe(F.col("__g")))
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / cap))
    return r.where((F.col("__r") % step == 0) & (F.floor(F.col("__r") / step) < cap)).drop("__r", "__n", "__g")


def augment(df: DataFrame, copies: int, change) -> DataFrame:
    """Originals (copy 0) and ``copies`` changed copies; ``change(copy)`` maps column names to expressions."""
    out = df.withColumn("copy", F.lit(0))
    for c in range(1, copies + 1):
        out = out.unionByName(df.withColumns(change(c)).withColumn("copy", F.lit(c)))
    return out


def label_plausible(chars: Column, steps: Column, most: int = 48, share: float = 0.15) -> Column:
    """First reason that fits: empty, too-long, ctc-infeasible, collapsed, else kept."""
    return (
        F.when(chars == 0, "empty")
        .when(chars > most, "too-long")
        .when(chars > steps, "ctc-infeasible")
        .when(chars < F.floor(F.lit(share) * F.greatest(F.lit(1), steps)), "collapsed")
        .otherwise("kept")
    )


def funnel(df: DataFrame, reason: str) -> DataFrame:
    """(reason, n, part): how many rows each reason drops or keeps."""
    per = df.groupBy(reason).agg(F.count("*").alias("n"))
    return per.withColumn("part", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per reason


def dense_histogram(df: DataFrame, value: str) -> DataFrame:
    """(value, n) for every whole number from the least to the largest, empty bins included."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    span = counts.agg(F.min("value").alias("lo"), F.max("value").alias("hi")).where("lo is not null")
    return span.select(F.explode(F.sequence("lo", "hi")).alias("value")).join(counts, "value", "left").fillna(0, ["n"])


def distribution(df: DataFrame, key: str, value: str) -> DataFrame:
    """n, mean, p25, median, p75 and iqr per key; quartiles interpolate linearly."""
    q = lambda p: F.percentile(value, F.lit(p))
    out = df.groupBy(key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"))
    return out.withColumn("iqr", F.col("p75") - F.col("p25"))


def divergence(value: Column, base: Column, iqr: Column) -> Column:
    """Distance in units of the base's IQR; without spread 0 or infinity."""
    d = F.abs(value - base)
    return F.when(iqr <= 1e-9, F.when(d > 1e-9, F.lit(float("inf"))).otherwise(0.0)).otherwise(d / iqr)


def worst_ratio(pairs: list[tuple[Column, Column]]) -> Column:
    """Largest of a/b and b/a over several metrics."""
    sides = [F.greatest(F.try_divide(a, b), F.try_divide(b, a)) for a, b in pairs]
    return F.greatest(*sides) if len(sides) > 1 else sides[0]


def is_monotone(df: DataFrame, key: str, order: str, rising: list[str], falling: list[str]) -> DataFrame:
    """(key, monotone): do all values rise (or fall) along the ladder? Equal neighbours count as fine."""
    w = Window.partitionBy(key).orderBy(order)
    ok = F.lit(True)
    for c in rising:
        ok = ok & F.coalesce(F.col(c) >= F.lag(c).over(w), F.lit(True))
    for c in falling:
        ok = ok & F.coalesce(F.col(c) <= F.lag(c).over(w), F.lit(True))
    return df.withColumn("__ok", ok).groupBy(key).agg(F.bool_and("__ok").alias("monotone"))


def nearest_profile(points: DataFrame, profiles: DataFrame, dims: list[str], point: str, profile: str) -> DataFrame:
    """(point, profile, distance): the nearest profile after standardising by the profiles' mean and deviation.

    ``profiles`` is a small reference set (at most 1,000 rows, checked) and is
    held as a literal, so points are never paired with each other.
    """
    stats = profiles.agg(*[F.avg(d).alias(f"m_{d}") for d in dims], *[F.stddev_pop(d).alias(f"s_{d}") for d in dims]).first()
    rows = profiles.select(profile, *dims).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 profiles")
    if not rows:
        return points.select(point).limit(0).withColumn(profile, F.lit("")).withColumn("distance", F.lit(0.0))

    def scale(d: str) -> float:
        s = stats[f"s_{d}"] or 0.0
        return s if s >= 1e-9 else 1.0

    options = []
    for r in rows:
        total = F.lit(0.0)
        for d in dims:
            total = total + F.pow((F.col(d) - F.lit(float(r[d]))) / scale(d), 2)
        options.append(F.struct(F.sqrt(total).alias("distance"), F.lit(r[profile]).alias(profile)))
    best = F.array_min(F.array(*options))
    return points.select(point, best.alias("b")).select(point, f"b.{profile}", "b.distance")


def otsu_threshold(histogram: DataFrame, key: str) -> DataFrame:
    """(key, threshold): the grey level that best parts a 256-bin histogram (key, bin, n); the first of equals."""
    w = Window.partitionBy(key)
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    r = histogram.select(
        key, "bin",
        F.sum("n").over(upto).cast("double").alias("wb"),
        F.sum(F.col("bin") * F.col("n")).over(upto).cast("double").alias("sb"),
        F.sum("n").over(w).cast("double").alias("t"),
        F.sum(F.col("bin") * F.col("n")).over(w).cast("double").alias("st"),
    )
    live = (F.col("wb") > 0) & (F.col("wb") < F.col("t"))
    mb, mf = F.col("sb") / F.col("wb"), (F.col("st") - F.col("sb")) / (F.col("t") - F.col("wb"))
    between = F.when(live, F.col("wb") * (F.col("t") - F.col("wb")) * F.pow(mb - mf, 2)).otherwise(0.0)
    return r.withColumn("v", between).groupBy(key).agg(F.max_by("bin", F.struct("v", (-F.col("bin")).alias("b"))).alias("threshold"))


def runs(df: DataFrame, key: str, pos: str, flag: Column, most_gap: int = 1) -> DataFrame:
    """(key, run, start, end, length) of consecutive flagged positions; gaps up to most_gap - 1 stay inside a run."""
    on = df.where(flag).select(key, pos)
    w = Window.partitionBy(key).orderBy(pos)
    new = F.coalesce(F.col(pos) - F.lag(pos).over(w) > most_gap, F.lit(True)).cast("int")
    marked = on.withColumn("__n", new).withColumn("run", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "run").agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("length"))


def median_pitch(df: DataFrame, key: str, pos: str) -> DataFrame:
    """(key, pitch): median distance of neighbouring positions."""
    gap = F.col(pos) - F.lag(pos).over(Window.partitionBy(key).orderBy(pos))
    return df.withColumn("__g", gap).groupBy(key).agg(F.median("__g").alias("pitch"))


def width_buckets(df: DataFrame, group: str, width: str, order: str, most_step: int, batch: int) -> DataFrame:
    """Adds bucket and batch: widths in order, a new bucket where the next is more than
    most_step wider than its neighbour, then batches of fixed size inside it."""
    w = Window.partitionBy(group).orderBy(width, order)
    new = F.coalesce(F.col(width) - F.lag(width).over(w) > most_step, F.lit(True)).cast("int")
    b = df.withColumn("__n", new).withColumn("bucket", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(group, "bucket").orderBy(width, order)
    return b.withColumn("batch", F.floor((F.row_number().over(inside) - 1) / batch)).drop("__n")


def pixel_histogram(crops: DataFrame, key: str, column: str) -> DataFrame:
    """(key, bin, n) of a nested pixel array; signed bytes are read as 0..255."""
    px = crops.where(F.col(column).isNotNull()).select(key, F.explode(F.flatten(column)).alias("v")).where("v is not null")
    return px.groupBy(key, F.pmod(F.col("v").cast("int"), F.lit(256)).alias("bin")).agg(F.count("*").alias("n"))
