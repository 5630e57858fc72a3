"""Splits that keep related records together.

Records that share an entity (here: pages tied by links) form one group, found
by minimum-label propagation over the bipartite record-entity graph with
pointer jumping: each round takes the minimum over an entity's records, then
over a record's entities, then replaces a label by that label's own label, so
the rounds grow with the logarithm of the longest chain. Labels are cut into
the shared checkpoint folder each round.

Groups then get splits: the few groups above ``big_share`` of all records (at
most 1 / big_share of them, a proven bound) are placed greedily by the driver;
all others are laid end to end within their commonest label and cut where the
remaining target shares end, by distributed prefix sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolake.llm.pages import page_id, page_kind, split_name
from foliolake.operators.current import newest
from foliolake.operators.graph import components
from foliolake.operators.prefix import prefix_sums
from foliolake.session import cut

SPLITS = ("train", "val", "test")
PREFIX_BUCKETS = 64
#: Kinds that the placing of large groups tells apart.
STEERING_KINDS = 1000


def page_groups(links: DataFrame) -> DataFrame:
    """(doc, group) of every page in the links; self-links and null ends tie nothing."""
    ends = links.select(page_id(F.col("page_a")).alias("a"), page_id(F.col("page_b")).alias("b"))
    ends = ends.where("a is not null and b is not null and a <> b")
    tie = F.concat_ws("\x1f", F.least("a", "b"), F.greatest("a", "b"))
    members = ends.select(F.explode(F.array("a", "b")).alias("doc"), tie.alias("entity"))
    return components(members, "doc", "entity")


def split_leaks(crops: DataFrame, links: DataFrame) -> DataFrame:
    """(doc): pages of ``crops`` whose group has crops in more than one split.

    Rows without a readable split or page don't count; a page without rows in
    any split is still listed when its group leaks.
    """
    seen = (
        crops.select(page_id(F.col("doc")).alias("doc"), split_name(F.col("split")).alias("s"))
        .where("doc is not null")
        .groupBy("doc")
        .agg(*[F.max(F.coalesce(F.col("s") == s, F.lit(False))).alias(s) for s in SPLITS])
    )
    grouped = seen.join(page_groups(links), "doc", "left").withColumn("group", F.coalesce("group", "doc"))
    grouped = cut(grouped)
    leaking = (
        grouped.groupBy("group")
        .agg(*[F.max(s).cast("int").alias(s) for s in SPLITS])
        .where(" + ".join(SPLITS) + " > 1")
        .select("group")
    )
    return grouped.join(leaking, "group", "left_semi").select("doc")


def assign_splits(crops: DataFrame, links: DataFrame, targets: DataFrame, big_share: float = 0.002, seed: int = 7) -> DataFrame:
    """(crop_id, doc, kind, split): one split for every crop, whole groups together.

    Crops delivered twice count once, crops without an id not at all. A crop without a page is a group of its
    own of kind ''. Target shares are normalised to sum to 1; targets that are
    null or negative count as 0. With no crops the result is empty.
    """
    once = newest(
        crops.where("crop_id is not null").select("crop_id", page_id(F.col("doc")).alias("doc"), "loaded_at"),
        [F.col("crop_id")],
        [F.col("loaded_at").desc_nulls_last(), F.col("doc")],
    ).select("crop_id", "doc", F.coalesce(page_kind(F.col("doc")), F.lit("")).alias("kind"))
    own = F.coalesce("doc", F.concat(F.lit("crop:"), F.col("crop_id").cast("string")))
    keyed = once.join(page_groups(links), "doc", "left").withColumn("group", F.coalesce("group", own))
    sizes = cut(keyed.groupBy("group", "kind").agg(F.count("*").alias("n")))

    shares = targets.select("split", F.greatest(F.coalesce("share", F.lit(0.0)), F.lit(0.0)).alias("share"))
    rows = sorted((r.split, r.share) for r in shares.collect())  # the table of targets, one row per split
    whole = sum(s for _, s in rows) or 1.0
    share = {name: s / whole for name, s in rows}
    total = sizes.agg(F.sum("n")).first()[0] or 0

    totals = sizes.groupBy("group").agg(F.sum("n").alias("size"), F.max_by("kind", F.struct("n", "kind")).alias("main"))
    large = totals.where(F.col("size") >= max(1.0, big_share * total))
    # The driver weighs the STEERING_KINDS commonest kinds and all others as one: at most STEERING_KINDS / big_share small rows.
    common = sizes.groupBy("kind").agg(F.sum("n").alias("kn")).orderBy(F.desc("kn"), "kind").limit(STEERING_KINDS).select(F.col("kind").alias("k"))
    weighed = sizes.join(F.broadcast(common), F.col("kind") == F.col("k"), "left").groupBy("group", F.coalesce("k", F.lit("*")).alias("kind")).agg(F.sum("n").alias("n"))
    held = weighed.join(large.select("group", "size"), "group")
    spark = crops.sparkSession
    # At most 1 / big_share groups reach big_share of all records.
    by_group: dict[str, dict[str, int]] = {}
    for r in held.collect():
        by_group.setdefault(r.group, {})[r.kind] = r.n
    kinds_of_large = {k for v in by_group.values() for k in v}
    kind_total = {
        r.kind: r.n
        for r in weighed.join(held.select("kind").distinct(), "kind", "left_semi").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    } if kinds_of_large else {}
    used: dict[tuple[str, str], int] = {}
    chosen: list[tuple[str, str]] = []
    for group, parts in sorted(by_group.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        def cost(split: str) -> float:
            """Growth of the squared deviation from the label targets."""
            c = 0.0
            for kind, n in parts.items():
                aim, now = share[split] * kind_total[kind], used.get((kind, split), 0)
                c += ((now + n - aim) ** 2 - (now - aim) ** 2) / kind_total[kind]
            return c

        best = min(share, key=lambda s: (cost(s), s))
        chosen.append((group, best))
        for kind, n in parts.items():
            used[kind, best] = used.get((kind, best), 0) + n

    placed = spark.createDataFrame(chosen, "group string, split string")
    taken = sizes.join(placed, "group").groupBy("kind", "split").agg(F.sum("n").alias("taken"))
    aims = F.explode(F.array(*[F.struct(F.lit(k).alias("split"), F.lit(v).alias("share")) for k, v in share.items()]))
    per_kind = sizes.groupBy("kind").agg(F.sum("n").alias("kn"))
    left = (
        per_kind.select("kind", "kn", aims.alias("a"))
        .select("kind", "kn", "a.split", "a.share")
        .join(taken, ["kind", "split"], "left")
        .withColumn("rest", F.greatest(F.col("share") * F.col("kn") - F.coalesce("taken", F.lit(0)), F.lit(0.0)))
    )
    w = Window.partitionBy("kind").orderBy("split")
    ends = (
        left.withColumn("hi", F.sum("rest").over(w) / F.greatest(F.sum("rest").over(Window.partitionBy("kind")), F.lit(1e-9)))
        .groupBy("kind")
        .agg(F.array_sort(F.collect_list(F.struct("hi", "split"))).alias("ends"))
    )
    small = totals.join(placed, "group", "left_anti").select("group", "size", F.col("main").alias("kind"))
    order = F.xxhash64(F.col("group"), F.lit(seed))
    laid = prefix_sums(small, "kind", "size", F.pmod(order, F.lit(PREFIX_BUCKETS)), [order, F.col("group")], "before")
    length = small.groupBy("kind").agg(F.sum("size").alias("len"))
    at = (F.col("before") + F.col("size") / 2) / F.col("len")
    cutoff = laid.join(length, "kind").join(ends, "kind").withColumn("at", at)
    picked = cutoff.select(
        "group",
        F.coalesce(
            F.expr("element_at(filter(ends, x -> x.hi > at), 1).split"), F.expr("element_at(ends, -1).split")
        ).alias("split"),
    )
    return keyed.join(picked.unionByName(placed), "group").select("crop_id", "doc", "kind", "split")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, kind, n_crops, share, target): kind '*' is the whole split."""
    per = assigned.groupBy("split", "kind").agg(F.count("*").alias("n_crops"))
    both = per.unionByName(per.groupBy("split").agg(F.sum("n_crops").alias("n_crops")).withColumn("kind", F.lit("*")))
    share = F.col("n_crops") / F.sum("n_crops").over(Window.partitionBy("kind"))
    return both.withColumn("share", share).join(targets.select("split", F.col("share").alias("target")), "split", "left")
