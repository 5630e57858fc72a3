"""Filling fixed-capacity containers by bin completion.

Texts above the capacity are cut into full pieces, which fill containers of
their own, and a remainder. The remaining items are spread by hash over groups
of about ``group_items``; each group is packed on its own, so work and memory
per task are bounded and only one container per group can be left over.

Within a group: best fit decreasing gives the incumbent; then branch and bound
completes one container at a time around the largest remaining item with
undominated fillings, pruned by the waste that an improvement could still
afford. At each node the likeliest fillings come first; all others follow,
fullest first, when the search comes back. It stops when the incumbent meets
the lower bound, when nothing is left to try, or after ``max_nodes`` fillings;
in the first two cases the packing is proven to be the best (``max_nodes`` None
always searches to the end).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's L2 for items of 1..capacity."""
    if not sizes:
        return 0
    a = np.sort(np.asarray(sizes, dtype=np.int64))
    total = np.concatenate([[0], np.cumsum(a)])
    half = np.searchsorted(a, capacity / 2, side="right")
    best = -(-int(total[-1]) // capacity)
    ks = np.unique(np.concatenate([[0], a[:half]]))
    lo = np.searchsorted(a, ks, side="left")
    over = np.searchsorted(a, capacity - ks, side="right")
    over = np.maximum(over, half)
    n1, n2 = len(a) - over, over - half
    room = n2 * capacity - (total[over] - total[half])
    small = total[half] - total[np.minimum(lo, half)]
    extra = np.maximum(0, -(-(small - room) // capacity))
    return max(best, int(np.max(n1 + n2 + extra)))


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """``sizes`` in descending order."""
    rooms: list[tuple[int, int]] = []  # (room, container), ascending
    filled: list[list[int]] = []
    for s in sizes:
        i = bisect_left(rooms, (s, -1))
        if i == len(rooms):
            filled.append([s])
            insort(rooms, (capacity - s, len(filled) - 1))
        else:
            room, b = rooms.pop(i)
            filled[b].append(s)
            insort(rooms, (room - s, b))
    return filled


class _Stock:
    """A multiset of sizes with ascending distinct values."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.values = sorted(self.count)
        self.total = sum(sizes)

    def take(self, filling: tuple[int, ...]) -> None:
        for s in filling:
            self.count[s] -= 1
            self.total -= s
            if not self.count[s]:
                del self.values[bisect_left(self.values, s)]

    def put(self, filling: tuple[int, ...]) -> None:
        for s in filling:
            if not self.count[s]:
                insort(self.values, s)
            self.count[s] += 1
            self.total += s

    def pair(self, room: int) -> tuple[int, ...]:
        """The fullest pair within ``room``."""
        v, c = self.values, self.count
        i, j, best, found = 0, bisect_right(v, room) - 1, 0, ()
        while i <= j:
            s = v[i] + v[j]
            if s > room:
                j -= 1
                continue
            if s > best and (i != j or c[v[i]] > 1):
                best, found = s, (v[j], v[i])
                if s == room:
                    break
            i += 1
        return found

    def several(self, room: int) -> tuple[int, ...]:
        """Largest items first while three still fit, then the fullest single or pair."""
        taken: list[int] = []
        while self.values and self.values[0] * 3 <= room:
            s = self.values[bisect_right(self.values, room) - 1]
            self.take((s,))
            taken.append(s)
            room -= s
        i = bisect_right(self.values, room)
        if i:
            single, pair = self.values[i - 1], self.pair(room)
            last = pair if sum(pair) > single else (single,)
        else:
            last = ()
        self.put(tuple(taken))
        return (*taken, *last)

    def likely(self, room: int) -> list[tuple[int, ...]]:
        """A few full fillings of ``room`` that cost little to find, fullest first."""
        v = self.values
        i = bisect_right(v, room)
        if not i:
            return [()]
        single = v[i - 1]
        if single == room:
            return [(single,)]
        options = [(single,)]
        pair = self.pair(room)
        if sum(pair) > single:
            options.append(pair)
        if sum(pair) != room and v[0] * 3 <= room:
            options.append(self.several(room))
        return sorted(set(options), key=lambda f: (-sum(f), len(f), f))

    def fillings(self, room: int, least: int) -> Iterator[tuple[int, ...]]:
        """Every undominated filling of ``room`` with a sum of ``least`` or more,
        first the likely ones, then the others, fullest first.

        Sets of sums are integers with one bit per sum, so only fillings that
        exist are ever entered.
        """
        least = max(least, 0)
        seen = set()
        for f in self.likely(room):
            if sum(f) >= least:
                seen.add(tuple(sorted(f, reverse=True)))
                yield f
        if (room,) in seen:
            return  # it covers every other filling
        v = self.values[: bisect_right(self.values, room)]
        counts = {s: self.count[s] for s in v}
        mask = (2 << room) - 1
        reach = [1]
        for s in v:
            sums, left, step = reach[-1], min(counts[s], room // s), 1
            while left:
                step = min(step, left)
                sums |= sums << s * step & mask
                left -= step
                step *= 2
            reach.append(sums)
        for total in range(room, least - 1, -1):
            if not reach[-1] >> total & 1:
                continue
            stack: list[tuple[int, int, tuple[int, ...]]] = [(len(v), total, ())]
            while stack:
                i, rest, taken = stack.pop()
                if not rest:
                    if taken not in seen and not _dominated(taken, room - total, v, counts):
                        seen.add(taken)
                        yield taken
                    continue
                s = v[i - 1]
                for n in range(min(counts[s], rest // s) + 1):
                    if reach[i - 1] >> rest - n * s & 1:
                        stack.append((i - 1, rest - n * s, taken + (s,) * n))


def _dominated(filling: tuple[int, ...], slack: int, values: list[int], counts: dict[int, int]) -> bool:
    """Could an item outside take the place of some items inside (or of none)
    without leaving more room? Then the other filling is never worse."""
    any_sum, several = 1, 0
    for s in filling:
        several |= (several | any_sum & ~1) << s
        any_sum |= any_sum << s
    for x in values:
        if filling.count(x) == counts[x]:
            continue
        low = max(0, x - slack)
        if any_sum >> low & (1 << x - low) - 1 or several >> x & 1:
            return True
    return False


def bin_completion(sizes: list[int], capacity: int, max_nodes: int | None = 1000) -> tuple[list[list[int]], bool]:
    """(containers as lists of sizes, proven): sizes must lie in 1..capacity.

    proven tells that no packing has fewer containers.
    """
    sizes = sorted(sizes, reverse=True)
    bound = lower_bound(sizes, capacity)
    best = best_fit_decreasing(sizes, capacity)
    if len(best) <= bound:
        return best, True
    stock = _Stock(sizes)
    path: list[tuple[int, ...]] = []
    nodes, dives = 0, len(sizes)

    def options() -> Iterator[tuple[int, ...]]:
        big = stock.values[-1]
        stock.take((big,))
        room = capacity - big
        spare = (len(best) - 1 - len(path)) * capacity - stock.total - big
        found = stock.fillings(room, room - spare) if spare >= 0 else iter(())
        first = next(found, None)
        stock.put((big,))
        while first is not None:
            yield (big, *first)
            # The stock is as it was when this filling's branch has been left.
            stock.take((big,))
            first = next(found, None)
            stock.put((big,))

    todo = [options()]
    while todo:
        filling = next(todo[-1], None) if len(path) + -(-stock.total // capacity) < len(best) else None
        if filling is None:
            todo.pop()
            if path:
                stock.put(path.pop())
            continue
        nodes += 1
        if max_nodes is not None and nodes > dives + max_nodes:
            return best, False
        stock.take(filling)
        path.append(filling)
        if not stock.values:
            if len(path) < len(best):
                best = [list(f) for f in path]
                if len(best) <= bound:
                    return best, True
            stock.put(path.pop())
        else:
            todo.append(options())
    return best, True


def pack_texts(sized: DataFrame, specs: DataFrame, group_items: int = 2000, max_nodes: int | None = 1000) -> DataFrame:
    """(spec, capacity, container, doc_id, piece, first_token, tokens, part, least, proven).

    ``sized`` has (doc_id, tokens); ``specs`` has (spec, capacity_tokens).
    Every text, or every piece of a text above the capacity, lies in exactly
    one container; tokens first_token.. of the text make up the piece. Texts
    without tokens take no room and get no container, nor do texts without an
    id, which could not be found again; specs without a
    positive capacity are left out; empty tables give no rows. ``least`` is the
    lower bound of the containers of the group ``part``, and ``proven`` tells
    that its packing is the best there is; full pieces have neither group nor bound. Equal ids are
    told apart only by their rows, so doc_id should be unique.
    """
    plan = specs.where("capacity_tokens > 0").select("spec", "capacity_tokens").collect()  # one row per spec
    if not plan:
        plan = []
    listed = F.array(*[F.struct(F.lit(r.spec).alias("spec"), F.lit(int(r.capacity_tokens)).cast("long").alias("capacity")) for r in plan]) if plan else F.array().cast("array<struct<spec:string,capacity:bigint>>")
    per_spec = sized.where("tokens > 0 and doc_id is not null").select("doc_id", "tokens", F.explode(listed).alias("s")).select("doc_id", "tokens", "s.*")
    full = F.floor((F.col("tokens") - 1) / F.col("capacity")) * (F.col("tokens") > F.col("capacity")).cast("long")
    per_spec = per_spec.withColumn("full", full)
    n = sized.count()
    groups = max(1, -(-n // group_items))
    whole = per_spec.where("full > 0").select(
        "spec", "capacity", "doc_id", F.explode(F.expr("sequence(0L, full - 1)")).alias("piece")
    )
    whole = whole.select(
        "spec", "capacity",
        F.concat_ws("-", "spec", F.lit("t"), "doc_id", "piece").alias("container"),
        "doc_id", F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("tokens"),
        F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("least"), F.lit(True).alias("proven"),
    )
    rest = per_spec.select(
        "spec", "capacity", "doc_id", F.col("full").cast("int").alias("piece"),
        (F.col("full") * F.col("capacity")).alias("first_token"),
        (F.col("tokens") - F.col("full") * F.col("capacity")).alias("tokens"),
        F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("part"),
    )

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        spec, capacity, part = pdf["spec"].iloc[0], int(pdf["capacity"].iloc[0]), int(pdf["part"].iloc[0])
        sizes = pdf["tokens"].tolist()
        waiting: dict[int, list[int]] = {}
        for i in range(len(sizes) - 1, -1, -1):
            waiting.setdefault(sizes[i], []).append(i)
        where = [0] * len(sizes)
        bins, proven = bin_completion(sizes, capacity, max_nodes)
        for b, filling in enumerate(bins):
            for s in filling:
                where[waiting[s].pop()] = b
        pdf["container"] = [f"{spec}-{part}-{b}" for b in where]
        pdf["least"], pdf["proven"] = lower_bound(sizes, capacity), proven
        return pdf[["spec", "capacity", "container", "doc_id", "piece", "first_token", "tokens", "part", "least", "proven"]]

    schema = "spec string, capacity long, container string, doc_id long, piece int, first_token long, tokens long, part long, least long, proven boolean"
    packed = rest.groupBy("spec", "part").applyInPandas(pack, schema)
    return whole.unionByName(packed)


def container_fill(packed: DataFrame) -> DataFrame:
    """(spec, container, capacity, n_pieces, used_tokens, fill) per container."""
    used = packed.groupBy("spec", "container").agg(
        F.first("capacity").alias("capacity"), F.count("*").alias("n_pieces"), F.sum("tokens").alias("used_tokens")
    )
    return used.withColumn("fill", F.col("used_tokens") / F.col("capacity"))


def packing_report(packed: DataFrame) -> DataFrame:
    """(spec, groups, proven_groups, containers, least_containers, used_tokens, fill): per spec.

    least_containers adds the groups' lower bounds and the full pieces; fill is
    the used share of all containers.
    """
    per = packed.groupBy("spec", "capacity", "part").agg(
        F.min("proven").alias("proven"), F.count_distinct("container").alias("containers"), F.max("least").alias("least"), F.sum("tokens").alias("used_tokens")
    )
    grouped = F.col("part").isNotNull()
    return (
        per.groupBy("spec", "capacity")
        .agg(
            F.sum(grouped.cast("long")).alias("groups"),
            F.sum((grouped & F.col("proven")).cast("long")).alias("proven_groups"),
            F.sum("containers").alias("containers"),
            F.sum(F.coalesce("least", "containers")).alias("least_containers"),
            F.sum("used_tokens").alias("used_tokens"),
        )
        .select("spec", "groups", "proven_groups", "containers", "least_containers", "used_tokens", (F.col("used_tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
    )


def packing_checks(packed: DataFrame, sized: DataFrame) -> DataFrame:
    """(spec, n_texts, wrong_sizes, overfull, needless_cuts): texts packed per spec;
    texts whose pieces don't make up the text; containers over capacity; texts cut though they fit."""
    texts = packed.groupBy("spec", "capacity", "doc_id").agg(F.sum("tokens").alias("packed"), F.count("*").alias("pieces"))
    texts = texts.join(sized.select("doc_id", F.col("tokens").alias("size")), "doc_id")
    flag = lambda c: F.sum(c.cast("long"))
    per = texts.groupBy("spec").agg(
        F.count("*").alias("n_texts"),
        flag(F.col("packed") != F.col("size")).alias("wrong_sizes"),
        flag((F.col("pieces") > 1) & (F.col("size") <= F.col("capacity"))).alias("needless_cuts"),
    )
    full = packed.groupBy("spec", "capacity", "container").agg(F.sum("tokens").alias("used")).groupBy("spec").agg(flag(F.col("used") > F.col("capacity")).alias("overfull"))
    return per.join(full, "spec").select("spec", "n_texts", "wrong_sizes", "overfull", "needless_cuts")
