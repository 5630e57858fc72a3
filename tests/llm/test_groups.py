"""Groups, splits, mixing and packing against plain Python."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from foliolake.llm import mixing, packing, splits

CROPS = "crop_id long, labels string, doc string, profile string, split string, loaded_at timestamp_ntz"
LINKS = "page_a string, page_b string, link_kind string, seen_at timestamp_ntz"
TARGETS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]
T0 = datetime(2025, 1, 1)


def union_find(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["random", "chain", "star"])
def test_components(spark, shape):
    rng = random.Random(5)
    n = 120
    pairs = {
        "random": [(rng.randrange(n), rng.randrange(n)) for _ in range(70)],
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(7, i) for i in range(50)],
    }[shape]
    name = lambda i: f"n{i:04d}"
    rows = [(name(x), f"e{k}") for k, (a, b) in enumerate(pairs) for x in (a, b)] + [(None, "e1"), ("solo", None)]
    got = {r.record: r.group for r in splits.components(spark.createDataFrame(rows, "record string, entity string")).collect()}
    assert got == {name(k): name(v) for k, v in union_find(pairs).items()}


def test_split_leaks(spark):
    rows = [
        (1, "x", "legal-00000001", "p", "train", T0), (2, "x", " LEGAL_00000001.JPG", "p", "Training ", T0), (3, "x", "legal-00000002", None, "val", T0),
        (4, "x", "bank-00000003", "p", "test", T0), (5, "x", "bank-00000004", "p", None, T0), (6, "x", None, "p", "val", T0), (7, "x", "bank-00000005", "p", "train", T0),
        (8, "x", "bank-00000005", "p", "TEST", T0), (9, "x", "bank-00000006", "p", " ", T0),
    ]
    links = [
        ("legal-00000001", "ghost-00000009", "k", T0), ("Ghost-00000009", "legal-00000002", None, T0), ("bank-00000003", "bank-00000004", "k", T0),
        ("bank-00000003", "BANK_00000003", "k", T0), ("bank-00000003", None, "k", T0), ("bank-00000006", "bank-00000005", "k", T0),
    ]
    crops, ties = spark.createDataFrame(rows, CROPS), spark.createDataFrame(links, LINKS)
    assert {r.doc for r in splits.split_leaks(crops, ties).collect()} == {"legal-00000001", "legal-00000002", "bank-00000005", "bank-00000006"}
    assert {r.doc for r in splits.split_leaks(crops, ties.limit(0)).collect()} == {"bank-00000005"}
    assert splits.split_leaks(crops.limit(0), ties).count() == 0


def test_assign_splits(spark):
    rng = random.Random(2)
    rows, i = [], 0
    for page in range(400):
        kind = rng.choice(["legal", "bank", "bank"])
        for _ in range(400 if page == 0 else rng.randint(1, 6)):
            rows.append((i, "t", f"{kind}-{page:08d}" if page % 50 else f"{kind.upper()}_{page:08d}.png", "p", None, T0))
            i += 1
    rows += [(i, "t", None, None, None, T0), (None, "t", rows[0][2], "p", None, T0), (0, "t", rows[0][2], "p", None, T0)]
    pages = sorted({r[2].lower().replace("_", "-").replace(".png", "") for r in rows if r[2]})
    links = [(pages[k], pages[k + 1], "k", T0) for k in range(0, 60, 3)]
    crops, ties = spark.createDataFrame(rows, CROPS), spark.createDataFrame(links, LINKS)
    targets = spark.createDataFrame(TARGETS, "split string, share double")
    out = splits.assign_splits(crops, ties, targets).collect()
    assert len(out) == i + 1 and len({r.crop_id for r in out}) == i + 1
    where = {}
    for r in out:
        assert where.setdefault(r.doc or r.crop_id, r.split) == r.split
    assert all(where[a] == where[b] for a, b, *_ in links)
    for name, share in TARGETS:
        assert abs(sum(r.split == name for r in out) / len(out) - share) < 0.03
    assert splits.assign_splits(crops.limit(0), ties, targets).count() == 0


def sized(spark, sizes):
    return spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, tokens long")


def test_mixing(spark):
    rng = random.Random(1)
    sizes = [(rng.choice(["a", "a", "a", "b", "c", None, "other"]), rng.randint(20, 600)) for _ in range(3000)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("B ", 0.3, 3), ("c", 0.2, 2), ("empty", 0.0, 5)], "source string, target_share double, max_repeats int")
    z = sized(spark, sizes)
    mixed = mixing.mix_sources(z, targets).cache()
    assert mixed.count() == len(sizes)
    assert mixed.where("source not in ('a', 'b', 'c') or source is null").agg(F.sum("copies")).first()[0] == 0
    report = {r.source: r for r in mixing.mix_report(mixed, targets).collect()}
    for name, share, cap in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)):
        assert abs(report[name].actual_share - share) < 0.02 and report[name].most_copies <= cap
    big = {r.source: r for r in mixing.mix_report(mixing.mix_sources(z, targets, 10**9), targets).collect()}
    assert (big["a"].most_copies, big["b"].most_copies, big["c"].most_copies) == (1, 3, 2)
    assert mixing.mix_sources(z.limit(0), targets).count() == 0
    assert mixing.mix_sources(z, targets.limit(0)).agg(F.sum("copies")).first()[0] == 0


def test_sized_texts_skip_blanks(spark):
    d = spark.createDataFrame([(1, "two words", "Clinic-Scans "), (2, " \n", "a"), (3, None, "a"), (4, "x", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.source, r.tokens) for r in mixing.sized_texts(d).collect()} == {(1, "clinic_scans", 2), (4, None, 1)}


@pytest.mark.parametrize("capacity,low,high,n", [(100, 1, 100, 300), (100, 20, 70, 120), (50, 26, 50, 40), (1000, 1, 30, 500), (10, 10, 10, 5), (100, 1, 1, 0)])
def test_bin_completion(capacity, low, high, n):
    rng = random.Random(capacity + n)
    sizes = [rng.randint(low, high) for _ in range(n)]
    bins, proven = packing.bin_completion(sizes, capacity)
    assert not proven or len(bins) >= packing.lower_bound(sizes, capacity)
    assert sorted(s for b in bins for s in b) == sorted(sizes) and all(sum(b) <= capacity for b in bins)
    bound = packing.lower_bound(sizes, capacity)
    assert bound <= len(bins) <= len(packing.best_fit_decreasing(sorted(sizes, reverse=True), capacity))


def test_bin_completion_beats_best_fit():
    sizes = [51, 27, 22, 52, 26, 22, 50, 28, 22]  # three perfect triples
    bins, proven = packing.bin_completion(sizes, 100)
    assert len(bins) == 3 and proven


def fewest_bins(sizes, capacity):
    """By dynamic programming over all subsets: (containers, room used in the last), least first."""
    best = {0: (1, 0)}
    for subset in range(1, 1 << len(sizes)):
        options = []
        for i, s in enumerate(sizes):
            if subset >> i & 1:
                bins, used = best[subset ^ 1 << i]
                options.append((bins, used + s) if used + s <= capacity else (bins + 1, s))
        best[subset] = min(options)
    return best[(1 << len(sizes)) - 1][0] if sizes else 0


def test_search_to_the_end_is_the_optimum():
    rng = random.Random(12)
    for n in range(1000):
        low, high = rng.choice([(12, 45), (1, 60), (26, 51), (5, 30)])
        sizes = [rng.randint(low, high) for _ in range(8 if n % 25 else 12)]
        bins, proven = packing.bin_completion(sizes, 100, None)
        assert proven and len(bins) == fewest_bins(sizes, 100) and sorted(s for b in bins for s in b) == sorted(sizes) and max(map(sum, bins)) <= 100


def test_fillings_are_all_undominated_ones():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(3, 20) for _ in range(9)]
        room = rng.randint(5, 50)
        stock = packing._Stock(sizes)
        got = {tuple(sorted(f)) for f in stock.fillings(room, 0)}
        feasible = {tuple(sorted(s for i, s in enumerate(sizes) if m >> i & 1)) for m in range(1 << 9)}
        feasible = {f for f in feasible if sum(f) <= room}
        assert got <= feasible and max(map(sum, feasible)) == max(map(sum, got))
        counts = {s: sizes.count(s) for s in sizes}
        best = {f for f in feasible if not packing._dominated(f, room - sum(f), sorted(counts), counts)}
        assert best <= got or (room,) in got


def test_pack_texts(spark):
    rng = random.Random(4)
    sizes = [rng.choice([0, 1, 99, 100, 101, 250, rng.randint(1, 400)]) for _ in range(500)]
    z = spark.createDataFrame(list(enumerate(sizes)) + [(9999, None), (None, 50)], "doc_id long, tokens long")
    specs = spark.createDataFrame([("s", 100), ("bad", 0), ("none", None)], "spec string, capacity_tokens int")
    rows = packing.pack_texts(z, specs, group_items=150).collect()
    pieces, fill = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.first_token, r.tokens))
        fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert set(pieces) == {i for i, s in enumerate(sizes) if s > 0}
    for i, parts in pieces.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == sizes[i] and len(parts) == -(-sizes[i] // 100)
    assert max(fill.values()) <= 100 and len(fill) <= sum(sizes) / 100 + 12
    checks = packing.packing_checks(packing.pack_texts(z, specs, group_items=150), z.where("doc_id is not null")).first()
    assert (checks.n_texts, checks.wrong_sizes, checks.overfull, checks.needless_cuts) == (len(pieces), 0, 0, 0)
    report = packing.packing_report(packing.pack_texts(z, specs, group_items=150)).first()
    assert report.containers == len(fill) and report.least_containers <= report.containers and report.proven_groups <= report.groups
    assert packing.pack_texts(z.limit(0), specs).count() == 0 and packing.pack_texts(z, specs.limit(0)).count() == 0


def test_clashing_extra_columns(spark):
    crops = spark.createDataFrame([(1, "x", "legal-1", "p", "train", T0), (2, "x", "legal-1", "p", "val", T0)], CROPS)
    extra = {n: F.lit("clash") for n in ("group", "kind", "text", "n", "size", "before", "record", "entity", "s", "source", "tokens", "__b", "flags")}
    links = spark.createDataFrame([("legal-1", "legal-2", "k", T0)], LINKS).withColumns({n: c for n, c in extra.items()})
    crops = crops.withColumns(extra)
    targets = spark.createDataFrame(TARGETS, "split string, share double").withColumns({"group": F.lit(1), "kind": F.lit("z")})
    assert [r.doc for r in splits.split_leaks(crops, links).collect()] == ["legal-1"]
    assert splits.assign_splits(crops, links, targets).count() == 2
    d = spark.createDataFrame([(1, "one two", "a"), (2, "three", "a")], "doc_id long, text string, source string").withColumns({n: F.lit("clash") for n in ("tokens", "unit", "before", "piece", "part", "m", "lo")})
    z = mixing.sized_texts(d)
    assert packing.pack_texts(z, spark.createDataFrame([("s", 10, "x")], "spec string, capacity_tokens int, part string")).count() == 2
    t = spark.createDataFrame([("a", 1.0, 2, "x")], "source string, target_share double, max_repeats int, rate string")
    assert mixing.mix_sources(z, t).count() == 2
