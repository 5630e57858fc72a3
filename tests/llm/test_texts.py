"""Overlaps, shared spans and page repair against brute force."""

import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from foliolake.llm import layout, overlap, repair, spans, tries

T0 = datetime(2025, 1, 1)
CROPS = "crop_id long, labels string, doc string, split string, loaded_at timestamp_ntz"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def noisy(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], [rng.choice("abcxyz019")], [t[i], rng.choice("abcxyz")]])
    return "".join(t)


def test_overlaps_are_complete(spark):
    rng = random.Random(8)
    rows = []
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    for i in range(150):
        base = "Dispensed by " + " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) + f" ref {rng.randrange(10**6)}"
        for k in range(3):
            rows.append((len(rows), noisy(rng, base, rng.randint(0, 8)) if k else base, "d-1", rng.choice(["train", "TRAIN ", "val", "test", None, ""]), T0))
    rows += [(900, None, "d-1", "train", T0), (901, "short", "d-1", "val", T0), (902, "SHORT", "d-1", "train", T0), (903, "é" * 40, "d-2", "val", T0)]
    long = "".join(rng.choice("abcdefghij") for _ in range(900))
    rows += [(910, long, "d", "train", T0), (911, noisy(rng, long, 80), "d", "test", T0)]
    for i in range(12):  # texts of several segments, and all lengths with few windows
        base = "".join(rng.choice("abc") for _ in range(rng.choice([125, 180, 241, 300])))
        rows += [(1000 + 2 * i, base, "d", "train", T0), (1001 + 2 * i, noisy(rng, base, rng.randint(5, 32)), "d", "val", T0)]
    for i in range(120):
        base = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(24, 36)))
        rows += [(2000 + 2 * i, base, "d", "train" if i % 2 else "val", T0), (2001 + 2 * i, noisy(rng, base, rng.randint(1, 4)), "d", "test" if i % 2 else "train", T0)]
    rows += [(920 + i, "Same label on very many crops 12345", "d", "train" if i % 2 else "val", T0) for i in range(8)]
    rows += [rows[0], (rows[1][0], rows[1][1], "d", rows[1][3], T0)]
    rows += [(None, "Same label on very many crops 12345", "d", s, T0) for s in ("train", "val")]
    from foliolake.llm.pages import split_name  # noqa: F401  the spellings under test

    kind = lambda s: {"train": "train", "val": "held", "test": "held"}.get((s or "").strip().lower())
    clean = {i: ("".join(c for c in t.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789"), kind(s)) for i, t, _, s, _ in rows if t is not None and i is not None}
    live = [(i, t, k) for i, (t, k) in clean.items() if len(t) >= 24 and k]
    want = {
        (min(i, j), max(i, j))
        for i, a, k in live if k == "train"
        for j, b, m in live if m == "held" and abs(len(a) - len(b)) <= max(len(a), len(b)) // 10 and distance(a, b) <= max(len(a), len(b)) // 10
    }
    df = spark.createDataFrame(rows, CROPS)
    got = [(r.crop_a, r.crop_b) for r in overlap.overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    report = overlap.overlap_report(df).collect()
    assert sum(r.n_pairs for r in report) == len(want)
    cover = overlap.record_coverage(df).collect()
    assert sum(r.n_pairs for r in cover) == len(want) and all((r.coverage >= 0.8) == (r.n_pairs > 0) for r in cover)
    classes = {r.crop_id: r for r in overlap.overlap_classes(df).collect()}
    assert set(classes) == {i for i, _, _ in live} and sum(r.n_links for r in classes.values()) == 2 * len(want)
    links = {(r.train_class, r.held_class) for r in overlap.overlap_links(df).collect()}
    text = {i: t for i, t, _ in live}
    side = {i: k for i, _, k in live}
    assert all(text[r.class_id] == text[i] and r.class_id <= i for i, r in classes.items())
    assert links == {(classes[t].class_id, classes[h].class_id) for p in want for t, h in (p, p[::-1]) if side[t] == "train" and side[h] == "held"}
    assert overlap.overlaps(df.limit(0)).count() == 0 and overlap.overlap_classes(df.limit(0)).count() == 0


def test_hot_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_CROPS", 7)
    monkeypatch.setattr(overlap, "HOT", 3)
    rows = [(i, "the very same label on many crops" + ("x" if i % 5 == 0 else ""), "d-1", "train" if i % 3 else "val", T0) for i in range(90)]
    df = spark.createDataFrame(rows, CROPS)
    want = {(min(i, j), max(i, j)) for i in range(90) if i % 3 for j in range(90) if j % 3 == 0}
    got = [(r.crop_a, r.crop_b) for r in overlap.overlaps(df).collect()]
    assert len(got) == len(want) and set(got) == want
    assert sum(r.n_links for r in overlap.overlap_classes(df).collect()) == 2 * len(want)
    assert sum(r.n_pairs for r in overlap.record_coverage(df).collect()) == len(want)


def test_chain_cost(spark):
    def price(seeds, a, b):
        df = spark.createDataFrame([(sorted(seeds),)], "seeds array<struct<win:int,at:int,shift:int>>")
        return df.select(overlap.chain_cost(F.col("seeds"), F.lit(overlap.most_edits(np.array([a])).item() + 1), F.lit(a - b))).first()[0]

    # 40 characters allow 4 edits, so there are 5 windows.
    assert price([(2, 16, 0)], 40, 40) == 4
    assert price([(w, 8 * w, 0) for w in range(5)], 40, 40) == 0
    assert price([(0, 0, 0), (4, 33, -1)], 40, 41) == 3
    assert price([(0, 30, -30), (4, 0, 32)], 40, 40) > 4


def test_kept_stretches():
    assert overlap.kept_stretches("abcdef", "abXdef", 1) == [(0, 2), (3, 6)]
    assert overlap.kept_stretches("abcdef", "abcdef", 0) == [(0, 6)]
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(5, 30)))
        b = noisy(rng, a, rng.randint(0, 4)) or "a"
        d = distance(a, b)
        kept = sum(y - x for x, y in overlap.kept_stretches(a, b, d))
        assert kept >= len(b) - d


def test_disjoint_choice_is_least():
    rng = np.random.default_rng(3)
    cost = rng.integers(0, 50, size=(40, 18))
    picked = overlap.choose_disjoint(cost, 3, 7)
    for row, at in zip(cost, picked):
        assert all(b - a >= 7 for a, b in zip(at, at[1:]))
        best = min(row[a] + row[b] + row[c] for a in range(18) for b in range(a + 7, 18) for c in range(b + 7, 18))
        assert row[at].sum() == best


DOCS = "doc_id long, text string"


def shared_by_force(rows, length):
    seen, twice = {}, set()
    for i, t in rows:
        for k in range(len(t or "") - length + 1):
            g = t[k : k + length]
            if seen.setdefault(g, i) != i:
                twice.add(g)
    out = set()
    for i, t in rows:
        at = None
        for k in range(len(t or "") - length + 1):
            if t[k : k + length] in twice:
                if at and k <= at[1]:
                    at[1] = k + length
                else:
                    if at:
                        out.add((i, *at))
                    at = [k, k + length]
        if at:
            out.add((i, *at))
    return out


def test_shared_spans(spark):
    rng = random.Random(6)
    letter = lambda n, abc="abcdefgh ": "".join(rng.choice(abc) for _ in range(n))
    passages = [letter(rng.randint(30, 160)) for _ in range(12)] + ["é€𝄞" * 20, "ab" * 60]
    rows = [(i, "".join(rng.choice([letter(rng.randint(0, 60)), rng.choice(passages)]) for _ in range(rng.randint(0, 7)))) for i in range(80)]
    rows += [(100, rows[3][1] * 2), (101, rows[3][1]), (102, None), (103, ""), (104, "x" * 500), (105, letter(200)), (106, "x" * 45), (None, rows[5][1] * 9), (107, "y" * 300 + "z")]
    df = spark.createDataFrame(rows, DOCS)
    want = shared_by_force([r for r in rows if r[0] is not None], 40)
    got = [tuple(r) for r in spans.shared_spans(df, 40, 20).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 40
    report = {r.doc_id: r for r in spans.shared_report(df, spans.shared_spans(df, 40, 20)).collect()}
    assert len(report) == len(rows) and report[102].n_chars == 0
    assert report[101].shared_chars == sum(e - s for i, s, e in want if i == 101)
    assert spans.shared_spans(df.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**63), min_size=5, max_size=60), st.integers(1, 5))
def test_sliding_min(values, w):
    h = np.array(values, dtype=np.uint64)
    assert spans.sliding_min(h, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", max_size=7), max_size=40), st.text("abcd", max_size=8), st.sampled_from([1, 2, 3, 4]))
def test_automaton_walk_is_complete(words, word, most):
    words = sorted(set(words))
    got = tries.within(tries.build_trie(words), word, most)
    assert sorted(got) == sorted((v, distance(v, word)) for v in words if distance(v, word) <= most)


PAGE = """Ruafax Mutual  |  Statement
The quick brown fox jumps over the la-
zy dog. Clause XATF-
PAGE 1
Ruafax Mutua1  |  Statemcnt
K2-99 was slgned by both par
ties on 1 May 2020, and the rest follows.
PAGE 2"""
TRUE = "The quick brown fox jumps over the lazy dog. Clause XATF-K2-99 was signed by both parties on 1 May 2020, and the rest follows."


def kinds(page):
    return sorted([(i, k) for i, k in enumerate(page["kinds"]) if k in ("header", "page_no")] + [(i, "break") for i in page["breaks"]] + [(i, "misread") for i in page["wrong"]])


def test_read_page_with_reference():
    want = [(0, "header"), (1, "break"), (2, "break"), (3, "page_no"), (4, "header"), (5, "break"), (5, "misread"), (7, "page_no")]
    assert kinds(layout.read_page(PAGE, layout.reference_of(TRUE), frozenset(), set())) == want


def test_read_page_without_reference():
    frames = frozenset(["mutual statement$", "^ruafax mutual"])
    page = layout.read_page(PAGE, None, frames, {"parties", "lazy"})
    assert (0, "header") in kinds(page) and (1, "break") in kinds(page) and (5, "break") in kinds(page)
    assert " ".join(layout.reflow(layout.read_page(PAGE, layout.reference_of(TRUE), frozenset(), set()), {"lazy", "parties"})).startswith("The quick brown fox jumps over the lazy dog. Clause XATF-K2-99 was")


@pytest.mark.parametrize("text", ["", "\n\n", "12", "PAGE 3", "x", "-\n-", "​"])
def test_read_page_odd_texts(text):
    for ref in (None, "", "some text", "12"):
        page = layout.read_page(text, ref and layout.reference_of(ref), frozenset(), set())
        assert len(page["lines"]) == text.count("\n") + 1
        layout.reflow(page, set())


def lines_wrong(text, true):
    return layout.read_page(text, layout.reference_of(true), frozenset(), frozenset())["wrong"]


def test_long_foreign_parts_spoil_nothing():
    rng = random.Random(1)
    word = lambda abc: "".join(rng.choice(abc) for _ in range(rng.randint(3, 9)))
    own = [" ".join(word("abcdefgh") for _ in range(8)) for _ in range(60)]
    foreign = [" ".join(word("stuvwxyz") for _ in range(8)) for _ in range(200)]
    true = " ".join(own)
    assert lines_wrong("\n".join(own), true) == set()
    bad = own[30].replace(own[30].split()[4], own[30].split()[4][:-1] + "z")
    assert lines_wrong("\n".join(own[:20] + foreign + own[20:30] + [bad] + own[31:]), true) == {230}
    assert lines_wrong("\n".join(own[:20] + own[40:]), true) == set()
    assert lines_wrong("\n".join(foreign), true) == set()


@pytest.mark.parametrize(
    "lines,true,breaks,wrong",
    [
        (["the batch is", "due"], "The batch is due", [], []),
        (["the bat-", "ch is due"], "The batch is due", [0], []),
        (["the bat", "ch is due"], "The batch is due", [0], []),
        (["the b0t-", "ch is due"], "The batch is due", [0], [0]),
        (["the bat-", "cn is due"], "The batch is due", [0], [1]),
        (["the batc", "is due now"], "The batch is due now", [], [0]),
        (["the batch is du"], "The batch is due", [], [0]),
        (["the batcch is", "due"], "The batch is due", [], [0]),
        (["made 0r 2012 by", "hand"], "made on 2012 by hand", [], [0]),
        (["ma de on 2012 by", "hand"], "made on 2012 by hand", [], []),
        (["madeon 2012 by", "hand"], "made on 2012 by hand", [], []),
    ],
)
def test_verdicts_come_from_candidates(lines, true, breaks, wrong, monkeypatch):
    tokens = [[layout.solid(t) for t in x.split()] for x in lines]
    assert tuple(map(sorted, layout.compare(tokens, layout.reference_of(true)))) == (breaks, wrong)
    if wrong:  # without the search nothing is misread
        monkeypatch.setattr(layout, "within", lambda *a: [])
        assert not layout.compare(tokens, layout.reference_of(true))[1]


ENGINE = "record_id long, doc string, profile string, expected_text string, ocr_text string, loaded_at timestamp_ntz"


def test_page_lines_and_repaired_texts(spark):
    rows = [(i, f"d{i % 7}", "p", TRUE, PAGE, T0) for i in range(14)] + [(50, "d1", "p", None, PAGE, T0), (51, "zz", "p", None, None, T0), (52, None, None, None, "", T0)]
    rows.append(rows[0])
    df = spark.createDataFrame(rows, ENGINE)
    out = [tuple(r) for r in repair.page_lines(df).collect()]
    assert len(out) == len(set(out))
    per = {rid: sorted((n, k) for r, n, k in out if r == rid) for rid in (0, 50, 51, 52)}
    assert per[0] == kinds(layout.read_page(PAGE, layout.reference_of(TRUE), frozenset(), set()))
    assert per[50] == [x for x in per[0] if x[1] != "misread"] and per[51] == [] and per[52] == []
    texts = {r.record_id: r.repaired_text for r in repair.repaired_texts(df).collect()}
    assert len(texts) == 17 and texts[51] is None and texts[52] == ""
    assert "signed by both parties" in texts[3] and "Ruafax" not in texts[3]
    assert repair.page_lines(df.limit(0)).count() == 0 and repair.repaired_texts(df.limit(0)).count() == 0
