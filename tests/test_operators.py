"""Operators on small tables: ties, nulls, empty input."""

import random

import pytest
from pyspark.sql import functions as F

from foliolake.operators import align, corpus, evaluation, fields, history, lexicon, policy, speech
from foliolake.operators.prefix import prefix_sums

RECORDS = "record_id long, doc string, profile string, expected_category string, category string, expected_fields array<string>, fields array<string>, expected_text string, ocr_text string, error string"


@pytest.fixture(scope="module")
def scored(spark):
    rows = [
        (1, "a", "clean", "medical", "medical", ["500mg", "400mg"], ["500MG"], "take two", "take two", None),
        (2, "b", "clean", "legal", None, None, None, None, None, None),
        (3, "c", "worst_case", "legal", "legal", ["x1234"], ["1234"], "a b", "a c", "timeout"),
    ]
    return evaluation.record_scores(spark.createDataFrame(rows, RECORDS))


def test_record_scores(scored):
    r = {x.record_id: x for x in scored.collect()}
    assert (r[1].n_expected, r[1].n_recovered, r[1].class_ok, r[1].word_acc, r[1].cer) == (2, 1, 1, 1.0, 0.0)
    assert (r[2].class_ok, r[2].word_acc, r[2].cer) == (0, 0.0, 0.0)
    assert (r[3].n_expected, r[3].n_recovered, r[3].class_ok, r[3].cer) == (1, 0, 0, 0.0)


def test_profile_scopes(scored):
    r = {(x.scope, x.profile): x for x in evaluation.by_profile(scored).collect()}
    assert r["all", None].n == 3 and r["headline", None].n == 2 and r["sub_human", None].errors == 1
    assert r["all", None].field_recovery == pytest.approx(1 / 3)
    assert evaluation.by_profile(scored.limit(0)).count() == 0


def test_compare_runs(spark):
    items = lambda rows: spark.createDataFrame(rows, "metric string, item string, ok boolean")
    old = items([("m", str(i), i < 2) for i in range(12)] + [("gone", "1", True)] + [("w", str(i), False) for i in range(40)])
    new = items([("m", str(i), True) for i in range(12)] + [("fresh", "1", True)] + [("w", str(i), True) for i in range(41)])
    r = {x.metric: x for x in evaluation.compare_runs(old, new).collect()}
    assert (r["m"].method, r["m"].lost, r["m"].won, r["m"].verdict) == ("mcnemar", 0, 10, "IMPROVED")
    assert (r["w"].method, r["w"].verdict) == ("wilson", "IMPROVED")
    assert r["gone"].verdict == "N/A (only in old)" and r["fresh"].verdict == "N/A (only in new)"


def test_pair_lines():
    assert align.pair_lines(["A", "x", "B"], ["a", "B", "c"]) == [(0, 0), (1, 2), (2, 1)]
    assert align.pair_lines([], ["a"]) == [(0, None)]
    assert align.pair_lines(["T", "T"], ["T"]) == [(0, 0), (None, 1)]


def test_align_lines_counts_every_line(spark):
    rows = [("p", "want", i, t) for i, t in enumerate(["a", None, "c"])] + [("p", "got", i, t) for i, t in enumerate(["c", "z"])]
    df = spark.createDataFrame(rows, "page_id string, side string, line_index int, text string")
    for method in ("monotone", "difflib"):
        out = align.align_lines(df, method).collect()
        assert sorted(r.want_index for r in out if r.want_index is not None) == [0, 1, 2]
        assert sorted(r.got_index for r in out if r.got_index is not None) == [0, 1]
    assert align.align_lines(df.limit(0)).count() == 0


def test_match_boxes_is_greedy_one_to_one(spark):
    box = "page_id string, id int, y0 int, y1 int"
    a = spark.createDataFrame([("p", 1, 0, 100), ("p", 2, 90, 200)], box)
    b = spark.createDataFrame([("p", 7, 0, 100), ("p", 8, 10, 100), ("p", 9, 300, 310)], box)
    assert [(r.a_id, r.b_id) for r in align.match_boxes(a, b, 0.5).collect()] == [(1, 7)]


def test_as_of_join(spark):
    pts = spark.createDataFrame([(1, "k", 5), (2, "k", 1), (3, "z", 9)], "id int, k string, t int")
    marks = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 6, None)], "k string, at int, v string")
    assert {(r.id, r.v) for r in align.last_at_or_before(pts, marks, "k", "t", "at", "v").collect()} == {(1, "b"), (2, None), (3, None)}


def test_prefix_sums(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "a", "a", None]), rng.choice([None, 1, 2, 5])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, k string, n long")
    out = prefix_sums(df, "k", "n", F.floor(F.col("id") / 50), [F.col("id")], "before")
    got = {r.id: r.before for r in out.collect()}
    run = {}
    for i, k, n in rows:
        assert got[i] == run.get(k, 0)
        run[k] = run.get(k, 0) + (n or 0)


def test_positional_split_rounds_half_to_even(spark):
    for n in (1, 7, 10, 25):
        df = spark.range(n).withColumnRenamed("id", "k")
        got = [r.split for r in corpus.positional_split(df, "k").orderBy("k").collect()]
        t, v = max(1, round(0.7 * n)), max(1, round(0.15 * n))
        assert got == (["train"] * t + ["val"] * v + ["test"] * n)[:n]


def test_hashed_split_keeps_keys_together(spark):
    df = spark.range(500).withColumn("k", F.col("id") % 37)
    assert corpus.split_leaks(corpus.hashed_split(df, "k"), "k").count() == 0


def test_histogram_and_runs(spark):
    df = spark.createDataFrame([(1,), (4,), (4,), (None,)], "v int")
    assert [(r.value, r.n) for r in corpus.dense_histogram(df, "v").orderBy("value").collect()] == [(1, 1), (2, 0), (3, 0), (4, 2)]
    assert corpus.dense_histogram(df.where("v > 9"), "v").count() == 0
    r = corpus.runs(spark.createDataFrame([("a", i) for i in (1, 2, 4, 9)], "k string, p int"), "k", "p", F.lit(True), 2)
    assert [(x.start, x.end) for x in r.orderBy("start").collect()] == [(1, 4), (9, 9)]


def test_otsu(spark):
    h = spark.createDataFrame([("a", 10, 50), ("a", 11, 5), ("a", 200, 40), ("b", 7, 3)], "k string, bin int, n long")
    assert {r.k: r.threshold for r in corpus.otsu_threshold(h, "k").collect()} == {"a": 11, "b": 7}


def test_first_wins(spark):
    df = spark.createDataFrame([(2, " Ab"), (1, "aB "), (3, None)], "id int, t string")
    assert {(r.id) for r in corpus.first_wins(df, corpus.case_blind_key(F.col("t")), ["id"]).collect()} == {1, 3}


def test_nearest_profile(spark):
    p = spark.createDataFrame([("a", 0.0), ("b", 10.0)], "name string, x double")
    q = spark.createDataFrame([(1, 2.0), (2, 8.0)], "id int, x double")
    assert {(r.id, r.name) for r in corpus.nearest_profile(q, p, ["x"], "id", "name").collect()} == {(1, "a"), (2, "b")}
    assert corpus.nearest_profile(q, p.limit(0), ["x"], "id", "name").count() == 0


def test_lexicon(spark):
    t = spark.createDataFrame([(["a", "b", "a"],), (["b", "a"],), ([],), (None,)], "tokens array<string>")
    assert {(r.prev, r.next, r.n) for r in lexicon.bigram_counts(t).collect()} == {("a", "b", 1), ("b", "a", 2)}
    counts = lexicon.word_counts(t)
    assert {(r.word, r.n) for r in counts.collect()} == {("a", 3), ("b", 2)}
    pw = lexicon.prefix_weights(spark.createDataFrame([("an", 2), ("and", 3)], "word string, n long"))
    assert {(r.prefix, r.pass_weight, r.word_weight) for r in pw.collect()} == {("a", 5, 0), ("an", 5, 2), ("and", 3, 3)}
    cov = lexicon.coverage(counts, spark.createDataFrame([("a",), ("a",)], "word string")).first()
    assert (cov.types, cov.tokens, cov.type_coverage, cov.token_coverage) == (2, 5, 0.5, 0.6)
    assert lexicon.coverage(counts.limit(0), counts).first().token_coverage == 0.0


def test_longest_match_prefers_longer_then_earlier(spark):
    lex = spark.createDataFrame([("ACME", 1), ("ACME BANK", 2), ("BETA BANK", 3)], "name string, seq int")
    t = spark.createDataFrame([(1, "PAY ACME BANK OR BETA BANK"), (2, "ACMES"), (3, None)], "id int, t string")
    assert [(r.id, r.name) for r in lexicon.longest_match(t, "id", "t", lex).collect()] == [(1, "ACME BANK")]


def test_spot_labels():
    labels = ["SORT CODE", "TERM", "ACCOUNT NUMBER"]
    assert [(s[0], s[3]) for s in fields.spot_labels("S0RT C0DE: 40-11-04", labels)] == [("SORT CODE", 1.0)]
    assert fields.spot_labels("TERMINAL", labels) == []
    assert fields.spot_labels("", labels) == []
    assert [s[0] for s in fields.spot_labels("ACCOUNT NUMBR 1", labels)] == ["ACCOUNT NUMBER"]


def test_proximity_values(spark):
    lines = spark.createDataFrame(
        [("p", 0, "Sort Code: 40-11-04 Date: 31/02/2026"), ("p", 1, "Case Number"), ("p", 2, "2024-CV-00456"), ("p", 3, "Balance"), ("q", 0, None)],
        "page_id string, line_index int, text string",
    )
    out = {r.field: r for r in fields.proximity_values(lines, fields.spots(lines)).collect()}
    assert (out["sort_code"].value, out["sort_code"].ok) == ("40-11-04", True)
    assert (out["date"].value, out["date"].reason) == ("31/02/2026", "not a calendar date")
    assert (out["case_number"].value, out["case_number"].provenance) == ("2024-CV-00456", "next-line")
    assert (out["balance"].reason, out["balance"].provenance) == ("no value found after label", "none")


def test_typed_values():
    found = [(k, v, a) for k, _, _, _, v, a in fields.typed_values("Pay GBP 2,401.02 by 2024-03-15 or 03/04/2024 or 13/04/2024, 500mg, no 4021887719")]
    assert found == [
        ("money", "2401.02", False), ("date", "2024-03-15", False), ("date", None, True), ("date", "2024-04-13", False),
        ("dosage", "500mg", False), ("account", "4021887719", False),
    ]


def test_amounts(spark):
    df = spark.createDataFrame([("1,234.56",), ("1.234,56",), ("1,234",), ("12,5",), ("x",), (None,)], "v string")
    got = [(None if r.r.value is None else str(r.r.value), r.r.ambiguous) for r in df.select(fields.amount_of(F.col("v")).alias("r")).collect()]
    assert got == [("1234.56", False), ("1234.56", False), ("1234.00", True), ("12.50", True), (None, False), (None, False)]


def test_reconcile(spark):
    rows = [
        ("p", "total", "GBP 2.00", "money", "a"), ("p", "total", "£2.00", "money", "b"), ("p", "day", "15/01/2024", "date", "a"),
        ("p", "day", "16/01/2024", "date", "b"), ("p", "who", "Jane Doe", "general", "a"), ("p", "bad", None, "money", "b"),
    ]
    out = policy.reconcile(policy.candidates(spark.createDataFrame(rows, "page_id string, field string, value string, kind string, source string")))
    got = {(r.field, r.verdict, r.source) for r in out.collect()}
    assert got == {("total", "agreed", "both"), ("day", "conflict", "a"), ("day", "conflict", "b"), ("who", "single", "a"), ("bad", "invalid", "b")}


def test_chunks():
    assert speech.chunk("One. Two! Three?", 10) == ["One. Two!", "Three?"]
    assert speech.chunk("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert speech.chunk(None) == [] and speech.chunk("  ") == []


def test_history(spark):
    s = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "id int, v int, x string")
    n = spark.createDataFrame([(1, 2, "c"), (2, 5, "d"), (3, None, "e")], "id int, v int, x string")
    assert {(r.id, r.x) for r in history.upsert_latest(s, n, "id", "v").collect()} == {(1, "c"), (2, "d"), (3, "e")}
    assert history.delete_keys(s, n, "id").count() == 0


def test_value_hits(spark):
    said = spark.createDataFrame([("p", "ending 8877"), ("p", "500mg"), ("q", "zzzz"), ("r", None)], "page string, value string")
    true = spark.createDataFrame([("p", "500MG"), ("p", "400mg"), ("s", "x1")], "page string, value string")
    got = {r.page: (r.spoken, r.truths, r.hits, r.recovered, r.wrong) for r in evaluation.value_hits(said, true, "page").collect()}
    assert got == {"p": (2, 2, 1, 1, 1), "q": (1, 0, 0, 0, 1), "r": (0, 0, 0, 0, 0), "s": (0, 1, 0, 0, 0)}
    assert {(r.page, r.value) for r in evaluation.wrong_values(said, true, "page").collect()} == {("p", "ending 8877"), ("q", "zzzz"), ("r", None)}


def test_edit_pairs():
    assert evaluation.edit_pairs("abc", "axc") == [("a", "a"), ("b", "x"), ("c", "c")]
    assert evaluation.edit_pairs("", "x") == [("", "x")] and evaluation.edit_pairs("ab", "b") == [("a", ""), ("b", "b")]


def test_bootstrap_ci(spark):
    df = spark.createDataFrame([("a", float(i % 2)) for i in range(400)] + [("b", 1.0), ("b", None)], "k string, v double")
    r = {x.k: x for x in evaluation.bootstrap_ci(df, "k", "v", 2000).collect()}
    assert r["a"].mean == 0.5 and 0.43 < r["a"].low < 0.47 and 0.53 < r["a"].high < 0.57
    assert (r["b"].low, r["b"].high) == (1.0, 1.0)


def test_elect_best(spark):
    rows = [("p", 1, 2, 0.9, "x"), ("p", 2, 3, None, "y"), ("p", 3, 3, 0.5, "z"), ("p", 4, 3, 0.5, "w"), ("p", 5, 9, 1.0, " ")]
    df = spark.createDataFrame(rows, "k string, rank int, structure int, conf double, t string")
    assert [r.t for r in evaluation.elect_best(df, "k", "structure", "conf", "rank", "t").collect()] == ["z"]


def test_grid_components(spark):
    from foliolake.operators.graph import grid_components

    cells = [(0, 0), (0, 1), (1, 1), (3, 3), (3, 4), (5, 0), (2, 2)]
    df = spark.createDataFrame([("g", r, c) for r, c in cells] + [("h", 0, 1), ("g", None, 1)], "k string, row int, col int")
    out = grid_components(df, "k").collect()
    assert len({r.component for r in out}) == 5 and len(out) == 8
    same = {(r.row, r.col): r.component for r in out if r.k == "g"}
    assert same[0, 0] == same[1, 1] != same[2, 2] and same[3, 3] == same[3, 4]


def test_carriers_and_confidence(spark):
    lines = spark.createDataFrame([("p", 0, "Total"), ("p", 1, "GBP 2.00 x"), ("p", 2, "gbp 2.00")], "page_id string, line_index int, text string")
    vals = spark.createDataFrame([("p", "GBP 2.00"), ("p", "none"), ("q", "x")], "page_id string, value string")
    assert [(r.value, r.line_index) for r in align.carrier_lines(vals, lines).collect()] == [("GBP 2.00", 1)]
    words = spark.createDataFrame([("p", "gbp", 0.9), ("p", "2.00", None)], "page_id string, word string, confidence double")
    f = spark.createDataFrame([("p", "total", "GBP 2.00"), ("p", "first", "GBP"), ("p", "no", "")], "page_id string, field string, value string")
    assert {(r.field, r.confidence) for r in align.local_confidence(f, words).collect()} == {("total", 0.0), ("first", 0.9), ("no", 0.0)}
