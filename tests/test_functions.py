"""Literal-row tests of the Column functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.functions import decode, metrics, text, validate


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("2O24-CV-OO456", "2024-CV-00456"), ("5OOmg", "500MG"), ("", "")])
def test_norm_label(spark, raw, want):
    assert one(spark, text.norm_label(F.col("v")), v=raw) == want


def test_nfkc(spark):
    assert one(spark, text.norm_label(F.col("v"), compose=True), v="５00ｍg") == "500MG"


@pytest.mark.parametrize("raw,want", [("S00m9", "500mg"), ("take 5m1 now", "take 5ml now"), ("50mg mg", "50mg"), ("Sunday", "Sunday")])
def test_repair_units(spark, raw, want):
    assert one(spark, text.repair_units(F.col("v")), v=raw) == want


@pytest.mark.parametrize(
    "kind,value,ok,reason",
    [
        ("sort_code", "40-11-0", False, "6 digits required, got 5"),
        ("sort_code", "40 11 04 ref", True, "ok"),
        ("date", "31/02/2026", False, "not a calendar date"),
        ("date", "15 January 2024", True, "ok"),
        ("date", "04021979", True, "ok"),
        ("date", "15 Foo 2024", False, "not a calendar date"),
        ("money", "GBP 12.4", False, "money needs two decimals, got 1"),
        ("money", "£1,234.50", True, "ok"),
        ("money", "1,23", False, "bad thousands grouping: 1,23"),
        ("account", "4521", True, "masked, last 4 digits only"),
        ("account", "123", False, "4-12 digits required, got 3"),
        ("dosage", "500mg twice", False, "unknown frequency: twice"),
        ("dosage", "500mg 3 times a day", True, "ok"),
        ("dosage", "5 parrots", False, "unknown unit: parrots"),
        ("identifier", "2024-CV-00456", True, "ok"),
        ("identifier", "a_b12", False, "invalid character in identifier: _"),
        ("general", " ", False, "empty value"),
        ("nonsense", "x", False, "unknown kind: nonsense"),
        ("date", None, False, "empty value"),
    ],
)
def test_validate(spark, kind, value, ok, reason):
    df = spark.createDataFrame([(kind, value)], "k string, v string")
    r = df.select(validate.validate(F.col("k"), F.col("v")).alias("r")).first().r
    assert (r.ok, r.reason) == (ok, reason)


@pytest.mark.parametrize(
    "kind,value,forms",
    [
        ("dosage", "AMOXICILLIN 500MG and 2.50 ml", ["2.5ml", "500mg"]),
        ("date", "2024-01-15", ["20240115"]),
        ("date", "15/01/2024", ["15012024"]),
        ("date", "15 January 2024", []),
        ("money", "£2,500", ["2500.00"]),
        ("account", "40 11 04", ["401104"]),
        ("general", "Jane Doe", ["janedoe"]),
        ("money", None, []),
    ],
)
def test_canonical(spark, kind, value, forms):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(validate.canonical(kind, F.col("v")).alias("r")).first().r == forms


def test_error_rates(spark):
    assert one(spark, metrics.cer_label(F.col("a"), F.col("b")), a="TOTAL 9.00", b="TOTAL 9.OO") == 0.0
    assert one(spark, metrics.cer_bench(F.col("a"), F.col("b")), a="", b="abc") == 3.0
    assert one(spark, metrics.cer_label(F.col("a"), F.col("b")), a="", b="abc") == 1.0
    assert one(spark, metrics.cer_receipt(F.col("a"), F.col("b")), a="", b="abc") is None
    assert one(spark, metrics.word_accuracy(F.col("a"), F.col("b")), a="a b a", b="A!") == pytest.approx(2 / 3)
    assert one(spark, metrics.set_word_accuracy(F.col("a"), F.col("b")), a="", b="x") == 1.0
    assert one(spark, metrics.edits_capped(F.col("a"), F.col("b"), 2), a="kitten", b="sitting") == 3
    assert one(spark, metrics.multiset_overlap(F.col("a"), F.col("b")), a=["x", "x", "y"], b=["x", "x", "x"]) == 2


def test_wilson_and_mcnemar(spark):
    ci = one(spark, metrics.wilson(F.col("k"), F.col("n")), k=8, n=10)
    assert (round(ci.low, 4), round(ci.high, 4)) == (0.4902, 0.9433)
    assert tuple(one(spark, metrics.wilson(F.col("k"), F.col("n")), k=0, n=0)) == (0.0, 0.0)
    p = lambda b, c: one(spark, metrics.mcnemar_exact("b", "c"), b=b, c=c)
    assert p(0, 0) == 1.0 and p(1, 9) == pytest.approx(22 / 1024) and 0 < p(900, 1152) < 1e-6


def test_recovered(spark):
    r = lambda e, g: one(spark, metrics.recovered(F.col("e"), F.col("g")), e=e, g=g)
    assert r("40218877", "8877") and not r("40218877", "877") and not r("1000", "0") and r("A-1", "a1")


def test_classifiers(spark):
    assert one(spark, text.density_class(F.col("v")), v="CARD PAYMENT AMOUNT DUE") == "general"
    assert one(spark, text.density_class(F.col("v")), v="balance of tablet") == "medical"
    assert one(spark, text.density_class(F.col("v"), "reader"), v="balance of tablet") == "banking"
    h = one(spark, text.hit_class(F.col("v")), v="prescription for the patient, one tablet")
    assert (h.category, h.hits) == ("medical", 3)
    assert one(spark, text.hit_class(F.col("v")), v="").category == "general"


def test_text_predicates(spark):
    assert one(spark, text.structure_score(F.col("v")), v="500mg 40-11-04 2024-CV-00456 12345678 GBP 2.00") == 6
    assert one(spark, text.is_garbage(F.col("v")), v="a b c d e f g h")
    assert one(spark, text.mask_digits(F.col("v")), v="4021-8877") == "••••-8877"
    assert one(spark, text.is_degenerate(F.col("v")), v="87654321") and not one(spark, text.is_degenerate(F.col("v")), v="12345679")
    assert one(spark, text.passes_luhn(F.col("v")), v="4539578763621486")
    assert one(spark, text.contains_word(F.col("v"), F.col("w")), v="take 5mg (daily)", w="5mg")
    assert not one(spark, text.contains_word(F.col("v"), F.col("w")), v="take 15mg", w="5mg")
    assert one(spark, text.value_to_right(F.col("v"), F.lit(9)), v="Sort Code: -40-11-04") == "-40-11-04"
    assert one(spark, text.error_kind(F.col("a"), F.col("b")), a="A1C", b="ABC") == "1-char: A8C->A1C"


def test_ctc_greedy(spark):
    assert one(spark, decode.decode_greedy(F.col("v")), v=[10, 0, 1, 0, 1]) == "900"
    assert one(spark, decode.decode_greedy(F.col("v")), v=[10, 0, 1, 1]) == "90"
    assert one(spark, decode.decode_greedy(F.col("v"), 1), v=[10, 0, 1, 1]) == "9"
    assert one(spark, decode.encode(F.col("v")), v="a0 B") == [1, 37, 12]


def test_beam_equals_greedy_on_sharp_scores():
    lp = np.full((5, 38), -20.0)
    for i, c in enumerate([10, 0, 1, 0, 1]):
        lp[i, c] = -0.01
    assert decode.beam_decode(lp, 4) == "900"
    # Two paths that add up beat the single best path.
    two = np.log(np.array([[0.4, 0.3, 0.3] + [1e-9] * 35, [0.4, 0.3, 0.3] + [1e-9] * 35]))
    assert decode.beam_decode(two, 8) in ("0", "1")


def test_vectors(spark):
    s = one(spark, decode.softmax(F.col("v")), v=[0.0, 0.0])
    assert s == [0.5, 0.5]
    assert math.isclose(sum(math.exp(x) for x in one(spark, decode.log_softmax(F.col("v")), v=[1.0, 2.0, 3.0])), 1.0)
    assert one(spark, decode.l2_normalise(F.col("v")), v=[3.0, 4.0]) == [0.6, 0.8]
    assert one(spark, decode.l2_normalise(F.col("v")), v=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, decode.mask_scores(F.col("v"), [2]), v=[1.0, 2.0, 3.0]) == [1.0, float("-inf"), 3.0]


@pytest.mark.parametrize("n,want", [(0, "零"), (10, "十"), (15, "十五"), (105, "一百零五"), (1020, "一千零二十"), (20300, "二萬零三百"), (-3, "負三")])
def test_chinese_numbers(n, want):
    assert text.chinese_number(n) == want


def test_wordpieces():
    vocabulary = {"play", "##ing", "##s", "a"}
    assert text.wordpieces(["playing", "plays", "zz", "a"], vocabulary) == ["play", "##ing", "play", "##s", "[UNK]", "a"]


def test_weighted_type(spark):
    w = one(spark, text.weighted_type(F.col("v")), v="CARD PAYMENT AMOUNT DUE")
    assert (w.type, w.score) == ("unrecognised", 2)
    assert one(spark, text.weighted_type(F.col("v")), v="Rx: tablet 5 mg").type == "prescription"


def test_legible(spark):
    assert one(spark, text.is_legible(F.col("v")), v=[0, 100, 100, 100]) and not one(spark, text.is_legible(F.col("v")), v=[100, 101])
