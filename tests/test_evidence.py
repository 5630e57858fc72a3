"""Values with evidence, word bigrams, digests and registries on small cases."""

import math

import pytest

from foliolake.operators import evidence, lexicon
from foliolake.plans import variants
from foliolake.streaming.progress import ProgressLog


@pytest.mark.parametrize("digits,ok", [("4111111111111111", True), ("4111111111111112", False), ("79927398713", False), ("000000000000", True), ("", False)])
def test_luhn(digits, ok):
    assert evidence.luhn(digits) is ok


@pytest.mark.parametrize("digits,bad", [("12345678", True), ("98765432", True), ("88888888", True), ("123", True), ("12345679", False), ("123456789012", False)])
def test_degenerate(digits, bad):
    assert evidence.degenerate(digits) is bad


def test_account_values():
    text = "Your account number 1234 5678 9012\nCard 4111 1111 1111 1111 due\nseen 20190401 and 99999999"
    rows = evidence.account_values(text)
    assert [r[2] for r in rows] == ["123456789012", "4111111111111111", "20190401"]  # equally sure: the first one leads
    account, card, bare = rows
    assert card[4] and card[5] and card[8] and card[3] == "•••• •••• •••• 1111"
    assert account[6] == ["account"] and account[7] == 0.75 and account[8]
    assert bare[6] == [] and bare[7] == 0.2 and not bare[8]
    # The line above says nothing about a number.
    assert evidence.account_values("account number\n20190401")[0][6] == []
    assert evidence.account_values("") == []


def test_extract_accounts(spark):
    df = spark.createDataFrame([(1, "account 1234 5678 9012"), (2, None), (3, "")], "doc long, text string")
    rows = evidence.extract_accounts(df, "doc", "text").collect()
    assert [(r.doc, r.rank, r.digits) for r in rows] == [("1", 0, "123456789012")]
    assert evidence.extract_accounts(df.limit(0), "doc", "text").count() == 0


def test_best_on_lines_and_sections(spark):
    lines = spark.createDataFrame([("p", 0, "Total 5.00"), ("p", 1, "TOTAL due 9.00"), ("p", 2, "subtotal 1.00")], "page_id string, line_index int, text string")
    values = spark.createDataFrame([("p", 0, "5.00", 0.5), ("p", 1, "9.00", 0.9), ("p", 2, "1.00", 0.95)], "page_id string, line_index int, value string, confidence double")
    best = evidence.best_on_lines(values, lines, "total", "subtotal").collect()
    assert [tuple(r) for r in best] == [("p", 1, "9.00", 0.9)]
    fields = spark.createDataFrame([("p", "b", "2"), ("p", "a", "1"), ("p", "z", "9")], "page_id string, field string, value string")
    got = [tuple(r) for r in evidence.in_section_order(fields, {"one": ["b"], "two": ["a"]}).orderBy("place").collect()]
    assert got == [("p", "one", 1, "b", "2"), ("p", "two", 2, "a", "1"), ("p", "other", 3, "z", "9")]


def test_reasons_freshness_digests(spark):
    checks = spark.createDataFrame([("k", True, "ok"), ("k", False, "bad"), ("k", None, None)], "kind string, ok boolean, reason string")
    assert {(r.reason, r.n) for r in evidence.reason_counts(checks, ["kind"]).collect()} == {("bad", 1), ("", 1)}
    stamped = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, stamp string")
    assert [r.id for r in evidence.fresh(stamped, "stamp", "a").collect()] == [1]
    lines = spark.createDataFrame([("f", 0, "x"), ("f", 1, None), ("g", 1, ""), ("g", 0, "x"), (None, 0, "x")], "file string, n int, body string")
    got = {r.file: r.digest for r in evidence.content_digests(lines, "file", "n", "body").collect()}
    assert set(got) == {"f", "g"} and got["f"] == got["g"] and len(got["f"]) == 12


def test_word_bigrams(spark):
    bigrams = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "b", 2)], "prev string, next string, n long")
    asked = spark.createDataFrame([("a", "b"), ("a", "x"), ("b", "b"), ("q", "a")], "prev string, next string")
    got = {(r.prev, r.next): r.logp for r in lexicon.word_bigram_logp(asked, bigrams).collect()}
    assert got["a", "b"] == pytest.approx(math.log(3.5 / 5.5)) and got["a", "x"] == pytest.approx(math.log(0.5 / 5.5))
    assert got["b", "b"] == 0 and got["q", "a"] == 0
    assert [(r.prev, r.next) for r in lexicon.top_bigrams(bigrams, 2, 1).collect()] == [("a", "b")]
    mixed = lexicon.combined_logp(spark.createDataFrame([(1.0, None), (2.0, 4.0)], "x double, y double"), {"x": 1.0, "y": 0.5}).collect()
    assert [r.logp for r in mixed] == [1.0, 4.0]


def test_variants():
    r = variants.Registry(dict(variants.DECODERS))
    assert r.get("beam").width == 4
    r.add("wide", variants.Decoder(16))
    with pytest.raises(ValueError):
        r.add("wide", variants.Decoder(2))
    with pytest.raises(KeyError):
        r.get("none")


def test_progress_log(spark, tmp_path):
    log = ProgressLog(keep=5)
    spark.streams.addListener(log)
    try:
        q = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 3).load().writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path)).start()
        q.awaitTermination(60)
        q.stop()
    finally:
        spark.streams.removeListener(log)
    assert len(log.events) <= 5
