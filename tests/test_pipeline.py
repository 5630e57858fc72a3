"""Schema drift and copy comparison on small hand-made tables."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from foliolake.operators import copy_diff, schema_drift

FILES = "file_name string, arm string, bench string, run_no int, written_at timestamp_ntz, received_at timestamp_ntz, line_no int, body string"
T0 = datetime(2025, 1, 1)


def file_rows(name, run, bodies, chain="b"):
    return [(name, "arm", chain, run, T0, T0, i, b if isinstance(b, (str, type(None))) else json.dumps(b)) for i, b in enumerate(bodies)]


def found(df):
    return sorted((r.file_name, r.change_kind, r.old_field, r.new_field) for r in df.collect())


def test_changes(spark):
    base = lambda i, **kw: {"doc": f"d{i}", "profile": "p", **kw}
    rows = file_rows("f1", 1, [base(i, text=f"some words {i} here", ms=1000 + 17 * i, note=None) for i in range(4)])
    rows += file_rows("f2", 3, [base(i, body_text=f"some words {i} here", ms=1010 + 17 * i, note=None, extra=True) for i in range(4)] + ["", "  ", '{"doc": "d', None, "[1, 2]"])
    rows += file_rows("f3", 10, [base(i, body_text=f"some words {i} here", ms=str(1005 + 17 * i), note="x") for i in range(4)])
    rows += rows[:2]  # delivered twice
    rows += file_rows("g1", 1, [base(0, other=1)], chain="c")
    got = found(schema_drift.changes(spark.createDataFrame(rows, FILES)))
    assert got == [
        ("f2", "added", "", "extra"),
        ("f2", "renamed", "text", "body_text"),
        ("f3", "removed", "extra", ""),
        ("f3", "retyped", "ms", "ms"),
    ]


def test_unrelated_fields_are_not_renamed(spark):
    rows = file_rows("f1", 1, [{"doc": f"d{i}", "profile": "p", "conf": 0.9 - i / 10, "cat": "medical"} for i in range(4)])
    rows += file_rows("f2", 2, [{"doc": f"d{i}", "profile": "p", "alpha": 0.25, "flag": True} for i in range(4)])
    got = {(k, o, n) for _, k, o, n in found(schema_drift.changes(spark.createDataFrame(rows, FILES)))}
    assert got == {("added", "", "alpha"), ("added", "", "flag"), ("removed", "conf", ""), ("removed", "cat", "")}


def test_whole_and_decimal_numbers_in_one_file_are_decimal(spark):
    rows = file_rows("f1", 1, [{"doc": "a", "n": 1}, {"doc": "b", "n": 1.5}]) + file_rows("f2", 2, [{"doc": "a", "n": 2.5}])
    rows += file_rows("f3", 3, [{"doc": "a", "n": 2}])
    assert found(schema_drift.changes(spark.createDataFrame(rows, FILES))) == [("f3", "retyped", "n", "n")]


def test_empty_files_table(spark):
    empty = spark.createDataFrame([], FILES)
    assert schema_drift.changes(empty).count() == 0
    assert schema_drift.consistent_records(empty, {}).count() == 0


def test_consistent_records_follow_renames(spark):
    body = lambda i, key, ms: {"doc": f"d{i}", "profile": "p", key: f"page {i} of many words", "ms": ms, "device": "cam"}
    rows = file_rows("f1", 1, [body(i, "expected_text", 1000 + i) for i in range(3)])
    rows += file_rows("f2", 2, [body(i, "truth", f"{1000 + i} ms") for i in range(3)])
    rows += file_rows("f3", 3, [body(i, "gold", "1.5 s") for i in range(3)])
    typed = spark.createDataFrame([(1, "d9", "p", "GBP 1.00; X-1", "8,354")], "record_id long, doc string, profile string, fields string, ms string")
    out = schema_drift.consistent_records(spark.createDataFrame(rows, FILES), {"old": typed}).collect()
    assert len(out) == 10
    raw = [r for r in out if r.origin != "old"]
    assert all(r.expected_text == f"page {r.doc[1:]} of many words" for r in raw)
    assert {r.ms for r in raw} == {1000, 1001, 1002, 1500} and all(dict(r.extras) == {"device": '"cam"'} for r in raw)
    old = next(r for r in out if r.origin == "old")
    assert old.fields == ["GBP 1.00", "X-1"] and old.ms == 8354 and old.expected_text is None
    assert len({r.version for r in raw}) == 3 and old.record_id == 1 and all(r.received_at == T0 for r in raw)
    did = {r.origin: set(r.applied) for r in out}
    assert "rename gold to expected_text" in did["f3"] and {"cast ms", "default fields"} <= did["f3"] and {"cast ms", "cast fields", "default error"} <= did["old"]


def test_no_value_is_lost(spark):
    values = ['["a", "b"]', '"a; b"', '"[\\"a\\"]"', '{"f0": "a", "f1": "b"}', '{"items": ["a"]}', '{"x": {"y": 1}}', "7", "true", '""', "null", '{"values": "z"}']
    rows = file_rows("f1", 1, [f'{{"doc": "d{i}", "profile": "p", "fields": {v}, "ms": {m}, "ocr_confidence": "high"}}' for i, (v, m) in enumerate(zip(values, ["1"] * 9 + ['"soon"', "[1]"]))])
    typed = spark.createDataFrame([("d9", "12 s"), ("d8", "a while"), ("d7", None)], "doc string, ms string")
    out = schema_drift.consistent_records(spark.createDataFrame(rows, FILES), {"t": typed}).collect()
    per = {r.doc: r for r in out if r.origin == "f1"}
    assert [per[f"d{i}"].fields for i in range(5)] == [["a", "b"], ["a", "b"], ["a"], ["a", "b"], ["a"]]
    for i, v in enumerate(values):
        r = per[f"d{i}"]
        assert v == "null" or r.fields is not None or r.extras["fields"] == v
        assert r.extras["ocr_confidence"] == '"high"' and "unreadable ocr_confidence" in r.applied
    assert per["d9"].extras["ms"] == '"soon"' and per["d10"].extras["ms"] == "[1]" and per["d0"].ms == 1
    old = {r.doc: r for r in out if r.origin == "t"}
    assert old["d9"].ms == 12000 and dict(old["d8"].extras) == {"ms": '"a while"'} and old["d7"].extras == {}
    rules = {(r.origin, r.rule): r.n for r in schema_drift.applied_rules(schema_drift.consistent_records(spark.createDataFrame(rows, FILES), {"t": typed})).collect()}
    assert rules["f1", "unreadable ocr_confidence"] == 11 and rules["t", "unreadable ms"] == 1


def test_unchanged_versions_have_no_steps(spark):
    rows = [r for k in range(4) for r in file_rows(f"f{k}", k, [{"doc": "a", "profile": "p", "n": 1} if k != 2 else {"doc": "a", "profile": "p", "n": "1"}])]
    steps = [tuple(r) for r in schema_drift.migration_registry(spark.createDataFrame(rows, FILES)).drop("prev_version", "version").collect()]
    assert steps == [("arm", "b", "retyped", "n", "n", 1)] * 2


RECORD = "record_id long, doc string, profile string, fields array<string>, ocr_text string, loaded_at timestamp_ntz"


def diff(spark, a, b):
    df = copy_diff.diff_copies(
        spark.createDataFrame(a, RECORD), spark.createDataFrame(b, RECORD),
        {"doc": F.col("doc"), "profile": F.lower(F.trim("profile"))},
        {"fields": copy_diff.canonical_list(F.col("fields")), "ocr_text": copy_diff.canonical_text(F.col("ocr_text"))},
        [F.col("loaded_at"), F.col("record_id")], "x", "y",
    )
    return sorted((r.doc, r.profile, r.field, r.kind) for r in df.collect())


def test_diff_copies(spark):
    d = lambda n: datetime(2025, 1, n)
    a = [
        (1, "d1", "p", ["a", "b", "b"], "x \r\ny", d(1)), (2, "d2", "p", None, None, d(1)), (3, "d3", "p", ["a"], "old", d(1)),
        (4, "d3", "p", ["a"], "new", d(2)), (4, "d3", "p", ["a"], "new", d(2)), (5, "d4", "p", ["a"], "t", d(1)), (6, None, None, [None], "t", d(1)),
    ]
    b = [
        (9, "d1", " P ", ["b", "a", "b"], "x\ny  ", d(1)), (8, "d2", "P", [], "", d(1)), (7, "d3", "p", ["a", "a"], "old", d(1)),
        (6, "d5", "p", ["a"], "t", d(1)), (5, None, None, [], "t", d(1)),
    ]
    assert diff(spark, a, b) == [
        ("", "", "fields", "differs"), ("d3", "p", "fields", "differs"), ("d3", "p", "ocr_text", "differs"),
        ("d4", "p", "", "missing_in_y"), ("d5", "p", "", "missing_in_x"),
    ]
    assert diff(spark, [], []) == []
    assert diff(spark, a[:1], []) == [("d1", "p", "", "missing_in_y")]


def test_diff_copies_over_many_blocks(spark):
    n = 70_000
    ids = spark.range(n).select(F.col("id").alias("record_id"), F.concat(F.lit("d"), "id").alias("doc"), F.lit("p").alias("profile"),
                                F.array(F.lit("a")).alias("fields"), F.lit("t").alias("ocr_text"), F.lit("2025-01-01").cast("timestamp_ntz").alias("loaded_at"))
    left, right = ids.where("record_id % 1000 <> 7"), ids.where("record_id % 700 <> 3")
    out = copy_diff.diff_copies(left, right, {"doc": F.col("doc")}, {"t": F.col("ocr_text")}, [F.col("loaded_at")])
    got = {r.kind: r.n for r in out.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    a, b = {i for i in range(n) if i % 1000 != 7}, {i for i in range(n) if i % 700 != 3}
    assert got == {"missing_in_right": len(a - b), "missing_in_left": len(b - a)}
