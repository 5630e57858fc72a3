"""Sources, sinks and streams over temporary folders."""

import json

import pytest
from pyspark.sql import functions as F

from foliolake.sources import readers, sinks
from foliolake.streaming import latest


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "iodine pills.txt").write_text("first   line\nab\n[?] third")
    got = [(r.stem, r.line_index, r.text) for r in readers.transcripts(spark, str(tmp_path / "t")).collect()]
    assert got == [("iodine%20pills", 0, "first line"), ("iodine%20pills", 2, "[?] third")]
    (tmp_path / "lex.tsv").write_text("mg\t12\ndose\n")
    assert {(r.word, r.n) for r in readers.weighted_lexicon(spark, str(tmp_path / "lex.tsv")).collect()} == {("mg", 12.0), ("dose", 1.0)}
    (tmp_path / "h.csv").write_text("Image;P1\na;1,2\n")
    assert readers.delimited(spark, str(tmp_path / "h.csv"), "Image string, P1 string").first().P1 == "1,2"
    (tmp_path / "w.txt").write_text(" a \n\nb\n")
    assert [r.word for r in readers.word_list(spark, str(tmp_path / "w.txt")).collect()] == ["a", "b"]
    (tmp_path / "trie.json").write_text(json.dumps({"c": {"a": {"p": 3, "t": 1, "c": {"b": {"p": 2, "t": 2}}}}}))
    assert {tuple(r) for r in readers.trie_rows(spark, str(tmp_path / "trie.json")).collect()} == {("a", 3.0, 1.0), ("ab", 2.0, 2.0)}


def test_records_and_named_errors(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"doc": "a", "fields": ["x"], "ms": 3}, {"doc": "b"}]))
    df = readers.records(spark, str(tmp_path / "r.json"))
    assert {(r.doc, r.ms) for r in df.collect()} == {("a", 3), ("b", None)}
    assert readers.json_document(spark, str(tmp_path / "no.json"), "a int") == (None, f"missing: {tmp_path}/no.json")
    assert readers.json_document(spark, str(tmp_path / "r.json"), "doc string")[1] is None


def test_source_scan(spark, tmp_path):
    (tmp_path / "a.js").write_text("x\nfetch('http://h') // http://k\n")
    rows = readers.source_scan(spark, str(tmp_path / "a.js"), {"url": r"https?://\w+"}).collect()
    assert [(r.line_no, r.match) for r in rows] == [(2, "http://h"), (2, "http://k")]


def test_guarded_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "train"), ("b", 2, "train")], "word string, n long, split string")
    with pytest.raises(sinks.RefusedWrite):
        sinks.write_nonempty(df.limit(0), str(tmp_path / "e"))
    with pytest.raises(sinks.RefusedWrite):
        sinks.write_nonempty(df, str(tmp_path / "e"), ("split", "val"))
    sinks.write_growing(df, str(tmp_path / "g"))
    with pytest.raises(sinks.RefusedWrite):
        sinks.write_growing(df.limit(1), str(tmp_path / "g"))
    sinks.write_growing(df.limit(1), str(tmp_path / "g"), force=True)
    sinks.write_partitioned(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'train'").count() == 2
    sinks.write_counts(df, str(tmp_path / "c"))
    assert readers.weighted_lexicon(spark, str(tmp_path / "c")).count() == 2


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("k", 1, "a"), ("k", 3, "c"), ("z", 1, "q")]
    spark.createDataFrame(rows, "k string, g long, v string").write.parquet(src)
    stream = spark.readStream.schema("k string, g long, v string").parquet(src)
    q = latest.latest_wins(stream, "k", "g", "v").writeStream.outputMode("append").format("memory").queryName("lw").start()
    q.processAllAvailable()
    spark.createDataFrame([("k", 2, "late"), ("z", 5, "new")], "k string, g long, v string").write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from lw").collect()} == {("k", 3, "c"), ("z", 1, "q"), ("z", 5, "new")}
    out = str(tmp_path / "snap")
    q = stream.writeStream.foreachBatch(latest.upsert_batches(out, "k", "g")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.read.parquet(f"{out}/0").collect()} == {("k", 3, "c"), ("z", 5, "new")}


def test_windowed_counts(spark, tmp_path):
    df = spark.createDataFrame([("2025-01-01 00:10:00", "a"), ("2025-01-01 00:20:00", "a"), ("2025-01-01 05:00:00", "a")], "t string, k string").select(F.col("t").cast("timestamp").alias("ts"), "k")
    df.write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    q = latest.windowed_counts(s, "ts", "k").writeStream.outputMode("complete").format("memory").queryName("wc").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.sql("select n from wc").collect()) == [1, 2]
