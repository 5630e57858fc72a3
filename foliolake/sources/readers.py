"""Sources: Parquet globs, transcripts, delimited files, JSON documents, word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The record files' schema, given explicitly so nothing is inferred.
RECORD_SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("doc", "profile", "expected_category")]
    + [T.StructField("expected_fields", T.ArrayType(T.StringType())), T.StructField("expected_text", T.StringType()), T.StructField("category", T.StringType())]
    + [T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("ocr_text", T.StringType()), T.StructField("ocr_confidence", T.DoubleType())]
    + [T.StructField("error", T.StringType()), T.StructField("ms", T.IntegerType())]
)
TRIAGE_SCHEMA = "file string, w int, h int, bands int, ink double, sharpness double"


def receipt_words(spark: SparkSession, pattern: str) -> DataFrame:
    """(key, ordinal, word, box) from Parquet files with parallel words and bboxes; images are never read."""
    rows = spark.read.parquet(pattern).select("key", F.posexplode(F.arrays_zip("words", "bboxes")).alias("ordinal", "z"))
    return rows.select("key", "ordinal", F.col("z.words").alias("word"), F.col("z.bboxes").alias("box"))


def transcripts(spark: SparkSession, pattern: str, least: int = 3) -> DataFrame:
    """(stem, line_index, text): lines of whole text files, blanks collapsed, at least ``least`` characters."""
    files = spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), "value")
    lines = files.select("stem", F.posexplode(F.split("value", "\n")).alias("line_index", "text"))
    return lines.withColumn("text", F.trim(F.regexp_replace("text", r"\s{2,}", " "))).where(F.length("text") >= least)


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ";", header: bool = True) -> DataFrame:
    """A delimited file; rows that don't fit the schema are dropped."""
    return spark.read.csv(path, sep=sep, schema=schema, header=header, mode="DROPMALFORMED")


def weighted_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, n) from word<TAB>count lines; a missing count is 1."""
    rows = spark.read.csv(path, sep="\t", schema="word string, n double", quote="")
    return rows.where(F.trim("word") != "").select("word", F.coalesce("n", F.lit(1.0)).alias("n"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """(word) of the non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Record files (one JSON list or one object per line); unreadable rows keep their text in ``corrupt``."""
    schema = T.StructType([*RECORD_SCHEMA.fields, T.StructField("corrupt", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "corrupt").option("multiLine", "true").json(path)


def json_document(spark: SparkSession, path: str, schema) -> tuple[DataFrame | None, str | None]:
    """(document, error): a missing or unreadable file is named, never replaced by a default."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None, f"missing: {path}"
    df = spark.read.schema(schema).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    if not df.limit(1).count():
        return None, f"empty: {path}"
    return df, None


def trie_rows(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, pass_weight, word_weight) from a nested trie file {p, t, c}, level by level."""
    level = spark.read.text(path, wholetext=True).select(F.lit("").alias("prefix"), F.parse_json("value").alias("node"))
    out = None
    while level.limit(1).count():
        rows = level.select(
            "prefix",
            F.coalesce(F.try_variant_get("node", "$.p", "double"), F.lit(0.0)).alias("pass_weight"),
            F.coalesce(F.try_variant_get("node", "$.t", "double"), F.lit(0.0)).alias("word_weight"),
        )
        out = rows if out is None else out.unionByName(rows)
        below = level.select("prefix", F.try_variant_get("node", "$.c", "variant").alias("c")).where("c is not null")
        level = below.lateralJoin(spark.tvf.variant_explode(F.col("c").outer())).select(F.concat("prefix", "key").alias("prefix"), F.col("value").alias("node"))
    return out.where("prefix <> ''")


def source_scan(spark: SparkSession, pattern: str, findings: dict[str, str]) -> DataFrame:
    """(file, line_no, finding, match): every pattern found in text files, with line numbers from 1."""
    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("i", "line"))
    hits = F.array(*[F.struct(F.lit(n).alias("finding"), F.regexp_extract_all("line", F.lit(p), F.lit(0)).alias("m")) for n, p in findings.items()])
    rows = files.select("file", (F.col("i") + 1).alias("line_no"), F.explode(hits).alias("h"))
    return rows.select("file", "line_no", "h.finding", F.explode("h.m").alias("match"))


def jpeg_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(stem, length, digest) of binary files."""
    return spark.read.format("binaryFile").load(pattern).select(
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("stem"), "length", F.sha2("content", 256).alias("digest")
    )
