"""Readers S1-S9.

The corpus format is one document per line, ``id,prompt,label,"text"``,
quoted loosely (not RFC 4180), so every reader is ``read.text`` plus Column
expressions; no Python touches a line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions.tokens import tokens_ws
from wordloom.schema import HEADER_MARKERS

__all__ = ["read_corpus", "read_corpus_quoted", "read_label_slice", "read_dense_csv",
           "read_libsvm", "read_lines_tagged", "positional_join", "read_context_embeddings",
           "load_word_vectors", "line_numbers", "strip_ws"]


def strip_ws(c):
    """``str.strip()``: leading and trailing whitespace."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _is_header(line):
    cond = None
    for m in HEADER_MARKERS:
        c = F.instr(line, m) > 0
        cond = c if cond is None else cond & c
    return cond


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(id, prompt, label, text); split at the first three commas; header lines dropped
    by content; text stripped of whitespace, then of all leading/trailing ``"``."""
    lines = spark.read.text(path).filter(~_is_header(F.col("value")))
    parts = F.split(F.col("value"), ",", 4)
    text = F.regexp_replace(strip_ws(parts[3]), r'^"+|"+$', "")
    return lines.select(parts[0].alias("id"), parts[1].alias("prompt"), parts[2].alias("label"),
                        text.alias("text"))


def read_corpus_quoted(spark: SparkSession, path: str) -> DataFrame:
    """text = between the first and the second ``,"`` minus its last character, lower-cased;
    id, prompt, label from the part before the first ``,"``, case kept.  A header is dropped
    by content (a written corpus may have one per part file)."""
    lines = spark.read.text(path).filter(~_is_header(F.col("value")))
    line = strip_ws(F.col("value"))
    head = F.split(F.split(line, ',"')[0], ",")
    body = F.split(F.lower(line), ',"')[1]
    text = F.expr("substring(__b, 1, length(__b) - 1)")
    return (lines.select(head[0].alias("id"), head[1].alias("prompt"), head[2].alias("label"),
                         body.alias("__b"))
                 .select("id", "prompt", "label", text.alias("text")))


def read_label_slice(spark: SparkSession, path: str, label: str) -> DataFrame:
    """S3: lower-cased texts (between the first pair of ``"``) of one label."""
    lines = spark.read.text(path)
    return (lines.filter(F.split("value", ",")[2] == label)
                 .select(F.lower(F.split("value", '"')[1]).alias("text")))


def read_dense_csv(spark: SparkSession, path: str) -> DataFrame:
    """``label,v1,...,vn,`` (trailing comma) -> (line, label int, features array<double>)."""
    lines = line_numbers(spark.read.text(path))
    parts = F.split("value", ",")
    vals = F.slice(parts, 2, F.size(parts) - 2)
    return lines.select("line", parts[0].cast("int").alias("label"),
                        F.transform(vals, lambda x: x.cast("double")).alias("features"))


def read_libsvm(spark: SparkSession, path: str, num_features: int) -> DataFrame:
    """Libsvm rows (1-based indices) -> (label double, features vector)."""
    return spark.read.format("libsvm").option("numFeatures", num_features).load(path)


def line_numbers(lines: DataFrame, col: str = "line", file_col: str | None = None) -> DataFrame:
    """0-based line number of each row of a file read, in (file path, offset) order.

    ``lines`` must be a file scan (it reads ``_metadata``).  Rows of one file
    split arrive in file order with consecutive partition-local ids, so only the
    splits need ordering: rows are counted per (file, split start), a prefix sum
    over the splits (one row per split) gives each split's first line,
    and a row's line is that plus its distance from the split's first id.  The
    lines themselves are never sorted or shuffled.  ``file_col`` keeps the path.
    """
    tagged = lines.select("*", F.col("_metadata.file_path").alias("__f"),
                          F.col("_metadata.file_block_start").alias("__b"),
                          F.monotonically_increasing_id().alias("__m"))
    splits = tagged.groupBy("__f", "__b").agg(F.min("__m").alias("__m0"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("__f", "__b", "__m0", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = tagged.join(offsets, ["__f", "__b"])
    out = out.withColumn(col, F.col("__off") + F.col("__m") - F.col("__m0"))
    if file_col:
        out = out.withColumnRenamed("__f", file_col)
    return out.drop("__f", "__b", "__m", "__m0", "__off")


def read_lines_tagged(spark: SparkSession, path: str) -> DataFrame:
    """One document per line; tag = line number; whitespace tokens."""
    lines = line_numbers(spark.read.text(path), "tag")
    return lines.select("tag", F.col("value").alias("text"), tokens_ws("value").alias("words"))


def positional_join(spark: SparkSession, text_path: str, label_path: str) -> DataFrame:
    """Line i of the text file pairs with line i of the label file (label stripped, lower-cased)."""
    texts = line_numbers(spark.read.text(text_path)).select("line", F.col("value").alias("text"))
    labels = line_numbers(spark.read.text(label_path)).select(
        "line", F.lower(strip_ws(F.col("value"))).alias("label"))
    return texts.join(labels, "line")


def read_context_embeddings(spark: SparkSession, folder: str, dim: int, w: int) -> DataFrame:
    """One file per offset (folder ``offset=<o>``); the first line of each file is a
    header; the last ``dim // w`` fields are the vector, the rest (joined by one space) is
    the word.  Key (offset, word)."""
    n = dim // w
    raw = spark.read.text(f"{folder.rstrip('/')}/offset=*/*.txt")
    lines = line_numbers(raw, file_col="file").withColumn(
        "offset", F.regexp_extract(F.col("file"), r"offset=(-?\d+)", 1).cast("int"))
    first = lines.groupBy("file").agg(F.min("line").alias("__first"))  # one row per file
    body = lines.join(F.broadcast(first), "file").filter(F.col("line") > F.col("__first"))
    fields = F.split(strip_ws(F.col("value")), " ")
    k = F.size(fields)
    return body.select(
        "offset",
        F.array_join(F.slice(fields, 1, k - n), " ").alias("word"),
        F.transform(F.slice(fields, k - n + 1, n), lambda x: x.cast("double")).alias("embedding"))


def load_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Saved (word, embedding) vectors (parquet)."""
    return spark.read.parquet(path).select("word", "embedding")
