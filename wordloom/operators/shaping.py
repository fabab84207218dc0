"""Relational shaping of corpora: R1-R9."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.schema import NATIVE_LANGUAGES


def flatten_by_label(corpus: DataFrame) -> DataFrame:
    """Drop the prompt level, key (label, id); on a repeated id the highest prompt wins.

    An aggregate (``max_by``) rather than a window: it combines map-side, so a
    key repeated on a large share of the rows never lands whole in one task.
    """
    return corpus.groupBy("label", "id").agg(F.max_by("text", "prompt").alias("text"))


def count_by_label(corpus: DataFrame, label: str = "label") -> DataFrame:
    """R2: documents per label."""
    return corpus.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def count_by_label_prompt(corpus: DataFrame, label: str = "label", prompt: str = "prompt") -> DataFrame:
    """Documents per (label, prompt)."""
    return corpus.groupBy(label, prompt).agg(F.count(F.lit(1)).alias("n"))


def dedup_key(corpus: DataFrame, key=("label", "prompt", "id"), order: str = "line") -> DataFrame:
    """One row per key; the row with the highest ``order`` (the last line) wins.

    ``max_by`` over a struct of the other columns, partially aggregated before
    the shuffle: a key shared by many rows (exact copies) costs one row per task.
    """
    rest = [c for c in corpus.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.col(order)).alias("__best")
    return corpus.groupBy(*key).agg(best).select(*key, "__best.*")


def encode_label(df: DataFrame, labels=None, label: str = "label", out: str = "label_code",
                 strict: bool = True) -> DataFrame:
    """Fixed map label -> code (position in ``labels``); an unknown label raises at run time."""
    labels = labels or NATIVE_LANGUAGES
    m = F.create_map(*[x for i, l in enumerate(labels) for x in (F.lit(l), F.lit(i))])
    code = m[F.col(label)]
    if strict:
        code = F.coalesce(code, F.raise_error(F.concat(F.lit("unknown label: "), F.col(label))).cast("int"))
    return df.withColumn(out, code)


def union_corpora(train: DataFrame, test: DataFrame) -> DataFrame:
    """Train ∪ test (duplicates kept) with a ``split`` column."""
    return (train.withColumn("split", F.lit("train"))
                 .unionByName(test.withColumn("split", F.lit("test"))))


def split_slices(df: DataFrame, split: str) -> DataFrame:
    """Rows of one split, by the split column (never by position)."""
    return df.filter(F.col("split") == split)


def order_by_label(df: DataFrame, code: str = "label_code", key: str = "id") -> DataFrame:
    """Presentation order (label code, id)."""
    return df.orderBy(code, key)


def feature_grid(spark: SparkSession, sizes, windows, options=("mean",), skip=()) -> DataFrame:
    """(option, size, window) runs, without the skipped (size, window) pairs."""
    rows = [(o, s, w) for o, s, w in product(options, sizes, windows) if (s, w) not in set(skip)]
    return spark.createDataFrame(rows, "option string, size int, window int")
