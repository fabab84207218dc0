"""Writers K1-K8.  Line-based sinks turn newlines inside text into spaces."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.tokens import strip_id_suffix

__all__ = ["write_bucketed_corpus", "write_dense_csv", "write_libsvm", "write_predictions", "write_prediction_label",
           "write_per_label", "write_corpus", "save_model", "write_scored", "one_line",
           "write_context_embeddings"]

CORPUS_HEADER = "Filename,Prompt,NL,Text"


def one_line(c):
    """Text safe for a line-based file: CR/LF become spaces."""
    return F.regexp_replace(c, r"[\r\n]", " ")


def write_bucketed_corpus(df: DataFrame, table_name: str, path: str, buckets: int, key: str = "doc_id") -> DataFrame:
    """Store a corpus bucketed (and sorted) by ``key`` as an external table at ``path``.

    Reading the table back gives scans already hash-partitioned by ``key``, so
    every per-document pipeline runs without any shuffle.  ``buckets`` should
    be sized so a bucket fits a task (e.g. total text bytes / 256 MB).
    """
    (df.write.mode("overwrite").option("path", path).bucketBy(buckets, key).sortBy(key)
       .saveAsTable(table_name))
    return df.sparkSession.table(table_name)


def write_dense_csv(df: DataFrame, path: str, label: str = "label_code", features: str = "features",
                    order=()) -> None:
    """K1: ``label,v1,...,vn,`` per row (trailing comma); rows in ``order`` if given."""
    line = F.concat(F.col(label).cast("string"), F.lit(","),
                    F.array_join(F.transform(features, lambda x: x.cast("string")), ","), F.lit(","))
    out = df.orderBy(*order) if order else df
    out.select(line.alias("value")).write.mode("overwrite").text(path)


def write_libsvm(df: DataFrame, path: str, label: str = "label_code", features: str = "features") -> None:
    """K2: ``label i:v ...`` with 1-based indices (zeros omitted)."""
    f = F.col(features)
    vec = array_to_vector(f) if dict(df.dtypes)[features].startswith("array") else f
    (df.select(F.col(label).cast("double").alias("label"), vec.alias("features"))
       .write.mode("overwrite").format("libsvm").save(path))


def write_predictions(df: DataFrame, path: str, id_col: str = "id", prediction: str = "prediction") -> None:
    """K3: CSV ``test_taker_id,prediction``; every ``.txt`` removed from the id."""
    (df.select(strip_id_suffix(F.col(id_col).cast("string")).alias("test_taker_id"),
               F.col(prediction).cast("string").alias("prediction"))
       .write.mode("overwrite").option("header", True).csv(path))


def write_prediction_label(df: DataFrame, path: str) -> None:
    """K4: CSV ``prediction,label`` (the original wrote truth under a prediction header)."""
    df.select("prediction", "label").write.mode("overwrite").option("header", True).csv(path)


def write_per_label(df: DataFrame, path: str, label: str = "label", text: str = "text") -> None:
    """K5: one folder of lower-cased texts per label (``label=<x>/``), partition-pruned on read."""
    (df.select(F.col(label).alias("label"), F.lower(one_line(F.col(text))).alias("value"))
       .write.mode("overwrite").partitionBy("label").text(path))


def write_corpus(df: DataFrame, path: str, quote_to_apostrophe: bool = False) -> None:
    """K6: header + ``id,prompt,label,"text"``; optionally ``"`` -> ``'`` inside text."""
    t = one_line(F.col("text"))
    if quote_to_apostrophe:
        t = F.regexp_replace(t, '"', "'")
    line = F.concat_ws(",", F.col("id"), F.col("prompt"), F.col("label"), F.concat(F.lit('"'), t, F.lit('"')))
    header = df.sparkSession.createDataFrame([(CORPUS_HEADER,)], "value string")
    # union keeps partition order: the header is the first line of the first part file
    header.union(df.select(line.alias("value"))).write.mode("overwrite").text(path)


def save_model(model: PipelineModel, base: str, option: str, size: int, window: int, suffix: str = "") -> str:
    """K7: persist a fitted pipeline under a path built from its parameters."""
    path = f"{base.rstrip('/')}/{option}_{size}_{window}{('_' + suffix) if suffix else ''}"
    model.write().overwrite().save(path)
    return path


def write_scored(df: DataFrame, path: str, split_col: str = "split") -> None:
    """K8: (id, label, prediction) per split, parquet partitioned by split."""
    df.select("id", "label", "prediction", split_col).write.mode("overwrite").partitionBy(split_col).parquet(path)


def write_context_embeddings(vectors: DataFrame, folder: str) -> None:
    """Inverse of S8: one text file per offset (``offset=<o>/``), first line a header
    ``<rows> <dim>``, then ``word v1 ... vk``.  The format wants a single file per offset,
    so each offset is written by one task; an offset holds one row per vocabulary word."""
    line = F.concat_ws(" ", F.col("word"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    body = vectors.select("offset", F.lit(1).alias("__o"), line.alias("value"))
    head = vectors.groupBy("offset").agg(
        F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.max(F.size("embedding")).cast("string")).alias("value")
    ).select("offset", F.lit(0).alias("__o"), "value")
    (head.unionByName(body).repartition("offset").sortWithinPartitions("offset", "__o")
         .select("offset", "value").write.mode("overwrite").partitionBy("offset").text(folder))
