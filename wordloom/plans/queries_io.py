"""Source and sink round trips.

Each query writes driver data in the line format under the shared scratch
folder with a sink, reads it back with the matching source, and returns what
was read; the oracle states the expected content directly from the tables.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wordloom.functions.tokens import SPACE
from wordloom.plans import fixtures as fx
from wordloom.plans.oracle import WS_LIST, context_cte, with_sql
from wordloom.plans.queries import docs, r4, register
from wordloom.sources import readers as S
from wordloom.sources import writers as K
from wordloom.session import scratch_path, table

ONE_LINE = "regexp_replace(text, '[\\r\\n]', ' ', 'g')"


def _corpus(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("id"),
                    F.col("source").alias("prompt"), F.col("lang").alias("label"), "text", "doc_id")


def _written_corpus(spark, sf_dir, **kw):
    path = scratch_path(spark, "corpus")
    K.write_corpus(_corpus(spark, sf_dir), path, **kw)
    return path


@register("s1_read_corpus", f"""
SELECT doc_id::VARCHAR || '.txt' AS id, source AS prompt, lang AS label,
       regexp_replace({ONE_LINE}, '^"+|"+$', '', 'g') AS text FROM documents""")
def s1_read_corpus(spark, sf_dir):
    return S.read_corpus(spark, _written_corpus(spark, sf_dir))


@register("s2_read_corpus_quoted", f"""
SELECT doc_id::VARCHAR || '.txt' AS id, source AS prompt, lang AS label, left(x, length(x) - 1) AS text
FROM (SELECT doc_id, source, lang, lower(string_split({ONE_LINE} || '"', ',"')[1]) AS x FROM documents)""")
def s2_read_corpus_quoted(spark, sf_dir):
    return S.read_corpus_quoted(spark, _written_corpus(spark, sf_dir))


@register("s3_read_label_slice", f"""
SELECT lower(string_split('"' || {ONE_LINE} || '"', '"')[2]) AS text FROM documents WHERE lang = 'fr'""")
def s3_read_label_slice(spark, sf_dir):
    return S.read_label_slice(spark, _written_corpus(spark, sf_dir), "fr")


@register("k5_write_per_label", f"""
SELECT lang AS label, lower({ONE_LINE}) AS text FROM documents""")
def k5_write_per_label(spark, sf_dir):
    path = scratch_path(spark, "per_label")
    K.write_per_label(_corpus(spark, sf_dir), path)
    return spark.read.text(path).select("label", F.col("value").alias("text"))  # label= folders become a column


@register("k6_write_corpus_apostrophe", f"""
SELECT doc_id::VARCHAR || '.txt' AS id, replace({ONE_LINE}, '"', '''') AS text FROM documents""")
def k6_write_corpus_apostrophe(spark, sf_dir):
    return S.read_corpus(spark, _written_corpus(spark, sf_dir, quote_to_apostrophe=True)).select("id", "text")


_EMB_LONG = """
SELECT e.line, e.label, u.i::INT AS dim, round(e.embedding[u.i + 1]::DOUBLE, 4) + 0.0 AS value
FROM (SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS line, label, embedding FROM embeddings) e,
     unnest(range(len(e.embedding))) AS u(i)"""


def _emb(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").alias("label_code"),
                    F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def _long(df, key, col="features"):
    return df.select(*key, F.posexplode(col).alias("dim", "value")).select(
        *key, F.col("dim").cast("int").alias("dim"), r4("value").alias("value"))


@register("s4_read_dense_csv", """
SELECT line, label, dim, value FROM (""" + _EMB_LONG + ")")
def s4_read_dense_csv(spark, sf_dir):
    path = scratch_path(spark, "dense_csv")
    K.write_dense_csv(_emb(spark, sf_dir), path, order=("vec_id",))
    return _long(S.read_dense_csv(spark, path), ["line", "label"])


@register("s5_read_libsvm", """
SELECT line, label::DOUBLE AS label, dim, value FROM (""" + _EMB_LONG + ")")
def s5_read_libsvm(spark, sf_dir):
    path = scratch_path(spark, "libsvm")
    K.write_libsvm(_emb(spark, sf_dir).orderBy("vec_id"), path)
    back = S.line_numbers(S.read_libsvm(spark, path, 64))
    return _long(back.select("line", "label", vector_to_array("features").alias("features")), ["line", "label"])


def _lines_file(spark, sf_dir, col_expr, name):
    path = scratch_path(spark, name)
    d = docs(spark, sf_dir)
    d.orderBy("doc_id").select(col_expr.alias("value")).write.mode("overwrite").text(path)
    return path


@register("s6_read_lines_tagged", f"""
SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS tag,
       len(list_filter(regexp_split_to_array({ONE_LINE}, '{SPACE}+'), lambda x: x <> ''))::INT AS n_words
FROM documents""")
def s6_read_lines_tagged(spark, sf_dir):
    path = _lines_file(spark, sf_dir, K.one_line(F.col("text")), "lines")
    return S.read_lines_tagged(spark, path).select("tag", F.size("words").alias("n_words"))


@register("s7_positional_join", f"""
SELECT (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS line, lang AS label, {ONE_LINE} AS text FROM documents""")
def s7_positional_join(spark, sf_dir):
    texts = _lines_file(spark, sf_dir, K.one_line(F.col("text")), "texts")
    labels = _lines_file(spark, sf_dir, F.concat(F.upper("lang"), F.lit("  ")), "labels")
    return S.positional_join(spark, texts, labels).select("line", "label", "text")


@register("s8_read_context_embeddings", with_sql(["ws_tokens", "ctx"], """
SELECT "offset", word, u.i::INT AS dim, round(embedding[u.i + 1]::DOUBLE, 4) + 0.0 AS value
FROM ctx, unnest(range(len(embedding))) AS u(i)""", extra={"ctx": context_cte(4)}))
def s8_read_context_embeddings(spark, sf_dir):
    vectors = fx.context_vectors(spark, sf_dir, 4)
    path = scratch_path(spark, "context_embeddings")
    K.write_context_embeddings(vectors.withColumn("embedding", F.transform("embedding", lambda x: x.cast("double"))), path)
    back = S.read_context_embeddings(spark, path, 64, 4)
    return _long(back, ["offset", "word"], "embedding")


@register("s9_load_word_vectors", with_sql(["tokens", "word_vectors"], """
SELECT word, u.i::INT AS dim, round(embedding[u.i + 1]::DOUBLE, 4) + 0.0 AS value
FROM word_vectors, unnest(range(len(embedding))) AS u(i)"""))
def s9_load_word_vectors(spark, sf_dir):
    path = scratch_path(spark, "word_vectors")
    fx.word_vectors(spark, sf_dir).write.mode("overwrite").parquet(path)
    return _long(S.load_word_vectors(spark, path), ["word"], "embedding")


@register("k3_write_predictions", with_sql(["predictions"], """
SELECT doc_id::VARCHAR AS test_taker_id, prediction FROM predictions"""))
def k3_write_predictions(spark, sf_dir):
    p = fx.predictions(docs(spark, sf_dir)).withColumn("id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = scratch_path(spark, "predictions")
    K.write_predictions(p, path)
    return spark.read.option("header", True).csv(path)


@register("k4_write_prediction_label", with_sql(["predictions"], "SELECT prediction, label FROM predictions"))
def k4_write_prediction_label(spark, sf_dir):
    path = scratch_path(spark, "prediction_label")
    K.write_prediction_label(fx.predictions(docs(spark, sf_dir)), path)
    return spark.read.option("header", True).csv(path)


@register("k8_write_scored", with_sql(["predictions"], """
SELECT doc_id::VARCHAR AS id, label, prediction,
       CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split
FROM predictions"""))
def k8_write_scored(spark, sf_dir):
    p = fx.predictions(docs(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("id"), "label", "prediction",
                                                   fx.split_of().alias("split"))
    path = scratch_path(spark, "scored")
    K.write_scored(p, path)
    return spark.read.parquet(path).select("id", "label", "prediction", F.col("split").cast("string").alias("split"))
