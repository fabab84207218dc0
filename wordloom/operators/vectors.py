"""Word and document vectors: M1-M5.

Word vectors come from Spark ML ``Word2Vec``.  Document vectors (Spark has
none) are inferred per document against the frozen word vectors: the
document's (word, tf, vector) rows arrive by a join, grouped by document, and
a pandas function fits the document vector by gradient ascent on a
negative-sampling (DBOW-style) objective.  The random generator is seeded
from (seed, document id), so the result does not depend on partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.ranking import materialize

WORD_VECTOR_PARTITIONS = 8      # Word2Vec tasks whose models are averaged
NOISE_TABLE = 1 << 14           # places of the negative-sampling table


def train_word_vectors(tokens_arr: DataFrame, size: int, window: int, min_count: int = 5,
                       max_iter: int = 1, seed: int = 42, col: str = "words",
                       num_partitions: int = WORD_VECTOR_PARTITIONS, max_sentence_length: int | None = None):
    """M1: fit Spark ML Word2Vec on an array-of-words column.

    Training runs on ``num_partitions`` tasks and Spark averages their models
    after each pass, so this number, not the cluster, is part of the result.
    ``max_sentence_length`` defaults to the longest document: no context is cut.
    Returns the fitted model.
    """
    if max_sentence_length is None:
        max_sentence_length = max(1, tokens_arr.select(F.max(F.size(col))).first()[0] or 1)
    w2v = Word2Vec(vectorSize=size, windowSize=window, minCount=min_count, maxIter=max_iter, seed=seed,
                   inputCol=col, outputCol="__w2v", numPartitions=num_partitions,
                   maxSentenceLength=max_sentence_length)
    return w2v.fit(tokens_arr.select(col))


def word_vector_table(model, name: str = "w2v_vectors") -> DataFrame:
    """(word, embedding array<double>) of a fitted Word2Vec, written to the shared scratch folder."""
    return materialize(model.getVectors().select("word", vector_to_array("vector").alias("embedding")), name)


def noise_table(tf: DataFrame, vectors: DataFrame, size: int = NOISE_TABLE, seed: int = 42) -> np.ndarray:
    """Word vectors for negative sampling: a table in which every word of the vocabulary fills
    a share ∝ count^0.75 of about ``size`` places (rounded up or down by a hash of the word, without bias).

    Drawing a place at random draws from the whole vocabulary's noise
    distribution.  At most about ``size`` vectors reach the driver.
    """
    counts = tf.groupBy("word").agg(F.sum("tf").alias("count")).join(vectors.select("word", "embedding"), "word")
    weight = F.pow(F.col("count").cast("double"), 0.75)
    total = counts.agg(F.sum(weight)).first()[0]
    if not total:
        return np.zeros((0, 0))
    u = F.xxhash64(F.col("word"), F.lit(seed)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    filled = counts.select("word", "embedding", F.floor(weight * F.lit(size / total) + u).cast("int").alias("places"))
    rows = filled.filter(F.col("places") > 0).orderBy("word").collect()
    return np.repeat(np.array([r["embedding"] for r in rows], dtype=np.float64), [r["places"] for r in rows], axis=0)


def _infer_fn(dim: int, negatives, epochs: int, lr: float, neg_per_word: int, seed: int):
    """Per-group inference; ``negatives`` is one array, or a dict by model id (column ``model``)."""
    def infer(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = int(pdf["doc_id"].iloc[0])
        model = int(pdf["model"].iloc[0]) if "model" in pdf else 0
        neg = negatives[model] if isinstance(negatives, dict) else negatives
        rng = np.random.default_rng([seed, model, doc & 0xFFFFFFFF, doc >> 32 & 0xFFFFFFFF])
        order = np.argsort(pdf["word"].to_numpy())           # row order inside a group is not fixed
        v = np.stack(pdf["embedding"].to_numpy()[order]).astype(np.float64)
        tf = pdf["tf"].to_numpy()[order].astype(np.float64)
        d = (rng.random(dim) - 0.5) / dim
        n_neg = len(neg)
        for e in range(epochs):
            alpha = lr * (1.0 - e / max(epochs, 1)) + 1e-4
            s = 1.0 / (1.0 + np.exp(-(v @ d)))
            grad = ((1.0 - s) * tf) @ v
            if n_neg:
                idx = rng.integers(0, n_neg, size=max(1, int(neg_per_word * tf.sum())))
                u = neg[idx]
                sn = 1.0 / (1.0 + np.exp(-(u @ d)))
                grad -= sn @ u
            d = d + alpha * grad / max(tf.sum(), 1.0)
        out = {"doc_id": [doc], "features": [d.tolist()]}
        if "model" in pdf:
            out["model"] = [model]
        return pd.DataFrame(out)
    return infer


def infer_doc_vectors(tf: DataFrame, vectors: DataFrame, dim: int, negatives: np.ndarray, epochs: int = 50,
                      lr: float = 0.5, neg_per_word: int = 5, seed: int = 0) -> DataFrame:
    """M3 inference: (doc_id, features array<double>) for documents with at least one known word.

    ``tf`` (doc_id, word, tf) is joined to the word vectors; each document's
    rows (one per distinct known word, bounded by the document) form one group.
    """
    rows = tf.join(vectors.select("word", "embedding"), "word").select("doc_id", "word", "tf", "embedding")
    fn = _infer_fn(dim, negatives, epochs, lr, neg_per_word, seed)
    return rows.groupBy("doc_id").applyInPandas(fn, "doc_id long, features array<double>")


def doc_vectors_per_label(tf: DataFrame, label_vectors: dict, dim: int, negatives: dict, epochs: int = 10,
                          lr: float = 0.5, neg_per_word: int = 5, seed: int = 0) -> DataFrame:
    """M5: every document inferred against each label's word vectors in one pass; vectors
    concatenated in the order of ``label_vectors`` (k × dim values).  A document with no
    known word in some label's space gets zeros there.

    The label vector tables are stacked with a ``model`` column and joined to the
    term counts once; groups are (document, model).
    """
    labels = list(label_vectors)
    stacked = None
    for i, label in enumerate(labels):
        part = label_vectors[label].select(F.lit(i).alias("model"), "word", "embedding")
        stacked = part if stacked is None else stacked.unionByName(part)
    rows = tf.join(stacked, "word").select("doc_id", "model", "word", "tf", "embedding")
    negs = {i: negatives[label] for i, label in enumerate(labels)}
    fn = _infer_fn(dim, negs, epochs, lr, neg_per_word, seed)
    allv = rows.groupBy("doc_id", "model").applyInPandas(fn, "doc_id long, features array<double>, model int")
    k = len(labels)
    zeros = F.array_repeat(F.lit(0.0), dim)
    g = allv.groupBy("doc_id").agg(F.collect_list(F.struct("model", "features")).alias("parts"))  # k entries
    def of_model(i):
        return lambda p: p["model"] == F.lit(i)   # one-argument lambda: a second one would be the index

    slots = [F.coalesce(F.try_element_at(F.filter("parts", of_model(i)), F.lit(1))["features"], zeros)
             for i in range(k)]
    return g.select("doc_id", F.concat(*slots).alias("features"))
