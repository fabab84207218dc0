"""Toxicity by a classifier chain.

Categories are predicted one after another by logistic regressions.  Each model
sees the text's features and the probabilities of all earlier categories; for
training these come from models that did not see the row (out-of-fold), so a
later model learns how far an earlier one can be trusted on new texts.

Features are words and their letter n-grams, present or not, over the whole
text.  The classifiers are fitted on a bounded sample of labelled rows
(``MAX_ROWS``, taken by a hash of the id) and use the ``MAX_FEATURES`` features
whose presence differs most from chance for some category, counted on the whole
sample.  Every document is scored.

Defined cases: null and empty texts have no feature and get the chain's
intercepts.  Label rows with a null category or without a document are left out;
a document with several label rows counts with each.  A category that only has
one class is predicted with that class.  Without any labelled row probabilities
are null and nothing is flagged.  Repeated rows are scored each; columns that have
the names of results are replaced.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.tables import unused_name
from wordloom.operators.ranking import materialize

MAX_ROWS = 12_000       # labelled rows that the classifiers are fitted on, at most
MAX_FEATURES = 4_096
MIN_DOCS = 5            # rows of the sample that a feature must be in
NGRAMS = (4, 6)
FOLDS = 3
REG = 1e-3
CACHED_WORDS = 300_000  # a task forgets its words' features beyond this many

WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """The word itself and the n-grams of ``<word>``."""
    framed = f"<{word}>"
    return [framed, *(framed[i:i + n] for n in NGRAMS for i in range(len(framed) - n + 1) if n < len(framed))]


def _words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


class Features:
    """Numbers of a text's features among the chosen ones; words are looked at once."""

    def __init__(self, vocabulary: list[str]):
        self.number = {f: i for i, f in enumerate(vocabulary)}
        self.of: dict[str, tuple] = {}

    def word(self, word: str) -> tuple:
        found = self.of.get(word)
        if found is None:
            if len(self.of) > CACHED_WORDS:
                self.of.clear()
            found = self.of[word] = tuple(self.number[f] for f in word_features(word) if f in self.number)
        return found

    def text(self, text: str | None) -> set[int]:
        return set().union(*filter(None, map(self.word, _words(text))))


def choose_features(sample: DataFrame, categories: list[str]) -> list[str]:
    """The features whose presence is most telling (largest z-score of any category), by counts over the sample."""
    k = len(categories)

    def count(batches):
        import pyarrow as pa
        number: dict[str, int] = {}
        sums: list[np.ndarray] = []
        of: dict[str, list[str]] = {}
        for batch in batches:
            labels = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in categories], axis=1)
            for text, y in zip(batch.column("text").to_pylist(), labels):
                own: set[str] = set()
                for w in _words(text):
                    found = of.get(w)
                    if found is None:
                        found = of[w] = word_features(w)
                    own.update(found)
                row = np.concatenate(([1], y)).astype(np.int64)
                for f in own:
                    at = number.setdefault(f, len(sums))
                    if at == len(sums):
                        sums.append(row.copy())
                    else:
                        sums[at] += row
        if sums:
            table = np.stack(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(number)), *[pa.array(table[:, j]) for j in range(k + 1)]], ["f", "n", *[f"p{j}" for j in range(k)]])

    schema = ", ".join(["f string", "n long", *[f"p{j} long" for j in range(k)]])
    counted = sample.select("text", *categories).mapInArrow(count, schema).groupBy("f").agg(
        *[F.sum(c).alias(c) for c in ("n", *[f"p{j}" for j in range(k)])])
    rows, *shares = sample.agg(F.count(F.lit(1)), *[F.avg(c) for c in categories]).first()
    n, scores = F.col("n"), []
    for j, share in enumerate(shares):
        if 0 < share < 1:
            spread = n * (share * (1 - share)) * (1 - n / F.lit(float(rows)))
            scores.append(F.abs(F.col(f"p{j}") - n * share) / F.sqrt(F.greatest(spread, F.lit(1e-9))))
    if not scores:
        return []
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    top = counted.filter((n >= MIN_DOCS) & (n < rows)).orderBy(best.desc(), "f").limit(MAX_FEATURES)
    return sorted(r["f"] for r in top.select("f").collect())


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text",
        max_rows: int = MAX_ROWS) -> dict:
    """The chain for ``categories`` (0/1 columns of ``labels``, in this order)."""
    known = labels.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in categories], F.lit(0)) == 0)
    known = known.select(F.col(id_col).alias("__id"), *[F.col(c).cast("int").alias(c) for c in categories])
    taken = known.orderBy(F.xxhash64("__id"), "__id", *categories).limit(max_rows)   # at most max_rows short rows
    sample = materialize(
        docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
        .join(F.broadcast(taken), "__id").withColumn("fold", F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(FOLDS))), "labelled")
    vocabulary = choose_features(sample, categories) if sample.count() else []
    if not vocabulary:
        ends = sample.agg(*[F.avg(c).alias(c) for c in categories]).first()
        return {"categories": categories, "vocabulary": [], "models": [(np.zeros(j), _logit(ends[j])) for j in range(len(categories))]}
    found = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="found", outputCol="x0")
    rows = materialize(found.setBinary(True).transform(_present(sample, vocabulary)).select("__id", "fold", "x0", *categories), "features")
    models = []
    for j, category in enumerate(categories):
        frame = VectorAssembler(inputCols=["x0", *[f"p{i}" for i in range(j)]], outputCol="x").transform(rows)
        models.append(_coefficients(frame, category))
        if j + 1 < len(categories):
            parts = [_fit_one(frame.filter(F.col("fold") != f), category)(frame.filter(F.col("fold") == f)) for f in range(FOLDS)]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            rows = materialize(rows.withColumnRenamed("p", f"p{j}").drop("x"), "out-of-fold")
    return {"categories": categories, "vocabulary": vocabulary, "models": models}


def _logit(share: float | None) -> float:
    if share is None:
        return float("nan")
    share = min(max(share, 1e-6), 1 - 1e-6)
    return float(np.log(share / (1 - share)))


def _present(sample: DataFrame, vocabulary: list[str]) -> DataFrame:
    names, schema = [c for c in sample.columns if c != "text"], sample.drop("text").schema.add("found", T.ArrayType(T.StringType()))

    def run(batches):
        import pyarrow as pa
        features = Features(vocabulary)
        for batch in batches:
            found = [[vocabulary[i] for i in sorted(features.text(t))] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, pa.list_(pa.string()))],
                                             [*names, "found"])

    return sample.mapInArrow(run, schema)


def _regression(frame: DataFrame, category: str):
    """The fitted model, or the share of ones if there is only one class."""
    share = frame.agg(F.avg(category)).first()[0]
    if share in (None, 0, 1):
        return share
    weight = F.when(F.col(category) == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    return LogisticRegression(featuresCol="x", labelCol=category, weightCol="w", maxIter=60, regParam=REG, elasticNetParam=1.0,
                              probabilityCol="probability").fit(frame.withColumn("w", weight))


def _fit_one(frame: DataFrame, category: str):
    model = _regression(frame, category)
    if not isinstance(model, (int, float, type(None))):
        return lambda rows: model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop(
            "rawPrediction", "probability", "prediction")
    return lambda rows: rows.withColumn("p", F.lit(model).cast("double"))


def _coefficients(frame: DataFrame, category: str) -> tuple[np.ndarray, float]:
    model = _regression(frame, category)
    if isinstance(model, (int, float, type(None))):
        return np.zeros(0), _logit(model)
    return np.array(model.coefficients.toArray()), float(model.intercept)


def predict(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``<category>_prob`` and the boolean ``<category>`` for each category of the chain."""
    added = [f"{c}_prob" for c in model["categories"]] + model["categories"]
    given = docs.drop(*added)
    names = given.columns
    src = given.withColumn(unused_name(given, "__text"), F.col(text_col).cast("string"))
    schema = T.StructType([*given.schema.fields, *[T.StructField(f"{c}_prob", T.DoubleType()) for c in model["categories"]],
                           *[T.StructField(c, T.BooleanType()) for c in model["categories"]]])
    shared = docs.sparkSession.sparkContext.broadcast(model)    # at most MAX_FEATURES numbers a category

    def run(batches):
        import pyarrow as pa
        features, size = Features(shared.value["vocabulary"]), len(shared.value["vocabulary"])
        models = [(np.concatenate([w, np.zeros(max(0, size + j - len(w)))]), b) for j, (w, b) in enumerate(shared.value["models"])]
        for batch in batches:
            texts = batch.column(len(names))
            probs = np.empty((len(texts), len(models)))
            for i, text in enumerate(texts):
                found = list(features.text(text.as_py()))
                for j, (w, b) in enumerate(models):
                    z = b + w[found].sum() + w[size:] @ probs[i, :j]
                    probs[i, j] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            null = np.isnan(probs)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], *[pa.array(probs[:, j], mask=null[:, j]) for j in range(len(models))],
                 *[pa.array(probs[:, j] >= threshold) for j in range(len(models))]], [*names, *added])

    return src.mapInArrow(run, schema)
