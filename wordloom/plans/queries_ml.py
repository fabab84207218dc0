"""Model fitting and scoring queries.

Dense labelled features are ``embeddings`` (embedding, label), split by
``vec_id % 10`` (0-7 train, 8 dev, 9 test); text models use ``documents``.
Grids are the named constants of ``wordloom.schema``.  A17 and the folds of M10
have a SQL oracle.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Window
from pyspark.sql import functions as F

from wordloom.functions import tokens as T
from wordloom.operators import classify as C
from wordloom.operators import evaluate
from wordloom.operators import alignment
from wordloom.operators import forest
from wordloom.operators import joint_vectors as J
from wordloom.operators import kernel_svm as svm
from wordloom.operators.ranking import materialize
from wordloom.operators.svm import best_setting, training_rows
from wordloom.plans import fixtures as fx
from wordloom.plans.queries import docs, r4, register
from wordloom.schema import (CORPUS_LABELS, DOC_VECTOR_MIN_COUNT, DOC_VECTOR_SIZES, DOC_VECTOR_WINDOWS, NGRAM_MIN_DF, NUM_LANDMARKS, RF_TREES, SVM_CS, SVM_GAMMAS,
                             SWEEP_CS, SWEEP_GAMMAS, WORD_VECTOR_SIZES, WORD_VECTOR_WINDOWS)
from wordloom.session import scratch_path, table
from wordloom.sources import writers as K

# Settings of the original training calls.
WORD_VECTOR_MIN_COUNT = 5
WORD_VECTOR_PASSES = 25
DOC_VECTORS = J.Settings(size=500, window=25, min_count=DOC_VECTOR_MIN_COUNT, passes=50)
LABEL_VECTORS = J.Settings(size=500, window=25, min_count=DOC_VECTOR_MIN_COUNT, passes=10)

DIM = 64
CLASSES = 10    # labels 0..9 of ``embeddings``


def _dense(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("double").alias("label_code"),
                    array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
                    fx.split_of("vec_id").alias("split"),
                    F.pmod(F.floor(F.col("vec_id") / 10), F.lit(5)).cast("int").alias("fold"))


def _predictions(model, df):
    return model.transform(df).select("vec_id", "split", F.col("label_code").cast("int").alias("label"),
                                      F.col("prediction").cast("int").alias("prediction"))


@register("a17_min_max_scale", """
WITH e AS (SELECT vec_id, u.i::INT AS dim, embedding[u.i + 1]::DOUBLE AS x
           FROM embeddings, unnest(range(len(embedding))) AS u(i)),
     r AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM e WHERE vec_id % 10 < 8 GROUP BY dim)
SELECT e.vec_id, e.dim, round(CASE WHEN r.hi = r.lo THEN 0.0 ELSE (e.x - r.lo) / (r.hi - r.lo) END, 4) + 0.0 AS value
FROM e JOIN r USING (dim)""")
def a17_min_max_scale(spark, sf_dir):
    d = _dense(spark, sf_dir)
    model = C.ZeroRangeMinMaxScaler(inputCol="features", outputCol="scaled").fit(d.filter(F.col("split") == "train"))
    out = model.transform(d).select("vec_id", vector_to_array("scaled").alias("v"))
    return out.select("vec_id", F.posexplode("v").alias("dim", "value")).select(
        "vec_id", F.col("dim").cast("int").alias("dim"), r4("value").alias("value"))


@register("m6_logistic_regression")
def m6_logistic_regression(spark, sf_dir):
    d = _dense(spark, sf_dir)
    train = d.filter(F.col("split") == "train")
    model = C.logistic_regression(0.1, train.count()).fit(train)
    return _predictions(model, d.filter(F.col("split") != "train"))


def _svm_rows(spark, sf_dir):
    return training_rows(_dense(spark, sf_dir), "features", "label_code", "fold", keep=("vec_id", "split"))


def _svm_predictions(rows, grid):
    return svm.predict(rows, grid).select("vec_id", "split", F.col("y").alias("label"), "prediction")


@register("m8_linear_svm")
def m8_linear_svm(spark, sf_dir):
    """Train, dev and test rows with the prediction of a linear SVM fitted on train."""
    d = _svm_rows(spark, sf_dir)
    return _svm_predictions(d, svm.refit(d.filter("split = 'train'"), DIM, CLASSES, "linear", 0.0, 1.0, NUM_LANDMARKS))


@register("m9_rbf_svm")
def m9_rbf_svm(spark, sf_dir):
    """Predictions of an RBF machine (gamma 1, C 10): exact up to 512 training rows, else by 512 landmarks."""
    d = _svm_rows(spark, sf_dir)
    return _svm_predictions(d, svm.refit(d.filter("split = 'train'"), DIM, CLASSES, "rbf", 1.0, 10.0, 4 * NUM_LANDMARKS))


@register("m10_folds", """
WITH t AS (SELECT vec_id // 10 % 5 AS fold FROM embeddings WHERE vec_id % 10 < 8)
SELECT fold::INT AS fold, count(*)::BIGINT AS n_held_out, (SELECT count(*) FROM t)::BIGINT - count(*)::BIGINT AS n_fitted
FROM t GROUP BY fold""")
def m10_folds(spark, sf_dir):
    """Rows that each fold holds out and rows that its models are fitted on."""
    train = _svm_rows(spark, sf_dir).filter("split = 'train'")
    per = train.groupBy("fold").agg(F.count(F.lit(1)).alias("n_held_out"))
    total = F.sum("n_held_out").over(Window.partitionBy())      # one row per fold
    return per.select("fold", "n_held_out", (total - F.col("n_held_out")).alias("n_fitted"))


@register("m10_svm_grid_cv")
def m10_svm_grid_cv(spark, sf_dir):
    """35 settings x 5 folds, then the best setting refitted on all training rows: its accuracy on train, dev and test."""
    d = _svm_rows(spark, sf_dir)
    train = d.filter("split = 'train'")
    cv = materialize(svm.grid_cv(train, DIM, CLASSES, SVM_GAMMAS, SVM_CS, NUM_LANDMARKS), "svm-grid")
    best = best_setting(cv)
    setting = {c: best[c] for c in ("kernel", "gamma", "c")}
    machine = svm.refit(train, DIM, CLASSES, **setting, landmarks=NUM_LANDMARKS)
    found = svm.predict(d, machine)
    again = found.groupBy(F.col("split").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("y") == F.col("prediction")).cast("double")).alias("accuracy"))
    again = again.select(*[F.lit(v).alias(c) for c, v in setting.items()], F.concat(F.lit("refit "), "part").alias("part"), "n", "accuracy",
                         F.lit(float(machine.gaps[svm.ALL, 0].max())).alias("gap"))
    return cv.select("kernel", "gamma", "c", F.concat(F.lit("fold "), "fold").alias("part"), "n", "accuracy", "gap").unionByName(again)


@register("m11_random_forest_grid_cv")
def m11_random_forest_grid_cv(spark, sf_dir):
    """4 numbers of fully grown trees x 4 folds, then the best number refitted on all training rows: its accuracy on train, dev and test."""
    d = _dense(spark, sf_dir).withColumn("fold", F.pmod(F.floor(F.col("vec_id") / 10), F.lit(4)).cast("int"))
    d = d.withColumn("features", vector_to_array("features"))
    train = d.filter("split = 'train'")
    cv = forest.grid_cv(train, RF_TREES, CLASSES, "vec_id")
    best = cv.groupBy("n_trees").agg(F.avg("accuracy").alias("a")).orderBy(F.col("a").desc(), "n_trees").first()["n_trees"]
    voted = forest.votes(d, forest.fit(train, best, CLASSES), [best], "vec_id").join(d.select("vec_id", "split", "label_code"), "vec_id")
    voted = voted.select("split", (F.col("prediction") == F.col("label_code")).cast("double").alias("right"))
    again = voted.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("right").alias("accuracy"))
    again = again.select(F.lit(best).alias("n_trees"), F.concat(F.lit("refit "), "split").alias("part"), "n", "accuracy")
    return cv.select("n_trees", F.concat(F.lit("fold "), "fold").alias("part"), "n", "accuracy").unionByName(again)


@register("m12_parameter_sweep")
def m12_parameter_sweep(spark, sf_dir):
    """24 settings (6 gammas x 4 Cs), accuracy on train and dev."""
    d = _svm_rows(spark, sf_dir)
    parts = {p: d.filter(F.col("split") == p) for p in ("train", "dev")}
    return svm.sweep(parts["train"], parts, DIM, CLASSES, SWEEP_GAMMAS, SWEEP_CS, NUM_LANDMARKS)


@register("k7_save_model")
def k7_save_model(spark, sf_dir):
    d = _dense(spark, sf_dir)
    train = d.filter(F.col("split") == "train")
    pipe = Pipeline(stages=[C.ZeroRangeMinMaxScaler(inputCol="features", outputCol="scaled"),
                            C.logistic_regression(0.1, train.count(), features="scaled")])
    path = K.save_model(pipe.fit(train), scratch_path(spark, "models"), "mean", DIM, 5)
    return _predictions(PipelineModel.load(path), d.filter(F.col("split") != "train"))


def _m7(spark, sf_dir, group):
    from wordloom.plans.pipelines import ngram_classification
    return ngram_classification(docs(spark, sf_dir).withColumn("split", fx.split_of()), group, min_df=NGRAM_MIN_DF, c=0.1)


@register("m7_ngram_pipeline")
def m7_ngram_pipeline(spark, sf_dir):
    """Word n-grams 1..3 -> counts over the A15 vocabulary (df >= 10) -> logistic regression; dev and test scored."""
    return _m7(spark, sf_dir, "uni_to_tri")


@register("m7_ngram_pipeline_1to8")
def m7_ngram_pipeline_1to8(spark, sf_dir):
    return _m7(spark, sf_dir, "tri_to_five")


@register("m7_ngram_pipeline_char")
def m7_ngram_pipeline_char(spark, sf_dir):
    return _m7(spark, sf_dir, "char")


@register("m7_ngram_pipeline_char_wb")
def m7_ngram_pipeline_char_wb(spark, sf_dir):
    return _m7(spark, sf_dir, "char_wb")


def _words(spark, sf_dir):
    """(doc_id, lang, split, words): treebank tokens of the lower-cased text."""
    d = docs(spark, sf_dir).select("doc_id", "lang", fx.split_of().alias("split"), T.tokens_treebank(F.lower("text")).alias("words"))
    return materialize(d, "words")


@register("m1_train_word_vectors")
def m1_train_word_vectors(spark, sf_dir):
    """Word vectors of the training documents: 300 dimensions, window 5, min count 5, 25 passes."""
    d = docs(spark, sf_dir).filter(F.col("doc_id") % 10 < 8).select(
        F.lit(0).alias("model"), "doc_id", T.tokens_word(F.lower("text")).alias("words"))
    settings = J.Settings(WORD_VECTOR_SIZES[0], WORD_VECTOR_WINDOWS[0], WORD_VECTOR_MIN_COUNT, WORD_VECTOR_PASSES)
    return J.train(materialize(d, "words"), settings, with_docs=False).word_vectors().select("word", "embedding")


@register("m2_two_spaces")
def m2_two_spaces(spark, sf_dir):
    """Word spaces trained apart on the training and on the other documents (settings of M1), the second turned into the
    first; every document is the mean of its words' vectors in its own space."""
    d = docs(spark, sf_dir).select("doc_id", fx.split_of().alias("split"), T.tokens_word(F.lower("text")).alias("words")).withColumn(
        "model", (F.col("split") != "train").cast("int"))
    settings = J.Settings(WORD_VECTOR_SIZES[0], WORD_VECTOR_WINDOWS[0], WORD_VECTOR_MIN_COUNT, WORD_VECTOR_PASSES)
    d = materialize(d, "words")
    words = J.train(d.select("model", "doc_id", "words"), settings, with_docs=False).word_vectors()
    own, other = (words.filter(F.col("model") == m).select("word", "embedding") for m in (0, 1))
    spaces = materialize(own.select(F.lit(0).alias("model"), "*").unionByName(
        alignment.align(other, own, settings.size).select(F.lit(1).alias("model"), "*")), "spaces")
    tf = d.select("model", "doc_id", F.explode("words").alias("word")).groupBy("model", "doc_id", "word").agg(F.count(F.lit(1)).alias("tf"))
    found = tf.join(spaces, ["model", "word"]).select("doc_id", "tf", array_to_vector("embedding").alias("v"))
    pooled = found.groupBy("doc_id").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("tf").cast("double"))).alias("features"))
    return pooled.join(d.select("doc_id", "split"), "doc_id").select("doc_id", "split", "features")


def _doc_vectors(spark, sf_dir):
    """Trained on the training documents (500 dimensions, window 25, min count 10, 50 passes); every document inferred."""
    words = _words(spark, sf_dir).withColumn("model", F.lit(0))
    of = words.select("model", "doc_id", "words")
    trained = J.train(of.join(words.filter("split = 'train'").select("doc_id"), "doc_id", "left_semi").select(*of.columns), DOC_VECTORS)
    return materialize(J.infer(trained, of).join(words.select("doc_id", "lang", "split"), "doc_id").select(
        "doc_id", "lang", "split", F.col("embedding").alias("features")), "doc-vectors")


def _per_label(spark, sf_dir):
    """One model per label, trained on the label's training documents (500 dimensions, window 25, 10 passes); every
    document inferred by all, its vectors joined in label order, zeros where a model knows none of its words."""
    words = _words(spark, sf_dir)
    models = F.array(*[F.lit(i) for i in range(len(CORPUS_LABELS))])
    trained = J.train(words.filter("split = 'train'").select(fx.label_code("lang").cast("int").alias("model"), "doc_id", "words")
                      .filter(F.col("model").isNotNull()), LABEL_VECTORS)
    found = J.infer(trained, words.select(F.explode(models).alias("model"), "doc_id", "words"))
    joined = found.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "embedding"))).alias("of"))   # one entry per label
    zeros = F.array_repeat(F.lit(0.0), LABEL_VECTORS.size)
    features = F.concat(*[F.coalesce(F.try_element_at("of", F.lit(i)), zeros) for i in range(len(CORPUS_LABELS))])
    return materialize(joined.select("doc_id", features.alias("features")).join(words.select("doc_id", "lang", "split"), "doc_id"), "label-vectors")


def _classified(vectors, c):
    """Logistic regression on the training vectors; accuracy and macro F1 of every split."""
    d = vectors.withColumn("label_code", fx.label_code("lang").cast("double")).withColumn("features", array_to_vector("features"))
    train = d.filter("split = 'train'")
    pred = C.logistic_regression(c, train.count()).fit(train).transform(d).select(
        "split", F.col("label_code").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))
    pred = materialize(pred, "predictions")
    f1 = None
    for split in ("train", "dev", "test"):
        one = evaluate.macro_f1(pred.filter(F.col("split") == split)).withColumn("split", F.lit(split))
        f1 = one if f1 is None else f1.unionByName(one)
    return evaluate.accuracy(pred, by=("split",)).join(f1, "split")


@register("m3_doc_vectors")
def m3_doc_vectors(spark, sf_dir):
    return _doc_vectors(spark, sf_dir).select("doc_id", "split", "features")


@register("m3_doc_vector_classification")
def m3_doc_vector_classification(spark, sf_dir):
    """S6, S7 -> M3 -> M6 (C = 0.1) -> E1, E2."""
    return _classified(_doc_vectors(spark, sf_dir), 0.1)


@register("m4_doc_vectors_transductive")
def m4_doc_vectors_transductive(spark, sf_dir):
    """Trained on train and test together (100 dimensions, window 5, min count 5, 50 passes); the trained vectors, by split."""
    words = _words(spark, sf_dir).withColumn("model", F.lit(0)).filter(F.col("split").isin("train", "test"))
    settings = J.Settings(DOC_VECTOR_SIZES[0], DOC_VECTOR_WINDOWS[0], WORD_VECTOR_MIN_COUNT, DOC_VECTORS.passes)
    trained = J.train(words.select("model", "doc_id", "words"), settings)
    return trained.doc_vectors().join(words.select("doc_id", "split"), "doc_id").select("doc_id", "split", F.col("embedding").alias("features"))


@register("m5_doc_vectors_per_label")
def m5_doc_vectors_per_label(spark, sf_dir):
    return _per_label(spark, sf_dir).select("doc_id", "split", "features")


@register("m5_doc_vector_classification")
def m5_doc_vector_classification(spark, sf_dir):
    """K5 -> M5 -> M6 (C = 0.01) -> E1, E2."""
    return _classified(_per_label(spark, sf_dir), 0.01)
