import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from wordloom.operators import classify as C
from wordloom.operators import svm as S
from wordloom.operators import vectors as V


def test_min_max_constant_feature_is_zero(spark):
    # trap 14: a constant dimension scales to 0; test values stay unclipped
    train = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "f array<double>").select(array_to_vector("f").alias("features"))
    test = spark.createDataFrame([([4.0, 5.0],)], "f array<double>").select(array_to_vector("f").alias("features"))
    m = C.ZeroRangeMinMaxScaler(inputCol="features", outputCol="s").fit(train)
    assert sorted(r.s.toArray().tolist() for r in m.transform(train).collect()) == [[0.0, 0.0], [1.0, 0.0]]
    assert m.transform(test).first().s.toArray().tolist() == [1.5, 0.0]


def test_rff_approximates_rbf_kernel(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 5)) * 0.5
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(6)], "i int, f array<double>")
    df = df.select("i", array_to_vector("f").alias("features"))
    z = C.RandomFourierFeatures(inputCol="features", outputCol="z", gamma=0.5, numFeatures=4000, inputDim=5, seed=3)
    zs = {r.i: r.z.toArray() for r in z.transform(df).collect()}
    for i in range(6):
        for j in range(6):
            k = np.exp(-0.5 * np.sum((x[i] - x[j]) ** 2))
            assert abs(zs[i] @ zs[j] - k) < 0.08


def test_logistic_regression_learns_separable_data(spark):
    rows = [(float(i % 2), [float(i % 2) * 3 + 0.1 * (i % 5), 1.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "label_code double, f array<double>").select("label_code", array_to_vector("f").alias("features"))
    model = C.logistic_regression(10.0, 60).fit(df)
    acc = model.transform(df).select(F.avg((F.col("prediction") == F.col("label_code")).cast("double"))).first()[0]
    assert acc == 1.0


def test_doc_vector_inference_partition_invariant_and_seeded(spark):
    vec = spark.createDataFrame([(w, np.random.default_rng(k).normal(size=4).tolist()) for k, w in enumerate("abcdef")],
                                "word string, embedding array<double>")
    tf = spark.createDataFrame([(d, w, 1 + (d + k) % 3) for d in range(12) for k, w in enumerate("abcdef") if (d + k) % 4],
                               "doc_id long, word string, tf long")
    neg = np.random.default_rng(1).normal(size=(8, 4))

    def run(n, seed=0):
        out = V.infer_doc_vectors(tf.repartition(n), vec, 4, neg, epochs=5, seed=seed)
        return {r.doc_id: np.round(r.features, 10).tolist() for r in out.collect()}
    a = run(1)
    assert a == run(5)
    assert a != run(1, seed=9)
    assert all(len(v) == 4 for v in a.values())


def test_doc_vectors_per_label_concatenates_in_label_order(spark):
    tf = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 1)], "doc_id long, word string, tf long")
    va = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, embedding array<double>")
    vb = spark.createDataFrame([("c", [1.0, 1.0])], "word string, embedding array<double>")
    neg = {"A": np.zeros((0, 2)), "B": np.zeros((0, 2))}
    out = {r.doc_id: r.features for r in V.doc_vectors_per_label(tf, {"A": va, "B": vb}, 2, neg, epochs=3).collect()}
    assert set(out) == {1, 2} and all(len(v) == 4 for v in out.values())
    assert out[1][2:] == [0.0, 0.0]          # doc 1 has no word in B's space
    assert out[2][:2] == [0.0, 0.0]          # doc 2 has no word in A's space


def _blobs(spark, n=150, seed=4):
    rng = np.random.default_rng(seed)
    centres = np.array([[0.0, 0.0, 5.0], [3.0, 0.0, 5.0], [0.0, 3.0, 5.0]])
    rows = [(i, i % 3, i // 3 % 5, (centres[i % 3] + rng.normal(size=3) * [0.6, 0.6, 0.0]).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, y int, fold int, x array<double>"), rows


def test_svm_grid_holds_every_row_out_once(spark):
    df, rows = _blobs(spark)
    cv = S.grid_cv(df.repartition(3), 3, 3, [1.0, 1e-3], [1.0, 100.0], 64).collect()
    assert len(cv) == (2 + 1) * 2 * 5
    for setting in {(r.kernel, r.gamma, r.c) for r in cv}:
        own = [r for r in cv if (r.kernel, r.gamma, r.c) == setting]
        assert sorted(r.fold for r in own) == [0, 1, 2, 3, 4] and sum(r.n for r in own) == len(rows)
    best = max(np.mean([r.accuracy for r in cv if (r.kernel, r.c) == k]) for k in {(r.kernel, r.c) for r in cv})
    assert best > 0.9


def test_svm_reaches_the_optimum(spark):
    """The joint solver against plain gradient descent on one model of the grid."""
    df, rows = _blobs(spark, 60)
    grid = S.fit(df, S.Grid(3, 3, [("linear", 0.0)], [1.0, 10.0], [2, S.ALL], 8), max_iter=300, tol=1e-6)
    for view in (2, S.ALL):
        own = [r for r in rows if r[2] != view]
        x = grid.scaled(np.array([r[3] for r in own]), view)
        assert (x[:, 2] == 0).all() and x.min() == 0 and x.max() == 1      # scaled by the view's own rows, constant to 0
        z, n = np.hstack([x, np.ones((len(own), 1))]), len(own)
        for j, c in enumerate((1.0, 10.0)):
            for k in range(3):
                y = np.where(np.array([r[1] for r in own]) == k, 1.0, -1.0)
                value = lambda w: (np.maximum(0, 1 - y * (z @ w)) ** 2).mean() + (w[:-1] @ w[:-1]) / (2 * c * n)
                w = np.zeros(4)
                for _ in range(20_000):
                    w -= 0.05 * (-2 * z.T @ (y * np.maximum(0, 1 - y * (z @ w))) / n + np.append(w[:-1], 0) / (c * n))
                assert value(grid.weights[view, 0][:, j * 3 + k]) <= value(w) + 1e-4


def test_svm_sweep_and_prediction(spark):
    df, rows = _blobs(spark)
    got = S.sweep(df, {"train": df, "dev": df.filter("fold = 0")}, 3, 3, [1.0, 0.1], [1.0, 10.0], 64).collect()
    assert len(got) == 8 and {r.n for r in got} == {150, 30} and max(r.accuracy for r in got) > 0.9
    found = S.predict(df, S.refit(df, 3, 3, "rbf", 1.0, 10.0, 64)).collect()
    assert np.mean([r.prediction == r.y for r in found]) > 0.9


def test_forest_grid(spark):
    df, rows = _blobs(spark)
    df = df.select("vec_id", F.col("y").cast("double").alias("label_code"), "fold", array_to_vector("x").alias("features"))
    got = C.random_forest_grid_cv(df, [4, 10, 6], 3).collect()
    assert sorted((r.n_trees, r.fold) for r in got) == [(t, k) for t in (4, 6, 10) for k in range(5)]
    assert all(r.n == 30 for r in got) and np.mean([r.accuracy for r in got]) > 0.8
    assert C.forest_blocks([500, 750, 1000, 1500]) == [500, 250, 250, 500]
