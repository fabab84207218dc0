import math

import numpy as np
from pyspark.sql import functions as F

from wordloom.functions import tokens as T
from wordloom.operators import context, evaluate, pooling, vocab
from wordloom.operators.ranking import rank_by
from wordloom.operators.tokens import by_doc, explode_tokens, term_counts


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def vectors(spark, table):
    return spark.createDataFrame(list(table.items()), "word string, embedding array<float>")


def test_rank_by_matches_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") % 97).alias("c"), F.col("id").cast("string").alias("w"))
    got = {r.w: r.rank for r in rank_by(df, F.col("c").desc(), F.col("w").asc()).collect()}
    want = sorted(((-r.c, r.w) for r in df.collect()))
    assert [got[w] for _, w in want] == list(range(5000))


def test_topk_ties_broken_by_term(spark):
    tf = spark.createDataFrame([(d, t, 1) for d in range(3) for t in ("b", "a", "c")] + [(0, "z", 5)],
                               "doc_id long, term string, tf long")
    top = vocab.vocabulary_topk(tf, 2, min_df=1).orderBy("term_id").collect()
    assert [r.term for r in top] == ["z", "a"]


def test_idf_is_log2(spark):
    tf = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (1, "b", 2)], "doc_id long, word string, tf long")
    got = {r.word: r.idf for r in vocab.idf(tf, 4).collect()}
    assert math.isclose(got["a"], 1.0) and math.isclose(got["b"], 2.0)


def test_tfidf_drops_zero_idf_and_normalises(spark):
    tf = spark.createDataFrame([(0, "a", 1), (0, "b", 3), (1, "a", 2)], "doc_id long, word string, tf long")
    w = vocab.tfidf(tf, vocab.idf(tf, 2)).collect()
    assert [(r.doc_id, r.word) for r in w] == [(0, "b")]      # "a" is in every document
    assert math.isclose(w[0].tfidf, 1.0)


def test_pooling_mean_sum_std(spark):
    docs = corpus(spark, [(1, "en", "a b a zz"), (2, "en", "zz qq")])
    toks = explode_tokens(by_doc(docs), T.tokens_word("text"))
    hits = pooling.lookup_vectors(term_counts(toks), vectors(spark, {"a": [1.0, 0.0], "b": [4.0, 3.0]}))
    mean = {r.doc_id: r.features for r in pooling.pool(hits, "mean").collect()}
    summ = {r.doc_id: r.features for r in pooling.pool(hits, "sum").collect()}
    std = {r.doc_id: r.features for r in pooling.pool(hits, "std").collect()}
    # trap 7: a document without a known word has no row
    assert set(mean) == {1}
    assert np.allclose(mean[1], [2.0, 1.0])                    # occurrences a, a, b
    assert np.allclose(summ[1], np.array(mean[1]) * 3)         # mean × count = sum
    assert np.allclose(std[1], [2.0, 1.0, np.std([1, 1, 4]), np.std([0, 0, 3])])   # population std


def test_pooling_repartition_invariant(spark):
    rows = [(i, "en", " ".join(["a", "b", "c"][: 1 + i % 3] * (1 + i % 5))) for i in range(40)]
    vec = vectors(spark, {"a": [1.0, 2.0], "b": [0.5, -1.0], "c": [3.0, 3.0]})

    def run(n):
        docs = corpus(spark, rows).repartition(n)
        hits = pooling.lookup_vectors(term_counts(explode_tokens(by_doc(docs), T.tokens_word("text"))), vec)
        return {r.doc_id: np.round(r.features, 9).tolist() for r in pooling.pool(hits, "mean").collect()}
    assert run(1) == run(7)


def test_tfidf_pooling_zero_weight_keeps_place(spark):
    # trap 4: a word with weight 0 contributes nothing; the others keep their own weights
    hits = spark.createDataFrame([(1, "a", 1, 0.0, [9.0]), (1, "b", 2, 0.5, [1.0]), (1, "c", 1, 1.0, [4.0])],
                                 "doc_id long, word string, tf long, tfidf double, vector array<float>")
    got = pooling.pool(hits, "tfidf").first().features
    assert np.allclose(got, [(2 * 0.5 * 1.0 + 1 * 1.0 * 4.0) / (2 * 0.5 + 1.0)])


def _ws(spark, rows):
    return explode_tokens(by_doc(corpus(spark, rows)), T.tokens_ws("text"))


def test_context_needs_all_offsets_and_two_positions(spark):
    vec = spark.createDataFrame([(o, w, [float(o), 1.0]) for o in (-2, -1, 1, 2) for w in ("a", "b", "c", "d", "e")],
                                "offset int, word string, embedding array<float>")
    # doc 1: five known words -> exactly one valid centre -> dropped (needs more than one)
    # doc 2: six known words -> two centres -> kept; doc 3: an unknown word at offset -1 breaks the only window
    toks = _ws(spark, [(1, "en", "a b c d e"), (2, "en", "a b c d e a"), (3, "en", "a X c d e")])
    n = {r.doc_id: r.n_positions for r in context.valid_positions(toks, vec, 4).collect()}
    assert n == {1: 1, 2: 2}
    docs = {r.doc_id: r.features for r in context.context_doc_vectors(toks, vec, 4, "sum").collect()}
    assert set(docs) == {2}
    # left half = mean(-2, -1) = -1.5 per dim0; right = 1.5; two positions summed
    assert np.allclose(docs[2], [-3.0, 2.0, 3.0, 2.0])


def test_context_tokens_keep_full_stops(spark):
    # trap 2: "end." stays one whitespace token
    toks = _ws(spark, [(1, "en", "the end. now")]).collect()
    assert [r.word for r in toks] == ["the", "end.", "now"]


def test_context_window_frames(spark):
    toks = _ws(spark, [(1, "en", "a b c d e f")])
    rows = context.context_window(toks, 4).orderBy("pos").collect()
    assert [(r.pos, r.left, r.right) for r in rows] == [(2, "a b", "d e"), (3, "b c", "e f")]


def test_report_and_macro_f1(spark):
    p = spark.createDataFrame([("x", "x"), ("x", "y"), ("y", "y"), ("z", "y")], "label string, prediction string")
    rep = {r.label: r for r in evaluate.classification_report(p).collect()}
    assert rep["z"].precision == 0.0 and rep["z"].f1 == 0.0 and rep["z"].support == 1
    assert math.isclose(rep["y"].precision, 1 / 3) and rep["y"].recall == 1.0
    f1 = evaluate.macro_f1(p).first()
    assert math.isclose(f1.macro_f1, (2 / 3 + 0.5 + 0.0) / 3) and f1.n_classes == 3


def test_score_linear_argmax_ties_to_smaller_label(spark):
    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1)], "doc_id long, word string, tf long")
    w = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", -1)], "label_code int, word string, weight long")
    assert evaluate.score_linear(counts, w).first().prediction == 0



def test_rank_by_empty_table(spark):
    empty = spark.createDataFrame([], "c long, w string")
    assert rank_by(empty, F.col("c").desc(), F.col("w")).count() == 0
