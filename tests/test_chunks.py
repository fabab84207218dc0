"""Lookups by chunks of documents: the rows of a plain join, and no shuffle of rows with vectors."""

import re

import pytest
from pyspark.sql import functions as F

from wordloom.functions import tokens as T
from wordloom.operators import chunks, context, pooling, tagger, vocab
from wordloom.operators.tokens import by_doc, explode_tokens, term_counts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(monkeypatch):
    """Every word table counts as large."""
    monkeypatch.setattr(chunks, "SMALL", 0)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def docs(spark):
    texts = [(1, "a b c a d"), (2, "b b x"), (2, "c a"), (None, "a c"), (4, None), (5, "")]
    return spark.createDataFrame(texts, "doc_id long, text string").withColumn("lang", F.lit("en"))


def vectors(spark):
    return spark.createDataFrame([("a", [1.0, 2.0]), ("b", [0.5, -1.0]), ("b", [2.5, 1.0]), ("c", [4.0, 0.0]), (None, [9.0, 9.0])],
                                 "word string, embedding array<float>")


def test_attach_is_a_join(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "b", 3), (2, None, 4), (None, "a", 5), (3, "z", 6)], "doc_id long, word string, tf long")
    for how in ("inner", "left"):
        columns = ["doc_id", "word", "tf", "embedding"]
        found = chunks.attach(t, vectors(spark), "doc_id", "word", how, 3, small=0)
        assert rows(found.select(columns)) == rows(t.join(vectors(spark), "word", how).select(columns))


def _pooled(spark, how):
    tf = term_counts(explode_tokens(by_doc(docs(spark)), T.tokens_word("text")))
    if how == "tfidf":
        tf = vocab.tfidf(tf, vocab.idf(tf, 6))
    hits = pooling.lookup_vectors(tf, vectors(spark), chunks=3)
    return {r["doc_id"]: r["features"] for r in pooling.pool(hits, how).collect()}, hits


@pytest.mark.parametrize("how", ["mean", "sum", "std", "tfidf"])
def test_pooling_in_chunks_matches_the_plain_join(spark, monkeypatch, how):
    plain, _ = _pooled(spark, how)
    monkeypatch.setattr(chunks, "SMALL", 0)
    found, hits = _pooled(spark, how)
    assert chunks.CHUNK in hits.columns and found.keys() == plain.keys()
    for doc, features in plain.items():
        assert found[doc] == pytest.approx(features, abs=1e-6)


def test_documents_dealt_once_move_once(spark, large):
    """Term counts, tf-idf and pooling stay where their documents were dealt; a document's rows with vectors are not moved."""
    d = chunks.deal(docs(spark), "doc_id", 3)
    tf = term_counts(explode_tokens(d, T.tokens_word("text")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(pooling.pool(pooling.lookup_vectors(tf, vectors(spark)), "mean"))
        assert not re.search(r"hashpartitioning\((word|doc_id)#\d+L?, ?__chunk|hashpartitioning\(doc_id|hashpartitioning\(__chunk#\d+, (word|doc_id)", p)
        weights = vocab.tfidf(tf, vocab.idf(tf, 6))
        assert "hashpartitioning(doc_id" not in plan(pooling.weight_join(tf, weights))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_weight_join_in_chunks(spark, large):
    plain = term_counts(explode_tokens(docs(spark), T.tokens_word("text")))
    tf = term_counts(explode_tokens(chunks.deal(docs(spark), "doc_id", 3), T.tokens_word("text")))
    w = lambda t: t.filter("word <> 'c'").withColumn("tfidf", F.length("word") * F.col("tf") / 2)
    columns = ["doc_id", "word", "tf", "tfidf"]
    twice = w(tf).unionByName(w(tf).filter("word = 'b'"))
    assert rows(pooling.weight_join(tf, twice).select(columns)) == rows(
        pooling.weight_join(plain, w(plain).unionByName(w(plain).filter("word = 'b'"))).select(columns))


def test_contexts_in_chunks_match_the_plain_join(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b c a b c a"), (2, "a b q b a c b a"), (3, "a b")], "doc_id long, text string")
    cv = spark.createDataFrame([(o, w, [float(o), float(ord(w))]) for o in (-1, 1) for w in "abc"], "offset int, word string, embedding array<float>")
    toks = explode_tokens(by_doc(d.union(d.filter("doc_id = 2"))), T.tokens_ws("text"))      # a document in two equal rows

    def found():
        return (rows(context.position_vectors(toks, cv, 2)), rows(context.valid_positions(toks, cv, 2)),
                rows(context.valid_hits(toks, cv, 2)), *(rows(context.context_doc_vectors(toks, cv, 2, how)) for how in ("sum", "mean")))

    plain = found()
    monkeypatch.setattr(chunks, "SMALL", 0)
    assert found() == plain and all(plain)


def test_tagger_does_not_copy_scores_for_every_salt(spark):
    tagged = spark.createDataFrame([(1, i, w, t) for i, (w, t) in enumerate([("the", "D"), ("dog", "N"), (".", ".")])],
                                   "doc_id long, pos int, word string, tag string")
    out = tagger.tag(tagged.drop("tag"), tagger.fit(tagged))
    assert [r["tag"] for r in out.orderBy("pos").collect()] == ["D", "N", "."]
    assert "Range" not in plan(out) and "sequence(0" not in plan(out)


def test_partitions_by_document_grow_with_the_text(spark):
    def parts(mb):
        d = spark.range(mb).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (1 << 20) // 5).alias("text"))
        return int(re.search(r"hashpartitioning\(doc_id#\d+L, (\d+)\)", plan(by_doc(d))).group(1))

    assert parts(1) <= spark.sparkContext.defaultParallelism
    assert parts(80) >= 80 * (1 << 20) * 0.95 / chunks.TEXT_BYTES


def test_context_sums_keep_vectors_apart_from_tokens(spark, monkeypatch, capsys):
    """Each token's row used to carry all vectors of its word through a window's sort."""
    from wordloom.operators import context
    words = [(None, i, "aa") for i in range(6)] + [(1, i, w) for i, w in enumerate(["aa", "bb", "aa", "bb", "aa", None, "aa"])] + [(2, i, "aa") for i in range(3)]
    toks = spark.createDataFrame(words, "doc_id long, pos int, word string")
    vectors = spark.createDataFrame([(o, w, [float(i + o), 1.5]) for i, w in enumerate(["aa", "bb"]) for o in (-1, 1)] + [(1, "aa", [0.25, 0.5]), (3, "aa", [9.0, 9.0])],
                                    "offset int, word string, embedding array<float>")
    plain = {how: sorted(map(str, context.context_doc_vectors(toks, vectors, 2, how).collect())) for how in ("sum", "mean")}
    monkeypatch.setattr(chunks, "SMALL", 0)
    for how, rows in plain.items():
        got = context.context_doc_vectors(toks, vectors, 2, how, chunks=3)
        assert sorted(map(str, got.collect())) == rows
    got.explain()
    plan = capsys.readouterr().out
    assert "Window" not in plan and "FlatMapCoGroupsInArrow" in plan
