"""Plan shape guards: per-document pipelines shuffle the documents once and nothing else."""

import re

from wordloom.functions import tokens as T
from wordloom.operators import context, pooling
from wordloom.operators.ranking import materialize
from wordloom.operators.tokens import by_doc, explode_tokens, term_counts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.createDataFrame([(i, "en", "a b c d e f a b") for i in range(20)], "doc_id long, lang string, text string")


def test_pooling_plan_single_shuffle(spark):
    toks = explode_tokens(by_doc(docs(spark)), T.tokens_word("text"))
    # vector tables are materialised: the planner then knows their size and broadcasts them
    vec = materialize(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, embedding array<float>"), "v")
    p = plan(pooling.pool(pooling.lookup_vectors(term_counts(toks), vec), "mean"))
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1
    assert "hashpartitioning(doc_id" in p and "BroadcastHashJoin" in p


def test_context_plan_single_shuffle(spark):
    toks = explode_tokens(by_doc(docs(spark)), T.tokens_ws("text"))
    vec = materialize(spark.createDataFrame([(o, w, [1.0]) for o in (-1, 1) for w in "abcdef"],
                                            "offset int, word string, embedding array<float>"), "cv")
    p = plan(context.context_doc_vectors(toks, vec, 2, "sum"))
    assert _exchanges_of_documents(p) == 1
    assert "BroadcastHashJoin" in p


def test_bucketed_corpus_needs_no_shuffle(spark, tmp_out):
    from wordloom.sources.writers import write_bucketed_corpus
    t = write_bucketed_corpus(docs(spark), "wl_bucketed_docs", tmp_out("bucketed"), 4)
    toks = explode_tokens(by_doc(t, bucketed=True), T.tokens_word("text"))
    vec = materialize(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, embedding array<float>"), "v2")
    p = plan(pooling.pool(pooling.lookup_vectors(term_counts(toks), vec), "mean"))
    assert "Exchange hashpartitioning" not in p
    assert len(pooling.pool(pooling.lookup_vectors(term_counts(toks), vec), "mean").collect()) == 20


def test_row_wise_queries_do_not_shuffle(spark):
    from wordloom.plans.queries import all_queries
    queries = all_queries()
    for name in ("t1_tokens_ws", "t2_tokens_word", "t3_tokens_word2", "t4_tokens_treebank", "t5_normalize_text", "t6_stopword_filter"):
        assert "Exchange" not in plan(queries[name](spark, "/root/testdata/sf0.001")), name


def _exchanges_of_documents(p):
    return len(re.findall(r"Exchange hashpartitioning\(doc_id", p))


def test_large_vector_tables_do_not_move_documents_more_than_needed(spark):
    """With broadcasting off the text moves once; joins are on counts and vectors."""
    toks = explode_tokens(by_doc(docs(spark)), T.tokens_word("text"))
    vec = materialize(spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "word string, embedding array<float>"), "v3")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan(pooling.pool(pooling.lookup_vectors(term_counts(toks), vec), "mean"))
        assert _exchanges_of_documents(p) <= 2 and p.count("SortMergeJoin") <= 1
        lexicon = materialize(spark.createDataFrame([("a", "DT")], "word string, tag string"), "lex")
        from wordloom.operators.annotate import pos_tag
        assert "BroadcastHashJoin" not in plan(pos_tag(toks, lexicon))
        cvec = materialize(spark.createDataFrame([(o, w, [1.0]) for o in (-1, 1) for w in "abcdef"],
                                                 "offset int, word string, embedding array<float>"), "cv3")
        words = explode_tokens(by_doc(docs(spark)), T.tokens_ws("text"))
        p = plan(context.context_doc_vectors(words, cvec, 2, "mean"))
        assert "BroadcastHashJoin" not in p and "collect_list" not in p
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
