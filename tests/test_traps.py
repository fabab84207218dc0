"""Remaining traps of the original scripts, each pinned by a test."""

from pyspark.sql import functions as F

from wordloom.functions import tokens as T
from wordloom.operators import annotate
from wordloom.operators.tokens import explode_tokens
from wordloom.schema import WORD_NGRAM_RANGES


def test_tri_to_five_is_one_to_eight():
    # trap 9: the feature group named "tri to five" uses n-grams 1..8
    assert WORD_NGRAM_RANGES["tri_to_five"] == (1, 8)


def test_spell_mask_after_lower_casing_masks_proper_nouns(spark):
    # trap 12: lower-casing precedes the check, so "Paris" is tested as "paris"
    docs = spark.createDataFrame([(1, "Paris is big, 42 cats.")], "doc_id long, text string")
    toks = explode_tokens(docs, T.tokens_treebank("text"))
    lex = spark.createDataFrame([("is",), ("big",), ("cats",)], "word string")
    out = annotate.rejoin(annotate.spell_mask(toks, lex)).first().text
    assert out == "abcdef is big , 42 cats ."


def test_prediction_label_file_has_honest_columns(spark, tmp_out):
    # trap 15: the original wrote truth under a prediction header; K4 names both columns
    from wordloom.sources.writers import write_prediction_label
    p = tmp_out("k4")
    write_prediction_label(spark.createDataFrame([("a", "b")], "prediction string, label string"), p)
    back = spark.read.option("header", True).csv(p)
    assert back.columns == ["prediction", "label"] and back.first().asDict() == {"prediction": "a", "label": "b"}


def test_mixed_representation_replaces_nouns_verbs_adjectives_numbers(spark):
    toks = spark.createDataFrame([(1, 0, "the"), (1, 1, "running"), (1, 2, "dogs"), (1, 3, "42"), (1, 4, "quickly")],
                                 "doc_id long, pos int, word string")
    lex = spark.createDataFrame([("the", "DT")], "word string, tag string")
    out = annotate.rejoin(annotate.mixed_representation(annotate.pos_tag(toks, lex))).first().text
    assert out == "the VBG NNS CD quickly"


def test_nnp_wins_over_num(spark):
    toks = spark.createDataFrame([(1, 0, "x"), (1, 1, "Two"), (1, 2, "two"), (1, 3, "one")],
                                 "doc_id long, pos int, word string")
    lex = spark.createDataFrame([("x", "DT"), ("one", "NNP")], "word string, tag string")
    tagged = annotate.number_tag(annotate.pos_tag(toks, lex), annotate.number_variants(spark))
    out = annotate.rejoin(annotate.tag_nnp_numbers(tagged)).first().text
    assert out == "x NNP NUM NNP"
