from pyspark.sql import functions as F

from wordloom.functions import tokens as T
from wordloom.operators.annotate import number_variants


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "text string").select(col.alias("x")).first()[0]


def test_treebank_example(spark):
    text = 'He said, "I don\'t know" (maybe)... it\'s 3,000. End!'
    out = one(spark, T.treebank_text("text"), text)
    assert out == "he said , `` i do n't know '' ( maybe ) ... it 's 3,000 . end !"


def test_word_tokens_are_unicode(spark):
    assert one(spark, T.tokens_word("text"), "Über café_1 naïve!") == ["Über", "café_1", "naïve"]


def test_count_vectoriser_drops_one_letter_words(spark):
    # trap 17: treebank output goes through the two-letter rule again
    toks = one(spark, T.tokens_word2(T.treebank_text("text")), "I don't see a cat")
    assert toks == ["do", "see", "cat"]


def test_word_ngrams_guard_short_documents(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(T.word_ngrams("t", 1, 3)).collect()]
    assert got == [["a", "b", "a b"], []]


def test_char_wb_short_word_once(spark):
    # " a " has length 3: 2-grams " a", "a " and the whole padded word once
    assert sorted(one(spark, T.char_wb_ngrams(F.lit("a"), 2, 10), "x")) == sorted([" a", "a ", " a "])


def test_char_ngrams_cross_word_borders(spark):
    from wordloom.operators.vocab import char_ngram_tf
    df = spark.createDataFrame([(1, "ab  c"), (2, ""), (3, "😀é😀é")], "doc_id long, text string").select("doc_id", T.char_text("text").alias("text"))
    got = {(r.doc_id, r.term): r.tf for r in char_ngram_tf(df, 2, 3).collect()}
    assert got == {(1, "ab"): 1, (1, "b "): 1, (1, " c"): 1, (1, "ab "): 1, (1, "b c"): 1,
                   (3, "😀é"): 2, (3, "é😀"): 1, (3, "😀é😀"): 1, (3, "é😀é"): 1}


def test_alpha_flag(spark):
    df = spark.createDataFrame([("abc",), ("ab1",), ("é",), ("",)], "w string")
    assert [r[0] for r in df.select(T.alpha_flag("w")).collect()] == [True, False, True, False]


def test_number_word_variants_count(spark):
    # 22 number words give 6,420 distinct one-edit strings (the words included)
    v = number_variants(spark)
    assert v.count() == 6420
    assert v.filter(F.col("variant") == "twenty").count() == 1
    # trap 18: common short words are hits
    assert v.filter(F.col("variant").isin("on", "ne", "sex")).count() == 3


def test_stopwords(spark):
    out = one(spark, T.stopword_filter(T.tokens_ws(F.lower("text"))), "The cat and a dog")
    assert out == ["cat", "dog"]


def test_strip_id_suffix_every_occurrence(spark):
    assert one(spark, T.strip_id_suffix("text"), "a.txt.txt") == "a"


# One row per treebank rule, worked out by hand: (rule, text, tokens).
TREEBANK_GOLDEN = [
    ("opening quote at the start", '"one two', "`` one two"),
    ("opening quote after a blank or bracket", 'a "b c', "a `` b c"),
    ("colon or comma before no digit", "a:b,c 3,000", "a : b , c 3,000"),
    ("comma before a digit stays", "1,2:3", "1,2:3"),
    ("ellipsis", "wait...what", "wait ... what"),
    ("other punctuation", "a;b @c #d $5 6% &e", "a ; b @ c # d $ 5 6 % & e"),
    ("final full stop", "the end.", "the end ."),
    ("full stop inside a word stays", "e.g. this", "e.g . this"),
    ("question and exclamation marks", "who?me!", "who ? me !"),
    ("apostrophe at a word's end", "dogs' tails", "dogs ' tails"),
    ("brackets", "f(x)[y]{z}<w>", "f ( x ) [ y ] { z } < w >"),
    ("double dash", "one--two", "one -- two"),
    ("closing quote", 'say "hi" now', "say `` hi '' now"),
    ("possessive and short verbs", "it's i'm he'd ok", "it 's i 'm he 'd ok"),
    ("longer short verbs", "we'll they're i've don't go", "we 'll they 're i 've do n't go"),
    ("cannot", "i cannot go", "i can not go"),
    ("d'ye", "d'ye see", "d 'ye see"),
    ("gimme", "gimme that", "gim me that"),
    ("gonna", "it is gonna rain", "it is gon na rain"),
    ("gotta", "i gotta go", "i got ta go"),
    ("lemme", "lemme see", "lem me see"),
    ("more'n", "more'n enough", "more 'n enough"),
    ("wanna", "i wanna go", "i wan na go"),
    ("'tis", "so 'tis true", "so 't is true"),
    ("'twas", "so 'twas true", "so 't was true"),
    ("words that only contain them stay", "cannots regotta", "cannots regotta"),
]


def test_treebank_rules_one_by_one(spark):
    df = spark.createDataFrame([(t,) for _, t, _ in TREEBANK_GOLDEN], "text string")
    got = [r[0] for r in df.select(T.treebank_text("text")).collect()]
    assert got == [want for _, _, want in TREEBANK_GOLDEN]


def test_whitespace_is_unicode(spark):
    text = "a\u00a0b\u2003c\u3000d\x1ce\x85f\u2028g\x0bh"
    assert one(spark, T.tokens_ws("text"), text) == text.split()
    assert one(spark, T.normalize_text("text"), text) == " ".join(text.split())


def _every_rule(text, lower):
    """The treebank chain with every rule tried on every text."""
    t = F.lower(text) if lower else F.col(text)
    t = F.concat(F.trim(F.regexp_replace(t, T.SPACE + "+", " ")), F.lit(" "))
    for pattern, repl in T.TREEBANK_RULES:
        t = F.regexp_replace(t, pattern, T._java_repl(repl))
    return F.trim(F.regexp_replace(t, T.SPACE + "+", " "))


def test_treebank_rules_are_skipped_without_effect(spark):
    bits = ["Cannot", "CANİNOT", "d'ye", "gimme", "gonna", "Gotta", "lemme", "more'n", "wanna", "'tis", "'Twas so", "\"quoted\"", "a--b", "wait...",
            "x: y", "1,2", "end:", "end,", "it's", "we'll", "don't ", "a   b", "\t\ttab", "(x) [y] {z} <w>", "50% & #1; @me $3", "so?", "No!", "U.S. x",
            "dogs' tails", "", " ", ".", ":", " ", "\x1c\x1d \x1f", "cannot gonna."]
    rows = [(i, t) for i, t in enumerate([a + s + b for a in bits for b in bits for s in ("", " ")] + [None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for lower in (True, False):
        out = df.select("text", T.treebank_text("text", lower).alias("got"), _every_rule("text", lower).alias("want"))
        assert out.filter(~F.col("got").eqNullSafe(F.col("want"))).collect() == []


def test_treebank_rules_ask_for_their_literal_first(spark, capsys):
    """Two dozen patterns over every text took most of the time of all queries that read treebank text."""
    spark.range(1).select(F.col("id").cast("string").alias("text")).select(T.treebank_text("text")).explain()
    plan = capsys.readouterr().out
    for literal in ("cannot", "gonna", "more'n", "--"):
        assert f", {literal}) THEN regexp_replace(" in plan, literal
