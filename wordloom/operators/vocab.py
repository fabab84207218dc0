"""Vocabulary operators A1-A7, A15, A16, W3.

Everything is aggregated per (document, term) first; document frequency is
then ``count(*)`` over those rows, never ``count(distinct)`` over tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions import tokens as T
from wordloom.operators import grams
from wordloom.operators.chunks import attach, with_document
from wordloom.operators.ranking import materialize, rank_by, top_k
from wordloom.operators.tokens import by_doc, explode_tokens
from wordloom.schema import CHAR_NGRAM_RANGE, WORD_NGRAM_RANGES


def term_frequency(tokens: DataFrame, by=("lang",), term: str = "word") -> DataFrame:
    """A1: corpus count per term, per group ``by`` (empty = whole corpus)."""
    return tokens.groupBy(*by, term).agg(F.count(F.lit(1)).alias("count"))


def drop_singletons(tf: DataFrame, term: str = "word") -> DataFrame:
    """A2: (doc, term, tf) rows whose term occurs more than once in the corpus.

    Works on counts, so a word that is in every document joins once per document.
    """
    keep = tf.groupBy(term).agg(F.sum("tf").alias("n")).filter("n > 1").select(term)
    return tf.join(keep, term, "left_semi")


def dictionary(tf: DataFrame, term: str = "word", doc: str = "doc_id") -> DataFrame:
    """A3: distinct terms with an integer id by rank over (df desc, term)."""
    df = tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    return rank_by(df, F.col("df").desc(), F.col(term).asc(), rank_col="term_id")


def doc2bow(tf: DataFrame, dictionary_df: DataFrame, term: str = "word") -> DataFrame:
    """A4: (doc, term, tf) restricted to dictionary terms."""
    return tf.join(dictionary_df.select(term), term, "left_semi")


def distinct_terms_per_doc(tf: DataFrame, doc: str = "doc_id") -> DataFrame:
    """A5: number of distinct terms per document."""
    return tf.groupBy(doc).agg(F.count(F.lit(1)).alias("n_terms"))


def idf(tf: DataFrame, n_docs, term: str = "word") -> DataFrame:
    """(term, df, idf) with idf = log2(N / df).

    ``n_docs`` is a number or a one-value Column (e.g. ``docs.select(count).scalar()``).
    """
    n = n_docs if not isinstance(n_docs, (int, float)) else F.lit(n_docs)
    return (tf.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
              .withColumn("idf", F.log2(n.cast("double") / F.col("df"))))


def tfidf(tf: DataFrame, idf_df: DataFrame, doc: str = "doc_id", term: str = "word", chunks: int | None = None) -> DataFrame:
    """(doc, term, tfidf): tf × idf, zero weights dropped, L2-normalised per document.

    ``tf`` should be partitioned by ``doc`` (see ``by_doc``) so that the norm,
    a sum over each document, needs no shuffle.  A large ``idf_df`` is looked up
    by ``chunks`` of documents (``chunks.attach``).
    """
    w = (attach(tf, idf_df.select(term, "idf").filter(F.col("idf") != 0), doc, term, chunks=chunks)
         .withColumn("w", F.col("tf") * F.col("idf")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*with_document(w, doc))))
    return w.select(*with_document(w, doc), term, "tf", (F.col("w") / norm).alias("tfidf"))


def vocabulary_topk(term_tf: DataFrame, k: int, min_df: int = 1,
                    term: str = "term", doc: str = "doc_id") -> DataFrame:
    """Terms with df >= min_df, then the k of highest corpus count (ties by term).

    ``term_tf`` has a row per (document, term) with ``tf``, or one per term with ``count`` and ``df`` (``ngram_stats``).
    Returns (term, count, df, term_id) with term_id = rank from 0.
    """
    stats = term_tf if "df" in term_tf.columns else term_tf.groupBy(term).agg(F.sum("tf").alias("count"), F.count(F.lit(1)).alias("df"))
    stats = stats.filter(F.col("df") >= min_df)
    return top_k(stats, k, F.col("count").desc(), F.col(term).asc(), rank_col="term_id")


def ngram_counts(term_tf: DataFrame, vocabulary: DataFrame, term: str = "term") -> DataFrame:
    """A16 long form: (doc, term, tf, term_id) for vocabulary terms."""
    return term_tf.join(vocabulary.select(term, "term_id"), term)


def vocabulary_rank(counts: DataFrame, min_count: int, term: str = "word",
                    count_col: str = "count") -> DataFrame:
    """Terms with count >= min_count ranked by (count desc, term) from 0."""
    kept = counts.filter(F.col(count_col) >= min_count)
    return rank_by(kept, F.col(count_col).desc(), F.col(term).asc(), rank_col="rank")


def _only(grams: DataFrame, vocabulary: DataFrame | None) -> DataFrame:
    """The n-grams of ``vocabulary``, which its cap bounds; they are picked out before any are counted."""
    return grams if vocabulary is None else grams.join(F.broadcast(vocabulary.select("term")), "term", "left_semi")


def word_ngram_tf(docs: DataFrame, lo: int, hi: int, doc: str = "doc_id", text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """T7 counted: (doc, term, tf) for word n-grams lo..hi of the treebank-joined text, or those in a (capped) ``vocabulary``."""
    d = by_doc(docs, doc).select(doc, T.tokens_word2(T.treebank_text(text)).alias("toks"))
    grams = d.select(doc, F.explode(T.word_ngrams("toks", lo, hi)).alias("term"))
    return _only(grams, vocabulary).groupBy(doc, "term").agg(F.count(F.lit(1)).alias("tf"))


def char_ngram_tf(docs: DataFrame, lo: int, hi: int, doc: str = "doc_id", text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """T8 counted: (doc, term, tf) for character n-grams lo..hi across word borders.

    Windows of ``hi`` characters are counted first; the n-grams are prefixes of
    the distinct windows, weighted with their count.
    """
    long = docs.select(doc, F.explode(T.char_windows(text, hi)).alias("win")).groupBy(doc, "win").agg(F.count(F.lit(1)).alias("n"))
    grams = long.select(doc, "n", F.explode(F.array_compact(F.array(*[
        F.when(F.length("win") >= n, F.substring("win", 1, n)) for n in range(lo, hi + 1)]))).alias("term"))
    return _only(grams, vocabulary).groupBy(doc, "term").agg(F.sum("n").alias("tf"))


def char_wb_ngram_tf(docs: DataFrame, lo: int, hi: int, doc: str = "doc_id", text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """T9 counted: (doc, term, tf); n-grams are cut per distinct word of a document and weighted with its count."""
    words = explode_tokens(by_doc(docs, doc), T.tokens_ws(F.lower(T.treebank_text(text))), keep=(doc,))
    wtf = words.groupBy(doc, "word").agg(F.count(F.lit(1)).alias("wtf"))
    grams = wtf.select(doc, "wtf", F.explode(T.char_wb_ngrams("word", lo, hi)).alias("term"))
    return _only(grams, vocabulary).groupBy(doc, "term").agg(F.sum("wtf").alias("tf"))


def _cut(group: str, ngrams: tuple | None, text: str) -> tuple:
    """(text whose symbols make up one feature group's n-grams, lo, hi, words, in_words), on treebank-joined text."""
    t = T.treebank_text(text)
    if group == "char" and not ngrams:
        return T.char_text(t), *CHAR_NGRAM_RANGE, False, False
    if group == "char_wb" and not ngrams:
        words = F.array_join(T.tokens_ws(F.lower(t)), " ")
        return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" "))), *CHAR_NGRAM_RANGE, False, True
    return F.array_join(T.tokens_word2(t), " "), *(ngrams or WORD_NGRAM_RANGES[group]), True, False


def ngram_stats(docs: DataFrame, group: str, min_df: int, ngrams: tuple | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, count, df) of one feature group's n-grams in at least ``min_df`` documents, on treebank-joined text."""
    symbols, lo, hi, words, in_words = _cut(group, ngrams, text)
    return grams.ngram_stats(docs, symbols, lo, hi, min_df, words, in_words, doc)


def capped_counts(docs: DataFrame, group: str, min_df: int, k: int, ngrams: tuple | None = None, doc: str = "doc_id", text: str = "text",
                  seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(A15 vocabulary, A16 counts as (doc, ids, n)) of one feature group: the text is cut into symbols once for both.

    The vocabulary is that of all documents, or of those whose ids are in ``seen``; its n-grams only are counted.
    """
    symbols, lo, hi, words, in_words = _cut(group, ngrams, text)
    texts = grams.document_texts(docs, symbols, doc)
    known = texts if seen is None else texts.join(seen.select(doc), doc, "left_semi")
    voc = materialize(vocabulary_topk(grams.stats(known, lo, hi, min_df, words, in_words), k, min_df=min_df), "ngram-vocabulary")
    return voc, grams.vocabulary_counts(texts, voc, lo, hi, words, in_words, doc)


def ngram_tf(docs: DataFrame, group: str, doc: str = "doc_id", text: str = "text", vocabulary: DataFrame | None = None) -> DataFrame:
    """(doc, term, tf) of one feature group of the n-gram classifier, all on treebank-joined text."""
    if group == "char":
        chars = by_doc(docs, doc).select(doc, T.char_text(T.treebank_text(text)).alias("text"))
        return char_ngram_tf(chars, *CHAR_NGRAM_RANGE, doc=doc, vocabulary=vocabulary)
    if group == "char_wb":
        return char_wb_ngram_tf(docs, *CHAR_NGRAM_RANGE, doc=doc, text=text, vocabulary=vocabulary)
    return word_ngram_tf(docs, *WORD_NGRAM_RANGES[group], doc=doc, text=text, vocabulary=vocabulary)
