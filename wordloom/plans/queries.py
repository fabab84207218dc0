"""Registered queries: one per operator of the inventory, each with its SQL oracle.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables; the
oracle is DuckDB SQL over the same parquet files, or absent where the operator
is not expressible in SQL (model fitting).  Vector results come out in long
form ``(key, dim, value rounded to 4)``; doubles are rounded to 4 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import tokens as T
from wordloom.operators import annotate, context, evaluate, pooling, shaping, tagger, vocab
from wordloom.operators.chunks import chunk_count
from wordloom.operators.ranking import materialize
from wordloom.operators.tokens import by_doc, explode_tokens, term_counts
from wordloom.plans import fixtures as fx
from wordloom.plans.oracle import WORD_RE, WS_LIST, context_cte, explode_sql, tb_list, treebank_sql, with_sql
from wordloom.schema import CORPUS_LABELS, NGRAM_GROUP_CAPS, NGRAM_MIN_DF, NUMBER_WORDS, STOP_WORDS
from wordloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r4(c):
    """Round a double to 4 digits; ``-0.0`` becomes ``0.0``."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0))


def docs(spark, sf_dir):
    return fx.documents(spark, sf_dir)


# ---------------------------------------------------------------------------
# T: token rules
# ---------------------------------------------------------------------------

@register("t1_tokens_ws", with_sql([], explode_sql(WS_LIST, keep="doc_id")))
def t1_tokens_ws(spark, sf_dir):
    return explode_tokens(docs(spark, sf_dir), T.tokens_ws("text"))


@register("t2_tokens_word", with_sql([], explode_sql(f"regexp_extract_all(text, '{WORD_RE}')", keep="doc_id")))
def t2_tokens_word(spark, sf_dir):
    return explode_tokens(docs(spark, sf_dir), T.tokens_word("text"))


_T3_LIST = f"regexp_extract_all(lower({treebank_sql('text')}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


@register("t3_tokens_word2", with_sql([], explode_sql(_T3_LIST, keep="doc_id")))
def t3_tokens_word2(spark, sf_dir):
    """Count-vectoriser tokens of the treebank-joined text."""
    return explode_tokens(docs(spark, sf_dir), T.tokens_word2(T.treebank_text("text")))


@register("t4_tokens_treebank", with_sql([], explode_sql(tb_list("text"), keep="doc_id")))
def t4_tokens_treebank(spark, sf_dir):
    return explode_tokens(docs(spark, sf_dir), T.tokens_treebank("text"))


@register("t5_normalize_text", """
SELECT doc_id, replace(regexp_replace(trim(regexp_replace(lower(text), '""" + T.SPACE + """+', ' ', 'g')), '^"+|"+$', '', 'g'), '"', '''') AS text
FROM documents""")
def t5_normalize_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", T.normalize_text("text").alias("text"))


_STOP = str(STOP_WORDS)


@register("t6_stopword_filter", with_sql([], explode_sql(
    f"list_filter(list_filter(regexp_split_to_array(lower(text), '{T.SPACE}+'), lambda x: x <> ''), lambda x: NOT list_contains({_STOP}, x))",
    keep="doc_id")))
def t6_stopword_filter(spark, sf_dir):
    return explode_tokens(docs(spark, sf_dir), T.stopword_filter(T.tokens_ws(F.lower("text"))))


_T3_TOKS = f"""
SELECT doc_id, {_T3_LIST} AS t FROM documents"""

_WORD_NGRAMS_SQL = """
SELECT d.doc_id, array_to_string(d.t[r.i + 1 : r.i + n.n], ' ') AS term
FROM t3 d, unnest(range({lo}, {hi} + 1)) AS n(n), unnest(range(greatest(len(d.t) - n.n + 1, 0))) AS r(i)"""


def _ngram_sql(lo, hi):
    return _WORD_NGRAMS_SQL.format(lo=lo, hi=hi)


@register("t7_word_ngrams", with_sql(["t3", "grams"], """
SELECT term, count(*)::BIGINT AS count, count(DISTINCT doc_id)::BIGINT AS df FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 10""",
    extra={"t3": _T3_TOKS, "grams": _ngram_sql(1, 3)}))
def t7_word_ngrams(spark, sf_dir):
    """Word n-grams 1..3 with their corpus count and document frequency (df >= 10, the vectorisers' min_df)."""
    return vocab.ngram_stats(docs(spark, sf_dir), "uni_to_tri", NGRAM_MIN_DF)


_CHAR_SQL = """
SELECT doc_id, term FROM (
  SELECT doc_id, n.n, CASE WHEN length(win) >= n.n THEN left(win, n.n) END AS term
  FROM (SELECT doc_id, ch || coalesce(string_agg(ch, '') OVER (PARTITION BY doc_id ORDER BY pos
                                                   ROWS BETWEEN 1 FOLLOWING AND {follow} FOLLOWING), '') AS win
        FROM (SELECT d.doc_id, r.i AS pos, d.c[r.i + 1] AS ch
              FROM (SELECT doc_id, string_split(regexp_replace(lower({tb}), '{space}{{2,}}', ' ', 'g'), '') AS c FROM documents) d,
                   unnest(range(len(d.c))) AS r(i))) w,
       unnest(range({lo}, {hi} + 1)) AS n(n))
WHERE term IS NOT NULL"""


@register("t8_char_ngrams", with_sql(["grams"], """
SELECT term, count(*)::BIGINT AS count, count(DISTINCT doc_id)::BIGINT AS df FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 10""",
    extra={"grams": _CHAR_SQL.format(lo=2, hi=10, follow=9, tb=treebank_sql("text"), space=T.SPACE)}))
def t8_char_ngrams(spark, sf_dir):
    return vocab.ngram_stats(docs(spark, sf_dir), "char", NGRAM_MIN_DF)


_CHAR_WB_SQL = """
SELECT w.doc_id, substring(w.p, r.i + 1, n.n) AS term
FROM (SELECT doc_id, ' ' || x || ' ' AS p
      FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower({tb}), '{space}+'), lambda y: y <> '')) AS x FROM documents)) w,
     unnest(range(2, least(10, length(w.p)) + 1)) AS n(n), unnest(range(length(w.p) - n.n + 1)) AS r(i)"""


@register("t9_char_wb_ngrams", with_sql(["grams"], """
SELECT term, count(*)::BIGINT AS count, count(DISTINCT doc_id)::BIGINT AS df FROM grams GROUP BY term
HAVING count(DISTINCT doc_id) >= 10""",
    extra={"grams": _CHAR_WB_SQL.format(tb=treebank_sql("text"), space=T.SPACE)}))
def t9_char_wb_ngrams(spark, sf_dir):
    return vocab.ngram_stats(docs(spark, sf_dir), "char_wb", NGRAM_MIN_DF)


@register("t10_strip_id_suffix", """
SELECT doc_id, regexp_replace(doc_id::VARCHAR || '.txt' || source || '.txt', '\\.txt', '', 'g') AS id FROM documents""")
def t10_strip_id_suffix(spark, sf_dir):
    d = docs(spark, sf_dir)
    return d.select("doc_id", T.strip_id_suffix(F.concat(F.col("doc_id").cast("string"), F.lit(".txt"),
                                                         F.col("source"), F.lit(".txt"))).alias("id"))


@register("t11_alpha_flag", with_sql(["tb"], """
SELECT doc_id, count(*) FILTER (WHERE regexp_full_match(word, '\\p{L}+'))::BIGINT AS n_alpha, count(*)::BIGINT AS n_tokens
FROM tb GROUP BY doc_id""", extra={"tb": explode_sql(tb_list("text"), keep="doc_id")}))
def t11_alpha_flag(spark, sf_dir):
    t = explode_tokens(docs(spark, sf_dir), T.tokens_treebank("text"))
    return t.groupBy("doc_id").agg(F.sum(T.alpha_flag("word").cast("long")).alias("n_alpha"),
                                   F.count(F.lit(1)).alias("n_tokens"))


# ---------------------------------------------------------------------------
# Number words and their one-edit variants
# ---------------------------------------------------------------------------

_NUMBER_WORDS_SQL = str(NUMBER_WORDS)
_IS_VARIANT = (f"(regexp_full_match(word, '[a-z]+') AND "
               f"list_bool_or(list_transform({_NUMBER_WORDS_SQL}, lambda nw: damerau_levenshtein(word, nw) <= 1)))")


@register("t12_edit1_variants", with_sql(["ws_tokens"], f"""
SELECT word AS variant, count(*)::BIGINT AS n FROM ws_tokens WHERE {_IS_VARIANT} GROUP BY word"""))
def t12_edit1_variants(spark, sf_dir):
    """One-edit variants of the number words that occur in the corpus, with their counts."""
    variants = annotate.number_variants(spark)
    toks = fx.ws_tokens(docs(spark, sf_dir), by_document=False)
    counts = toks.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(variants), counts.word == variants.variant).select("variant", "n")


@register("j4_number_tag_lookup", with_sql(["ws_tokens"], f"""
SELECT doc_id, pos, word FROM ws_tokens WHERE {_IS_VARIANT}"""))
def j4_number_tag_lookup(spark, sf_dir):
    toks = fx.ws_tokens(docs(spark, sf_dir), by_document=False)
    return annotate.number_tag(toks, annotate.number_variants(spark)).filter("is_num").select("doc_id", "pos", "word")


# ---------------------------------------------------------------------------
# A: vocabulary, tf-idf
# ---------------------------------------------------------------------------

_LOWER_WS = explode_sql(f"list_filter(list_filter(regexp_split_to_array(lower(text), '{T.SPACE}+'), lambda x: x <> ''), lambda x: NOT list_contains({_STOP}, x))")


def _stop_tokens(spark, sf_dir):
    return explode_tokens(docs(spark, sf_dir).select("doc_id", "lang", "text"),
                          T.stopword_filter(T.tokens_ws(F.lower("text"))), keep=("doc_id", "lang"))


@register("a1_term_frequency", with_sql(["st"], """
SELECT lang, word, count(*)::BIGINT AS count FROM st GROUP BY lang, word""", extra={"st": _LOWER_WS}))
def a1_term_frequency(spark, sf_dir):
    return vocab.term_frequency(_stop_tokens(spark, sf_dir), by=("lang",))


@register("a2_drop_singletons", with_sql(["st"], """
SELECT doc_id, count(*)::BIGINT AS n_tokens FROM st
WHERE word IN (SELECT word FROM st GROUP BY word HAVING count(*) > 1) GROUP BY doc_id""", extra={"st": _LOWER_WS}))
def a2_drop_singletons(spark, sf_dir):
    kept = vocab.drop_singletons(term_counts(_stop_tokens(spark, sf_dir)))
    return kept.groupBy("doc_id").agg(F.sum("tf").alias("n_tokens"))


@register("a3_dictionary", with_sql(["tokens", "tf"], """
SELECT word, count(*)::BIGINT AS df, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS term_id
FROM tf GROUP BY word"""))
def a3_dictionary(spark, sf_dir):
    return vocab.dictionary(term_counts(fx.tokens(docs(spark, sf_dir))))


@register("a4_doc2bow", with_sql(["tokens", "tf"], """
SELECT doc_id, word, tf FROM tf
SEMI JOIN (SELECT DISTINCT word FROM tf WHERE doc_id % 10 < 8) USING (word) WHERE doc_id % 10 >= 8"""))
def a4_doc2bow(spark, sf_dir):
    """Development and test documents against the training dictionary: unknown words drop out."""
    tf = term_counts(fx.tokens(docs(spark, sf_dir)))
    train_dict = tf.filter(F.col("doc_id") % 10 < 8).select("word").distinct()
    return vocab.doc2bow(tf.filter(F.col("doc_id") % 10 >= 8), train_dict)


@register("a5_distinct_words_per_doc", with_sql(["tokens"], """
SELECT doc_id, count(DISTINCT word)::BIGINT AS n_terms FROM tokens GROUP BY doc_id"""))
def a5_distinct_words_per_doc(spark, sf_dir):
    return vocab.distinct_terms_per_doc(term_counts(fx.tokens(docs(spark, sf_dir))))


def _idf(spark, sf_dir, tf):
    n = docs(spark, sf_dir).select(F.count(F.lit(1))).scalar()
    return vocab.idf(tf, n)


def _chunk_counts(spark, sf_dir):
    """Term counts of documents dealt into chunks, for lookups in word tables that grow with the corpus."""
    d = docs(spark, sf_dir)
    return term_counts(fx.tokens(d, chunks=chunk_count(d)))


def _tfidf(spark, sf_dir, tf):
    return vocab.tfidf(tf, materialize(_idf(spark, sf_dir, tf), "idf"))


@register("a6_idf", with_sql(["tokens", "tf", "n_docs", "idf"], """
SELECT word, df::BIGINT AS df, round(idf, 4) + 0.0 AS idf FROM idf"""))
def a6_idf(spark, sf_dir):
    tf = term_counts(fx.tokens(docs(spark, sf_dir)))
    return _idf(spark, sf_dir, tf).select("word", "df", r4("idf").alias("idf"))


@register("a7_tfidf", with_sql(["tokens", "tf", "n_docs", "idf", "tfidf"], """
SELECT doc_id, word, round(tfidf, 4) + 0.0 AS tfidf FROM tfidf"""))
def a7_tfidf(spark, sf_dir):
    tf = _chunk_counts(spark, sf_dir)
    return _tfidf(spark, sf_dir, tf).select("doc_id", "word", r4("tfidf").alias("tfidf"))


def _topk_sql(k, grams, **extra):
    return with_sql([*extra, "grams"], f"""
SELECT term, count, df, term_id FROM (
  SELECT term, count(*)::BIGINT AS count, count(DISTINCT doc_id)::BIGINT AS df,
         row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS term_id
  FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 10)
WHERE term_id < {k}""", extra={**extra, "grams": grams})


def _topk(spark, sf_dir, group, k):
    return vocab.vocabulary_topk(vocab.ngram_stats(docs(spark, sf_dir), group, NGRAM_MIN_DF), k, min_df=NGRAM_MIN_DF)


def _ngram_counts(spark, sf_dir, group):
    voc, counts = vocab.capped_counts(docs(spark, sf_dir), group, NGRAM_MIN_DF, NGRAM_GROUP_CAPS[group])
    each = counts.select("doc_id", F.explode(F.arrays_zip(F.col("ids").alias("term_id"), F.col("n").alias("tf"))).alias("g"))
    each = each.select("doc_id", F.col("g.tf").alias("tf"), F.col("g.term_id").cast("long").alias("term_id"))
    return each.join(F.broadcast(voc.select("term", "term_id")), "term_id").select("term", "doc_id", "tf", "term_id")


@register("a15_vocabulary_top2000", _topk_sql(2000, _ngram_sql(1, 3), t3=_T3_TOKS))
def a15_vocabulary_top2000(spark, sf_dir):
    """A cap well below the number of terms."""
    return _topk(spark, sf_dir, "uni_to_tri", 2000)


@register("a15_vocabulary_1to8", _topk_sql(NGRAM_GROUP_CAPS["tri_to_five"], _ngram_sql(1, 8), t3=_T3_TOKS))
def a15_vocabulary_1to8(spark, sf_dir):
    return _topk(spark, sf_dir, "tri_to_five", NGRAM_GROUP_CAPS["tri_to_five"])


@register("a15_vocabulary_char", _topk_sql(NGRAM_GROUP_CAPS["char"], _CHAR_SQL.format(
    lo=2, hi=10, follow=9, tb=treebank_sql("text"), space=T.SPACE)))
def a15_vocabulary_char(spark, sf_dir):
    return _topk(spark, sf_dir, "char", NGRAM_GROUP_CAPS["char"])


@register("a15_vocabulary_char_wb", _topk_sql(NGRAM_GROUP_CAPS["char_wb"], _CHAR_WB_SQL.format(tb=treebank_sql("text"), space=T.SPACE)))
def a15_vocabulary_char_wb(spark, sf_dir):
    return _topk(spark, sf_dir, "char_wb", NGRAM_GROUP_CAPS["char_wb"])


@register("a15_vocabulary_topk", _topk_sql(NGRAM_GROUP_CAPS["uni_to_tri"], _ngram_sql(1, 3), t3=_T3_TOKS))
def a15_vocabulary_topk(spark, sf_dir):
    """Word n-grams 1..3, df >= 10, top 200,000 by corpus count (the 1..3 group's cap)."""
    return _topk(spark, sf_dir, "uni_to_tri", NGRAM_GROUP_CAPS["uni_to_tri"])


@register("a16_ngram_counts", with_sql(["t3", "grams", "vocab"], """
SELECT g.doc_id, g.term, count(*)::BIGINT AS tf, v.term_id FROM grams g JOIN vocab v USING (term)
GROUP BY g.doc_id, g.term, v.term_id""", extra={"t3": _T3_TOKS, "grams": _ngram_sql(1, 3), "vocab": """
SELECT term, term_id FROM (
  SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS term_id
  FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 10) WHERE term_id < 200000"""}))
def a16_ngram_counts(spark, sf_dir):
    return _ngram_counts(spark, sf_dir, "uni_to_tri")


@register("a16_ngram_counts_1to8", with_sql(["t3", "grams", "vocab"], """
SELECT g.doc_id, g.term, count(*)::BIGINT AS tf, v.term_id FROM grams g JOIN vocab v USING (term)
GROUP BY g.doc_id, g.term, v.term_id""", extra={"t3": _T3_TOKS, "grams": _ngram_sql(1, 8), "vocab": """
SELECT term, term_id FROM (
  SELECT term, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS term_id
  FROM grams GROUP BY term HAVING count(DISTINCT doc_id) >= 10) WHERE term_id < 300000"""}))
def a16_ngram_counts_1to8(spark, sf_dir):
    return _ngram_counts(spark, sf_dir, "tri_to_five")


@register("w3_vocabulary_rank", with_sql(["tokens"], """
SELECT word, count(*)::BIGINT AS count, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS rank
FROM tokens GROUP BY word HAVING count(*) >= 5"""))
def w3_vocabulary_rank(spark, sf_dir):
    toks = fx.tokens(docs(spark, sf_dir))
    counts = toks.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return vocab.vocabulary_rank(counts, 5)


# ---------------------------------------------------------------------------
# J, A8-A11: word-vector lookup and pooling
# ---------------------------------------------------------------------------

def _hits(spark, sf_dir):
    vectors = fx.word_vectors(spark, sf_dir)
    tf = _chunk_counts(spark, sf_dir)
    return tf, vectors


_POOL_SQL = """
SELECT t.doc_id, u.i::INT AS dim, round({agg}, 4) + 0.0 AS value
FROM tokens t JOIN word_vectors v USING (word), unnest(range(len(v.embedding))) AS u(i)
GROUP BY t.doc_id, u.i"""


@register("a8_pool_mean", with_sql(["tokens", "word_vectors"],
                                   _POOL_SQL.format(agg="avg(v.embedding[u.i + 1]::DOUBLE)")))
def a8_pool_mean(spark, sf_dir):
    tf, vectors = _hits(spark, sf_dir)
    return pooling.long_form(pooling.pool(pooling.lookup_vectors(tf, vectors), "mean"))


@register("a9_pool_sum", with_sql(["tokens", "word_vectors"],
                                  _POOL_SQL.format(agg="sum(v.embedding[u.i + 1]::DOUBLE)")))
def a9_pool_sum(spark, sf_dir):
    tf, vectors = _hits(spark, sf_dir)
    return pooling.long_form(pooling.pool(pooling.lookup_vectors(tf, vectors), "sum"))


@register("a10_pool_mean_std", with_sql(["tokens", "word_vectors"], """
SELECT t.doc_id, (u.i + k.k * len(v.embedding))::INT AS dim,
       round(CASE WHEN k.k = 0 THEN avg(v.embedding[u.i + 1]::DOUBLE)
                  ELSE stddev_pop(v.embedding[u.i + 1]::DOUBLE) END, 4) + 0.0 AS value
FROM tokens t JOIN word_vectors v USING (word), unnest(range(len(v.embedding))) AS u(i), unnest([0, 1]) AS k(k)
GROUP BY t.doc_id, u.i, k.k, len(v.embedding)"""))
def a10_pool_mean_std(spark, sf_dir):
    tf, vectors = _hits(spark, sf_dir)
    return pooling.long_form(pooling.pool(pooling.lookup_vectors(tf, vectors), "std"))


@register("a11_pool_tfidf", with_sql(["tokens", "tf", "n_docs", "idf", "tfidf", "word_vectors"], """
SELECT x.doc_id, u.i::INT AS dim, round(sum(x.tf * x.tfidf * x.embedding[u.i + 1]::DOUBLE) / sum(x.tf * x.tfidf), 4) + 0.0 AS value
FROM (SELECT t.doc_id, t.tf, t.tfidf, v.embedding FROM tfidf t JOIN word_vectors v USING (word) WHERE t.tfidf <> 0) x,
     unnest(range(len(x.embedding))) AS u(i)
GROUP BY x.doc_id, u.i"""))
def a11_pool_tfidf(spark, sf_dir):
    tf, vectors = _hits(spark, sf_dir)
    weights = _tfidf(spark, sf_dir, tf)
    return pooling.long_form(pooling.pool(pooling.lookup_vectors(weights, vectors), "tfidf"))


@register("j1_lookup_vectors", with_sql(["tokens", "tf", "word_vectors"], """
SELECT doc_id, word, tf FROM tf WHERE word IN (SELECT word FROM word_vectors)"""))
def j1_lookup_vectors(spark, sf_dir):
    tf, vectors = _hits(spark, sf_dir)
    return pooling.lookup_vectors(tf, vectors).select("doc_id", "word", "tf")


@register("j2_surviving_words", with_sql(["tokens", "word_vectors"], """
SELECT doc_id, count(*)::BIGINT AS n_tokens,
       count(*) FILTER (WHERE word IN (SELECT word FROM word_vectors))::BIGINT AS n_known,
       count(*) FILTER (WHERE word NOT IN (SELECT word FROM word_vectors))::BIGINT AS n_unknown,
       round(count(*) FILTER (WHERE word IN (SELECT word FROM word_vectors)) / count(*), 4) + 0.0 AS coverage
FROM tokens GROUP BY doc_id"""))
def j2_surviving_words(spark, sf_dir):
    tf, vectors = _hits(spark, sf_dir)
    s = pooling.surviving_words(tf, vectors)
    return s.select("doc_id", "n_tokens", "n_known", "n_unknown", r4("coverage").alias("coverage"))


@register("j6_weight_join", with_sql(["tokens", "tf", "n_docs", "idf", "tfidf"], """
SELECT tf.doc_id, tf.word, tf.tf, round(coalesce(t.tfidf, 0.0), 4) + 0.0 AS tfidf
FROM tf LEFT JOIN tfidf t USING (doc_id, word)"""))
def j6_weight_join(spark, sf_dir):
    tf = _chunk_counts(spark, sf_dir)
    weights = _tfidf(spark, sf_dir, tf)
    return pooling.weight_join(tf, weights).select("doc_id", "word", "tf", r4("tfidf").alias("tfidf"))


# ---------------------------------------------------------------------------
# contexts
# ---------------------------------------------------------------------------

def _ctx(spark, sf_dir, w):
    vectors, d = fx.context_vectors(spark, sf_dir, w), docs(spark, sf_dir)
    return fx.ws_tokens(d, chunks=chunk_count(d)), vectors


@register("w1_context_window", with_sql(["ws_tokens"], """
SELECT doc_id, pos, word, left_words AS "left", right_words AS "right" FROM (
  SELECT doc_id, pos, word,
         list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l,
         list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r,
         array_to_string(l, ' ') AS left_words, array_to_string(r, ' ') AS right_words
  FROM ws_tokens)
WHERE len(l) = 2 AND len(r) = 2"""))
def w1_context_window(spark, sf_dir):
    return context.context_window(fx.ws_tokens(docs(spark, sf_dir)), 4)


def _ctx_sql(w, body):
    return with_sql(["ws_tokens", "ctx", "hits", "valid"], body, extra={
        "ctx": context_cte(w),
        "hits": """
SELECT t.doc_id, t.pos - c."offset" AS center, c."offset", c.embedding
FROM ws_tokens t JOIN ctx c USING (word)""",
        "valid": f"""
SELECT doc_id, center FROM hits GROUP BY doc_id, center HAVING count(*) = {w}"""})


_PV_SQL = """
SELECT h.doc_id, h.center, (CASE WHEN h."offset" < 0 THEN 0 ELSE {d} END + u.i)::INT AS dim,
       avg(h.embedding[u.i + 1]::DOUBLE) AS v
FROM hits h JOIN valid USING (doc_id, center), unnest(range({d})) AS u(i)
GROUP BY 1, 2, 3"""


@register("j5_lookup_context_vectors", _ctx_sql(4, """
SELECT doc_id, count(*)::BIGINT AS n_positions FROM valid GROUP BY doc_id"""))
def j5_lookup_context_vectors(spark, sf_dir):
    toks, vectors = _ctx(spark, sf_dir, 4)
    return context.valid_positions(toks, vectors, 4)


@register("a12_context_vectors", _ctx_sql(10, f"""
SELECT doc_id, center, dim, round(v, 4) + 0.0 AS value FROM ({_PV_SQL.format(d=6)})"""))
def a12_context_vectors(spark, sf_dir):
    toks, vectors = _ctx(spark, sf_dir, 10)
    pv = context.position_vectors(toks, vectors, 10)
    return pv.select("doc_id", "center", F.posexplode("features").alias("dim", "value")).select(
        "doc_id", "center", F.col("dim").cast("int").alias("dim"), r4("value").alias("value"))


def _doc_ctx_sql(w, agg):
    d = 64 // w
    return _ctx_sql(w, f"""
SELECT pv.doc_id, pv.dim, round({agg}(pv.v), 4) + 0.0 AS value
FROM ({_PV_SQL.format(d=d)}) pv
WHERE pv.doc_id IN (SELECT doc_id FROM valid GROUP BY doc_id HAVING count(*) > 1)
GROUP BY pv.doc_id, pv.dim""")


@register("a13_context_doc_sum", _doc_ctx_sql(4, "sum"))
def a13_context_doc_sum(spark, sf_dir):
    toks, vectors = _ctx(spark, sf_dir, 4)
    return pooling.long_form(context.context_doc_vectors(toks, vectors, 4, "sum"))


@register("a13_context_doc_sum_w10", _doc_ctx_sql(10, "sum"))
def a13_context_doc_sum_w10(spark, sf_dir):
    toks, vectors = _ctx(spark, sf_dir, 10)
    return pooling.long_form(context.context_doc_vectors(toks, vectors, 10, "sum"))


@register("a14_context_doc_mean_w4", _doc_ctx_sql(4, "avg"))
def a14_context_doc_mean_w4(spark, sf_dir):
    toks, vectors = _ctx(spark, sf_dir, 4)
    return pooling.long_form(context.context_doc_vectors(toks, vectors, 4, "mean"))


@register("a14_context_doc_mean", _doc_ctx_sql(10, "avg"))
def a14_context_doc_mean(spark, sf_dir):
    toks, vectors = _ctx(spark, sf_dir, 10)
    return pooling.long_form(context.context_doc_vectors(toks, vectors, 10, "mean"))


# ---------------------------------------------------------------------------
# Annotation and rewriting
# ---------------------------------------------------------------------------

_TB_LOWER = explode_sql(tb_list("text"), keep="doc_id")


@register("j3_spell_mask", with_sql(["lex", "tb"], """
SELECT doc_id, string_agg(CASE WHEN regexp_full_match(word, '\\p{L}+') AND word NOT IN (SELECT word FROM lex)
                               THEN 'abcdef' ELSE word END, ' ' ORDER BY pos) AS text
FROM tb GROUP BY doc_id""", extra={"lex": """
SELECT DISTINCT unnest(regexp_extract_all(lower(text), '""" + WORD_RE + """')) AS word FROM benchmark""", "tb": _TB_LOWER}))
def j3_spell_mask(spark, sf_dir):
    toks = explode_tokens(by_doc(docs(spark, sf_dir)), T.tokens_treebank("text"))
    masked = annotate.spell_mask(toks, fx.spelling_lexicon(spark, sf_dir))
    return annotate.rejoin(masked)


_RULE_TAG_SQL = """
coalesce(l.tag, CASE WHEN regexp_full_match(t.word, '[0-9]+') THEN 'CD'
                     WHEN regexp_matches(t.word, '^\\p{Lu}') AND t.pos > 0 THEN 'NNP'
                     WHEN suffix(t.word, 'ing') THEN 'VBG'
                     WHEN suffix(t.word, 'ed') THEN 'VBD'
                     WHEN suffix(t.word, 'ly') THEN 'RB'
                     WHEN suffix(t.word, 's') THEN 'NNS'
                     WHEN regexp_full_match(t.word, '[^\\p{L}\\p{N}_]') THEN t.word
                     ELSE 'NN' END)"""


@register("j8_pos_tag", with_sql(["tag_lexicon", "wt"], f"""
SELECT {_RULE_TAG_SQL} AS tag, count(*)::BIGINT AS n
FROM wt t LEFT JOIN tag_lexicon l USING (word) GROUP BY 1""",
    extra={"wt": explode_sql(f"regexp_extract_all(text, '{WORD_RE}')", keep="doc_id")}))
def j8_pos_tag(spark, sf_dir):
    toks = explode_tokens(docs(spark, sf_dir), T.tokens_word("text"))
    tagged = annotate.pos_tag(toks, fx.tag_lexicon(spark, sf_dir))
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def _tagged_tb(spark, sf_dir):
    toks = explode_tokens(by_doc(docs(spark, sf_dir)), T.tokens_treebank("text"))
    return annotate.pos_tag(toks, fx.tag_lexicon(spark, sf_dir))


@register("j8_tag_transitions", with_sql(["tag_lexicon", "tb"], f"""
SELECT previous, tag, count(*)::BIGINT AS n FROM (
  SELECT tag, coalesce(lag(tag) OVER (PARTITION BY doc_id, sentence ORDER BY pos), '') AS previous FROM (
    SELECT doc_id, pos, tag, coalesce(sum(CASE WHEN regexp_matches(word, '[.!?]$') THEN 1 ELSE 0 END) OVER (
             PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence
    FROM (SELECT t.doc_id, t.pos, t.word, {_RULE_TAG_SQL} AS tag FROM tb t LEFT JOIN tag_lexicon l USING (word))))
GROUP BY 1, 2""", extra={"tb": _TB_LOWER}))
def j8_tag_transitions(spark, sf_dir):
    """How often a tag follows another within a sentence: the counts that the sequence tagger learns from."""
    return tagger.transitions(_tagged_tb(spark, sf_dir))


@register("j8_sequence_tags")
def j8_sequence_tags(spark, sf_dir):
    """Tokens of all documents with the tags of the sequence tagger, fitted on the lexicon's and rules' tags of the training documents."""
    rows = materialize(_tagged_tb(spark, sf_dir), "tagged")
    train = docs(spark, sf_dir).filter(fx.split_of("doc_id") == "train").select("doc_id")
    return tagger.tag(rows.drop("tag"), tagger.fit(rows.join(train, "doc_id", "left_semi")))


def _rewrite_sql(word_expr):
    return with_sql(["tag_lexicon", "tb"], f"""
SELECT doc_id, string_agg({word_expr}, ' ' ORDER BY pos) AS text FROM (
  SELECT t.doc_id, t.pos, t.word, {_RULE_TAG_SQL} AS tag FROM tb t LEFT JOIN tag_lexicon l USING (word))
GROUP BY doc_id""", extra={"tb": _TB_LOWER})


@register("p1_mixed_representation", _rewrite_sql(
    "CASE WHEN regexp_matches(tag, '^(NN|VB|JJ|CD)') THEN tag ELSE word END"))
def p1_mixed_representation(spark, sf_dir):
    return annotate.rejoin(annotate.mixed_representation(_tagged_tb(spark, sf_dir)))


@register("p2_mixed_representation_coarse", _rewrite_sql("""CASE
  WHEN starts_with(tag, 'NN') OR starts_with(tag, 'PRP') OR starts_with(tag, 'VB') OR starts_with(tag, 'LS')
    OR starts_with(tag, 'SYM') OR starts_with(tag, 'CD') THEN 'othertag'
  WHEN starts_with(tag, ',') THEN 'comma'
  WHEN starts_with(tag, '?') OR starts_with(tag, '!') OR starts_with(tag, ':') OR starts_with(tag, ';') THEN 'puncttag'
  WHEN starts_with(tag, '"') OR starts_with(tag, '''') OR starts_with(tag, 'JJ') OR starts_with(tag, 'RB') THEN 'othertag'
  ELSE word END"""))
def p2_mixed_representation_coarse(spark, sf_dir):
    return annotate.rejoin(annotate.mixed_representation_coarse(_tagged_tb(spark, sf_dir)))


@register("p3_pos_sequence", _rewrite_sql("CASE WHEN tag = ',' THEN 'COMMA' ELSE tag END"))
def p3_pos_sequence(spark, sf_dir):
    return annotate.rejoin(annotate.pos_sequence(_tagged_tb(spark, sf_dir)))


@register("p4_tag_nnp_numbers", with_sql(["tag_lexicon", "ws_tokens"], f"""
SELECT doc_id, string_agg(CASE WHEN tag = 'NNP' THEN 'NNP' WHEN {_IS_VARIANT} THEN 'NUM' ELSE word END, ' ' ORDER BY pos) AS text
FROM (SELECT t.doc_id, t.pos, t.word, {_RULE_TAG_SQL} AS tag FROM ws_tokens t LEFT JOIN tag_lexicon l USING (word))
GROUP BY doc_id"""))
def p4_tag_nnp_numbers(spark, sf_dir):
    toks = fx.ws_tokens(docs(spark, sf_dir)).drop("lang")
    tagged = annotate.pos_tag(toks, fx.tag_lexicon(spark, sf_dir))
    numbered = annotate.number_tag(tagged, annotate.number_variants(spark))
    return annotate.rejoin(annotate.tag_nnp_numbers(numbered))


# ---------------------------------------------------------------------------
# R: corpus shaping
# ---------------------------------------------------------------------------

def _corpus(spark, sf_dir):
    """The driver's documents as a corpus (id, prompt, label, text)."""
    return docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("prompt"),
                                      F.col("lang").alias("label"), "text", "doc_id")


@register("r1_flatten_by_label", """
SELECT lang AS label, doc_id::VARCHAR AS id, text FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, doc_id ORDER BY source DESC) AS rn FROM documents) WHERE rn = 1""")
def r1_flatten_by_label(spark, sf_dir):
    return shaping.flatten_by_label(_corpus(spark, sf_dir))


@register("r2_count_by_label", "SELECT lang AS label, count(*)::BIGINT AS n FROM documents GROUP BY lang")
def r2_count_by_label(spark, sf_dir):
    return shaping.count_by_label(_corpus(spark, sf_dir))


@register("r3_count_by_label_prompt",
          "SELECT lang AS label, source AS prompt, count(*)::BIGINT AS n FROM documents GROUP BY lang, source")
def r3_count_by_label_prompt(spark, sf_dir):
    return shaping.count_by_label_prompt(_corpus(spark, sf_dir))


@register("r4_dedup_key", """
SELECT label, prompt, id FROM (
  SELECT lang AS label, source AS prompt, md5(text) AS id,
         row_number() OVER (PARTITION BY lang, source, md5(text) ORDER BY doc_id DESC) AS rn FROM documents)
WHERE rn = 1""")
def r4_dedup_key(spark, sf_dir):
    """Key (label, prompt, id) with id = md5 of the text, so exact copies share a key;
    the last line (highest doc_id) wins."""
    c = _corpus(spark, sf_dir).withColumn("id", F.md5("text")).withColumn("line", F.col("doc_id"))
    return shaping.dedup_key(c).select("label", "prompt", "id")


@register("r5_encode_label", """
SELECT doc_id, lang AS label, (list_position(['de', 'en', 'es', 'fr'], lang) - 1)::INT AS label_code FROM documents""")
def r5_encode_label(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label"))
    return shaping.encode_label(d, labels=CORPUS_LABELS)


@register("r6_union_corpora", """
SELECT split, lang AS label, count(*)::BIGINT AS n FROM (
  SELECT 'train' AS split, lang FROM documents WHERE doc_id % 10 < 8
  UNION ALL SELECT 'test' AS split, lang FROM documents WHERE doc_id % 10 >= 8) GROUP BY 1, 2""")
def r6_union_corpora(spark, sf_dir):
    d = _corpus(spark, sf_dir)
    u = shaping.union_corpora(d.filter(F.col("doc_id") % 10 < 8), d.filter(F.col("doc_id") % 10 >= 8))
    return u.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@register("r7_split_slices", "SELECT doc_id::VARCHAR AS id, lang AS label FROM documents WHERE doc_id % 10 >= 8")
def r7_split_slices(spark, sf_dir):
    d = _corpus(spark, sf_dir)
    u = shaping.union_corpora(d.filter(F.col("doc_id") % 10 < 8), d.filter(F.col("doc_id") % 10 >= 8))
    return shaping.split_slices(u, "test").select("id", "label")


@register("r8_order_by_label", """
SELECT (list_position(['de', 'en', 'es', 'fr'], lang) - 1)::INT AS label_code, doc_id FROM documents""")
def r8_order_by_label(spark, sf_dir):
    d = shaping.encode_label(docs(spark, sf_dir).select("doc_id", F.col("lang").alias("label")), labels=CORPUS_LABELS)
    return shaping.order_by_label(d, key="doc_id").select("label_code", "doc_id")


# ---------------------------------------------------------------------------
# E, W2, J7, M13, A17: evaluation and scoring
# ---------------------------------------------------------------------------

@register("e4_confusion_counts", with_sql(["predictions"], """
SELECT label, prediction, count(*)::BIGINT AS n FROM predictions GROUP BY 1, 2"""))
def e4_confusion_counts(spark, sf_dir):
    return evaluate.confusion_counts(fx.predictions(docs(spark, sf_dir)))


@register("e1_accuracy", with_sql(["predictions"], """
SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'dev' ELSE 'test' END AS split,
       count(*)::BIGINT AS n, round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 4) + 0.0 AS accuracy
FROM predictions GROUP BY 1"""))
def e1_accuracy(spark, sf_dir):
    p = fx.predictions(docs(spark, sf_dir)).withColumn("split", fx.split_of())
    return evaluate.accuracy(p, by=("split",)).select("split", "n", r4("accuracy").alias("accuracy"))


_REPORT_SQL = """
SELECT c.cls AS label,
       coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
       coalesce(tp / nullif(support, 0), 0.0) AS recall,
       support
FROM (SELECT cls, sum(s)::BIGINT AS support, sum(p)::BIGINT AS predicted, sum(t)::BIGINT AS tp FROM (
        SELECT label AS cls, 1 AS s, 0 AS p, CASE WHEN label = prediction THEN 1 ELSE 0 END AS t FROM predictions
        UNION ALL SELECT prediction, 0, 1, 0 FROM predictions) GROUP BY cls) c"""


@register("e3_classification_report", with_sql(["predictions", "rep"], """
SELECT label, round(precision, 4) + 0.0 AS precision, round(recall, 4) + 0.0 AS recall,
       round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0), 4) + 0.0 AS f1, support
FROM rep""", extra={"rep": _REPORT_SQL}))
def e3_classification_report(spark, sf_dir):
    rep = evaluate.classification_report(fx.predictions(docs(spark, sf_dir)))
    return rep.select("label", *[r4(c).alias(c) for c in ("precision", "recall", "f1")], "support")


@register("e3_report_averages", with_sql(["predictions", "rep"], """
SELECT round(avg(precision), 4) + 0.0 AS macro_precision, round(avg(recall), 4) + 0.0 AS macro_recall,
       round(avg(f1), 4) + 0.0 AS macro_f1,
       round(sum(precision * support) / sum(support), 4) + 0.0 AS weighted_precision,
       round(sum(recall * support) / sum(support), 4) + 0.0 AS weighted_recall,
       round(sum(f1 * support) / sum(support), 4) + 0.0 AS weighted_f1, sum(support)::BIGINT AS support
FROM (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM rep)""",
    extra={"rep": _REPORT_SQL}))
def e3_report_averages(spark, sf_dir):
    avg = evaluate.report_averages(evaluate.classification_report(fx.predictions(docs(spark, sf_dir))))
    cols = ["macro_precision", "macro_recall", "macro_f1", "weighted_precision", "weighted_recall", "weighted_f1"]
    return avg.select(*[r4(c).alias(c) for c in cols], F.col("support").cast("long").alias("support"))


@register("e2_macro_f1", with_sql(["predictions", "rep"], """
SELECT round(avg(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0)), 4) + 0.0 AS macro_f1,
       count(*)::BIGINT AS n_classes FROM rep""", extra={"rep": _REPORT_SQL}))
def e2_macro_f1(spark, sf_dir):
    m = evaluate.macro_f1(fx.predictions(docs(spark, sf_dir)))
    return m.select(r4("macro_f1").alias("macro_f1"), "n_classes")


@register("e5_cv_score_table", with_sql(["cv_metrics"], """
SELECT option, size, "window", c, round(avg(score), 4) + 0.0 AS mean_score,
       round(stddev_pop(score), 4) + 0.0 AS std_score, count(*)::BIGINT AS n_folds
FROM cv_metrics GROUP BY 1, 2, 3, 4"""))
def e5_cv_score_table(spark, sf_dir):
    t = evaluate.cv_score_table(fx.cv_metrics(docs(spark, sf_dir)))
    return t.select("option", "size", "window", "c", r4("mean_score").alias("mean_score"),
                    r4("std_score").alias("std_score"), "n_folds")


@register("w2_best_parameters", with_sql(["cv_metrics"], """
SELECT option, size, "window", c, round(mean_score, 4) + 0.0 AS mean_score FROM (
  SELECT *, row_number() OVER (PARTITION BY option, size, "window" ORDER BY mean_score DESC, c) AS rn
  FROM (SELECT option, size, "window", c, avg(score) AS mean_score FROM cv_metrics GROUP BY 1, 2, 3, 4))
WHERE rn = 1"""))
def w2_best_parameters(spark, sf_dir):
    t = evaluate.cv_score_table(fx.cv_metrics(docs(spark, sf_dir)))
    b = evaluate.best_parameters(t)
    return b.select("option", "size", "window", "c", r4("mean_score").alias("mean_score"))


@register("j7_label_prediction_join", with_sql(["predictions"], """
SELECT doc_id, label, prediction FROM predictions"""))
def j7_label_prediction_join(spark, sf_dir):
    p = fx.predictions(docs(spark, sf_dir))
    return evaluate.label_prediction_join(p.select("doc_id", "label"), p.select("doc_id", "prediction"))


@register("m13_score_linear", with_sql(["tokens", "tf", "weights"], """
SELECT doc_id, label_code AS prediction, score FROM (
  SELECT doc_id, label_code, score,
         row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label_code) AS rn
  FROM (SELECT tf.doc_id, w.label_code, sum(tf.tf * w.weight)::BIGINT AS score
        FROM tf JOIN weights w USING (word) GROUP BY 1, 2))
WHERE rn = 1""", extra={"weights": """
SELECT l.code::INT AS label_code, r.word, ((r.rk * 31 + l.code * 17) % 101 - 50)::INT AS weight
FROM (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS rk FROM tokens GROUP BY word) r,
     unnest([0, 1, 2, 3]) AS l(code)
WHERE r.rk < 200"""}))
def m13_score_linear(spark, sf_dir):
    toks = fx.tokens(docs(spark, sf_dir))
    weights = fx.linear_weights(toks)
    s = evaluate.score_linear(term_counts(toks), F.broadcast(weights))
    return s.select("doc_id", F.col("prediction").cast("int").alias("prediction"), F.col("score").cast("long").alias("score"))


def all_queries():
    from wordloom.plans import queries_io, queries_ml  # noqa: F401  (registers the rest)
    return dict(QUERIES)


def all_oracles():
    from wordloom.plans import queries_io, queries_ml  # noqa: F401
    return dict(ORACLE)
