"""Bindings of the driver's tables to the corpus model (FIXTURES.md §3-4).

Each fixture is a pure function of the driver tables, computed by Spark so
that its size grows with them.  Tables joined many times are materialised
in the shared scratch folder (``materialize``) so that joins see their real
size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.tokens import tokens_word, tokens_ws
from wordloom.operators.chunks import deal
from wordloom.operators.ranking import materialize, rank_by
from wordloom.operators.tokens import by_doc, explode_tokens
from wordloom.schema import CORPUS_LABELS
from wordloom.session import table

# Tags of the invented tag lexicon, chosen by rank % 8.
LEXICON_TAGS = ["DT", "IN", "NN", "VB", "JJ", "RB", "PRP", "CD"]
TAG_LEXICON_SIZE = 200
WORD_VECTOR_MIN_COUNT = 5
CONTEXT_GAP_MODULUS = 37


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def label_code(label_col="lang"):
    """Code of a corpus label = its position in CORPUS_LABELS (from 0)."""
    m = F.create_map(*[x for i, l in enumerate(CORPUS_LABELS) for x in (F.lit(l), F.lit(i))])
    return m[F.col(label_col) if isinstance(label_col, str) else label_col]


def split_of(id_col="doc_id"):
    """train (0-7), dev (8) or test (9) by id % 10."""
    r = F.col(id_col) % 10
    return F.when(r < 8, "train").when(r == 8, "dev").otherwise("test")


def _docs(docs: DataFrame, by_document: bool, chunks: int | None) -> DataFrame:
    d = docs.select("doc_id", "lang", "text")
    if chunks:
        return deal(d, "doc_id", chunks)
    return by_doc(d) if by_document else d


def tokens(docs: DataFrame, by_document: bool = True, chunks: int | None = None) -> DataFrame:
    """(doc_id, lang, pos, word): unicode word runs of lower(text).

    ``by_document`` hash-partitions documents first (for per-document steps);
    corpus-wide word counts do not need it and skip that shuffle.  With ``chunks``
    documents are dealt into so many (for lookups in large word tables).
    """
    return explode_tokens(_docs(docs, by_document, chunks), tokens_word(F.lower("text")), keep=("doc_id", "lang"))


def ws_tokens(docs: DataFrame, by_document: bool = True, chunks: int | None = None) -> DataFrame:
    """(doc_id, lang, pos, word): whitespace tokens, case kept."""
    return explode_tokens(_docs(docs, by_document, chunks), tokens_ws("text"), keep=("doc_id", "lang"))


def ranked_words(toks: DataFrame, min_count: int) -> DataFrame:
    """(word, count, rank) for words with count >= min_count, rank by (count desc, word)."""
    counts = toks.groupBy("word").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_count)
    return rank_by(counts, F.col("count").desc(), F.col("word").asc(), rank_col="rank")


def word_vectors(spark: SparkSession, sf_dir: str, toks: DataFrame | None = None) -> DataFrame:
    """(word, embedding): word of rank r gets the embedding with vec_id = r."""
    toks = toks if toks is not None else tokens(documents(spark, sf_dir), by_document=False)
    ranked = ranked_words(toks, WORD_VECTOR_MIN_COUNT)
    emb = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rank"), "embedding")
    return materialize(ranked.join(emb, "rank").select("word", "embedding"), "word_vectors")


def context_vectors(spark: SparkSession, sf_dir: str, w: int, toks: DataFrame | None = None) -> DataFrame:
    """(offset, word, embedding) for offsets -w/2..w/2 without 0 (position-specific vectors)."""
    toks = toks if toks is not None else ws_tokens(documents(spark, sf_dir), by_document=False)
    emb = table(spark, sf_dir, "embeddings")
    n = emb.select(F.count(F.lit(1))).scalar()
    ranked = ranked_words(toks, WORD_VECTOR_MIN_COUNT).filter(F.col("rank") < n)
    half = w // 2
    offsets = [o for o in range(-half, half + 1) if o != 0]
    # The offset list has w rows: bounded by construction.
    off = ranked.select("word", "rank", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"))
    off = off.filter(((F.col("rank") + F.col("offset")) % CONTEXT_GAP_MODULUS) != 0)
    off = off.withColumn("vec_id", F.pmod(F.col("rank") + F.col("offset"), n))
    dim = 64 // w
    out = off.join(emb.select("vec_id", "embedding"), "vec_id").select(
        F.col("offset").cast("int").alias("offset"), "word",
        F.slice("embedding", 1, dim).alias("embedding"))
    return materialize(out, f"context_vectors_w{w}")


def spelling_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word): distinct lower-cased word tokens of ``benchmark.text``."""
    bench = table(spark, sf_dir, "benchmark")
    return materialize(
        bench.select(F.explode(tokens_word(F.lower("text"))).alias("word")).distinct(), "spelling_lexicon")


def tag_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, tag): the 200 most frequent word tokens (case kept), tag by rank % 8."""
    docs = documents(spark, sf_dir)
    toks = docs.select(F.explode(tokens_word("text")).alias("word"))
    counts = toks.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    top = rank_by(counts.orderBy(F.col("count").desc(), "word").limit(TAG_LEXICON_SIZE), F.col("count").desc(), F.col("word").asc())
    tags = F.array(*[F.lit(t) for t in LEXICON_TAGS])
    return materialize(top.select("word", F.element_at(tags, (F.col("rank") % 8 + 1).cast("int")).alias("tag")),
                       "tag_lexicon")


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, label, prediction): a deterministic classifier output over documents."""
    labels = F.array(*[F.lit(l) for l in CORPUS_LABELS])
    other = F.element_at(labels, (F.col("doc_id") % 4 + 1).cast("int"))
    pred = F.when((F.col("doc_id") * 7919) % 10 < 7, F.col("lang")).otherwise(other)
    return docs.select("doc_id", F.col("lang").alias("label"), pred.alias("prediction"))


# The settings of the derived fold-metrics table.
CV_OPTIONS = ["mean", "sum"]
CV_SIZES = [100, 300]
CV_WINDOWS = [5, 9]
CV_CS = [1, 10]
CV_FOLDS = 5


def cv_metrics(docs: DataFrame) -> DataFrame:
    """(option, size, window, c, fold, score): per setting and fold (doc_id % 5), the accuracy
    of a setting-dependent deterministic classifier on that fold's documents."""
    grid = F.array(*[F.struct(F.lit(o).alias("option"), F.lit(s).alias("size"),
                              F.lit(w).alias("window"), F.lit(c).alias("c"))
                     for o in CV_OPTIONS for s in CV_SIZES for w in CV_WINDOWS for c in CV_CS])
    rows = docs.select("doc_id", "lang", F.explode(grid).alias("p")).select("doc_id", "lang", "p.*")
    key = (F.col("doc_id") * 7919 + F.col("size") * 7 + F.col("window") * 13 + F.col("c") * 3
           + F.length("option") * 5)
    labels = F.array(*[F.lit(l) for l in CORPUS_LABELS])
    pred = F.when(key % 10 < 7, F.col("lang")).otherwise(F.element_at(labels, (F.col("doc_id") % 4 + 1).cast("int")))
    hit = F.when(pred == F.col("lang"), 1.0).otherwise(0.0)
    return rows.groupBy("option", "size", "window", "c", (F.col("doc_id") % CV_FOLDS).cast("int").alias("fold")).agg(
        F.avg(hit).alias("score"))


def linear_weights(toks: DataFrame, top: int = 200) -> DataFrame:
    """(label_code, word, weight): integer weights for the ``top`` most frequent words."""
    counts = toks.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    ranked = rank_by(counts.orderBy(F.col("count").desc(), "word").limit(top), F.col("count").desc(), F.col("word").asc())
    codes = F.array(*[F.lit(i) for i in range(len(CORPUS_LABELS))])
    w = ranked.select("word", "rank", F.explode(codes).alias("label_code"))
    return w.select("label_code", "word", ((F.col("rank") * 31 + F.col("label_code") * 17) % 101 - 50).alias("weight"))
