"""Token tables: one row per token occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.chunks import CHUNK, chunk_count, with_document


def by_doc(docs: DataFrame, key: str = "doc_id", bucketed: bool = False, text: str = "text") -> DataFrame:
    """Hash-partition documents by their id once, before tokens are exploded and grouped by document.

    Every later per-document step (term counts, pooling, contexts, re-joining
    tokens into text) then finds its input already clustered by ``key`` and
    adds no shuffle; a document never spans partitions.  The shuffle moves raw
    text, which is smaller than the token rows it saves moving.  For a corpus
    stored bucketed by ``key`` (``sources.write_bucketed_corpus``) say
    ``bucketed``: it is laid out that way already.  The number of partitions
    follows from the text, so that a task's tables stay small on any input.
    """
    if bucketed:
        return docs
    return docs.repartition(chunk_count(docs, text), key) if text in docs.columns else docs.repartition(key)


def explode_tokens(docs: DataFrame, tokens: Column, keep=("doc_id",),
                   pos_col: str = "pos", word_col: str = "word") -> DataFrame:
    """One row per token: ``keep`` columns, 0-based ``pos`` (int), ``word``; documents dealt into chunks keep theirs."""
    return docs.select(*[c for c in (CHUNK,) if c in docs.columns], *keep, F.posexplode(tokens).alias(pos_col, word_col))


def term_counts(tokens: DataFrame, doc: str = "doc_id", term: str = "word",
                count_col: str = "tf") -> DataFrame:
    """(doc, term, tf): occurrences per document and term, aggregated before any join."""
    return tokens.groupBy(*with_document(tokens, doc), term).agg(F.count(F.lit(1)).alias(count_col))
