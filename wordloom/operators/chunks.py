"""Lookups by word for rows that stay with their document.

A plain join of (document, word) rows with a large word table moves every row to
its word, with what it finds there back to its document.  Here documents are dealt
into chunks of bounded size; each chunk asks once for every distinct word that it
holds, and the answers meet its rows inside the chunk.  So a word's entry moves once
per chunk, not once per row, and later steps by (``CHUNK``, document) need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "__chunk"
TEXT_BYTES = 4 << 20    # text of one chunk, on average
ROWS = 1 << 19          # rows of one chunk, where only rows can be counted
SMALL = 4096            # entries of a table that is joined plainly, so that the planner may broadcast it


def chunk_count(docs: DataFrame, text: str = "text") -> int:
    """Chunks for ``docs``: as many as their text fills, at least one per core."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_BYTES))


def deal(rows: DataFrame, doc: str, chunks: int | None = None) -> DataFrame:
    """``rows`` with ``CHUNK``, a hash of the document, and partitioned by it."""
    if CHUNK in rows.columns:
        return rows
    if chunks is None:
        chunks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))
    chunk = F.pmod(F.xxhash64(doc), F.lit(chunks)).cast("int").alias(CHUNK, metadata={"chunks": chunks})
    return rows.select("*", chunk).repartition(chunks, CHUNK)


def attach(rows: DataFrame, values: DataFrame, doc: str, term: str, how: str = "inner", chunks: int | None = None,
           small: int | None = None) -> DataFrame:
    """``rows`` joined with ``values`` on ``term`` (``inner`` or ``left``).

    ``values`` of up to ``small`` (else ``SMALL``) entries are joined plainly; otherwise the result carries ``CHUNK`` and is partitioned by it.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unknown join {how!r}")
    small = SMALL if small is None else small
    if small and values.count() <= small:
        return rows.join(values, term, how)
    columns = [c for c in values.columns if c != term]
    dealt = deal(rows if how == "left" else rows.filter(F.col(term).isNotNull()), doc, chunks)
    parts = dealt.columns
    entries = values.filter(F.col(term).isNotNull()).groupBy(term).agg(F.collect_list(F.struct(*columns)).alias("__found"))
    told = dealt.select(CHUNK, term).distinct().join(entries, term).repartition(dealt.schema[CHUNK].metadata["chunks"], CHUNK)
    both = dealt.withColumn("__row", F.lit(True)).unionByName(told, allowMissingColumns=True)
    found = F.first("__found", ignorenulls=True).over(Window.partitionBy(CHUNK, term))
    out = both.withColumn("__found", found).filter("__row")
    explode = F.inline if how == "inner" else F.inline_outer
    return out.select(*parts, explode("__found"))


def with_document(rows: DataFrame, *keys: str) -> list:
    """Columns to group ``rows`` by: ``keys``, after ``CHUNK`` where the rows have it."""
    return [c for c in (CHUNK,) if c in rows.columns] + list(keys)


def width(vectors: DataFrame, vec: str) -> int | None:
    """The length of all ``vec``, or None if they differ or hold nulls."""
    odd = F.col(vec).isNull() | F.exists(vec, lambda x: x.isNull())
    r = vectors.agg(F.min(F.size(vec)).alias("lo"), F.max(F.size(vec)).alias("hi"), F.max(odd.cast("int")).alias("odd")).first()
    return r["hi"] if r["lo"] == r["hi"] and r["odd"] == 0 else None
