"""Ranked lexical search: many queries at once, their common parts computed once.

1. Queries stream through the driver a block at a time (``BLOCK_ITEMS`` queries
   or ``BLOCK_BYTES`` of text).  Term sets that several queries of a block share
   are mined: the largest set common to two of them becomes a node of a graph and
   stands for its terms wherever they occur together, until no two queries or
   nodes share two parts.  A query is then a sum over a few nodes and terms.
2. One pass over the documents finds the block's terms in whole texts (packed
   words, compared exactly) and writes, per document, its length and the counts
   of those terms.  Document frequencies and lengths are summed from that.
3. Every task computes, for a slice of documents, one accumulator per term, adds
   them up along the graph, every shared node once, and keeps each query's best
   documents.  The best of all tasks are ranked.

A document's score for a query is the sum, over the query's terms, of
``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` with ``w = floor(1000 *
ln((2N + 2) / (2df + 1)))`` and ``m = 100 - 50 + ((50 * n * N) div L)``.

Defined cases: null and empty texts have no terms; documents without terms are in
no count.  Rows that share an item id are one query with the terms of all of
them; a null id is an id.  A query without terms, or whose terms no document
holds, returns no rows.  Repeated documents are documents each; equal scores are
ordered by doc_id (null first).  Columns other than those named are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import terms as P
from wordloom.llm.tables import small_table
from wordloom.operators.ranking import materialize

TOP = 50
BLOCK_ITEMS = 512
BLOCK_BYTES = 1 << 20
CELLS = 1 << 21         # accumulator cells (term or node x document) in a task at a time
SALTS = 32              # the best of tasks are ranked in so many groups first


class Vocabulary:
    """Numbers of the terms of a block of queries, found exactly among the terms of a text."""

    def __init__(self, terms: list[bytes]):
        self.terms = sorted(terms, key=lambda t: (len(t) > 8, len(t) > 16, t))
        lengths = np.array([len(t) for t in self.terms], np.int64)
        joined = b"".join(self.terms)
        low = np.concatenate([np.frombuffer(joined, np.uint8), np.zeros(P.PAD, np.uint8)])
        starts = np.cumsum(lengths) - lengths
        self.first = [0, int((lengths <= 8).sum()), int((lengths <= 16).sum())]
        one, two = slice(0, self.first[1]), slice(self.first[1], self.first[2])
        self.one = P.packed(low, starts[one], lengths[one])
        self.two = [P.packed(low, starts[two], lengths[two], at) for at in (0, 8)]
        self.head, self.head_at = np.unique(self.two[0], return_index=True)
        self.head_end = np.append(self.head_at[1:], len(self.two[0]))
        self.long = {t: i for i, t in enumerate(self.terms) if len(t) > 16}
        self.long_lengths = np.unique([len(t) for t in self.long]).astype(np.int64)

    def numbers(self, low, starts, ends) -> np.ndarray:
        """The number of every term of a text, -1 for terms that no query has."""
        lengths = ends - starts
        out = np.full(len(starts), -1, np.int32)
        of = np.flatnonzero(lengths <= 8)
        if len(self.one) and len(of):
            key = P.packed(low, starts[of], lengths[of])
            at = np.minimum(np.searchsorted(self.one, key), len(self.one) - 1)
            out[of] = np.where(self.one[at] == key, at, -1)
        of = np.flatnonzero((lengths > 8) & (lengths <= 16))
        if len(self.head) and len(of):
            key, tail = P.packed(low, starts[of], lengths[of]), P.packed(low, starts[of], lengths[of], 8)
            at = np.minimum(np.searchsorted(self.head, key), len(self.head) - 1)
            here = np.flatnonzero(self.head[at] == key)
            for step in range(int((self.head_end - self.head_at).max())):   # terms with the same first eight bytes
                place = self.head_at[at[here]] + step
                here, place = here[inside := place < self.head_end[at[here]]], place[inside]
                same = self.two[1][place] == tail[here]
                out[of[here[same]]] = self.first[1] + place[same]
        of = np.flatnonzero(lengths > 16)
        for i in of[np.isin(lengths[of], self.long_lengths)] if self.long else ():
            out[i] = self.long.get(low[starts[i]: ends[i]].tobytes(), -1)
        return out


def share_terms(queries: list[set[int]], n_terms: int) -> tuple[list[np.ndarray], list[int]]:
    """The query-sharing graph: (parts of every node, node of every query).

    Numbers below ``n_terms`` are terms, node k is ``n_terms + k``; nodes stand
    after their parts.  Every node is the disjoint sum of its parts, and a query's
    node sums up exactly its terms.
    """
    # terms that the same queries have are one set; it is the finest set worth an accumulator of its own
    users: dict[int, list[int]] = {}
    for q, own in enumerate(queries):
        for t in own:
            users.setdefault(t, []).append(q)
    together: dict[tuple, list[int]] = {}
    for t, of in users.items():
        together.setdefault(tuple(of), []).append(t)
    sets, rows = [], [0] * len(queries)        # rows: bit sets over the numbered parts
    for of, terms in together.items():
        for q in of:
            rows[q] |= 1 << len(sets)
        sets.append(("terms", sorted(terms)))
    n_queries, parts = len(queries), len(sets)
    best: dict[int, tuple[int, int]] = {}       # row -> (parts shared with its closest earlier row, that row)

    def closest(i: int) -> tuple[int, int]:
        row = rows[i]
        return max(((row & rows[j]).bit_count(), -j) for j in range(i)) if i else (0, 0)

    def refresh(i: int):
        best[i] = closest(i)

    for i in range(len(rows)):
        refresh(i)
    while best:
        i = max(best, key=lambda k: best[k])
        shared, j = best[i][0], -best[i][1]
        if shared < 2:
            break
        common = rows[i] & rows[j]
        node = parts + len(rows) - n_queries    # the part that stands for the new row
        changed = [k for k, row in enumerate(rows) if row & common == common]
        for k in changed:
            rows[k] = rows[k] & ~common | 1 << node
        rows.append(common)
        best[len(rows) - 1] = (0, 0)
        changed.append(len(rows) - 1)
        touched = set(changed)
        for k in range(len(rows)):
            if k in touched or -best[k][1] in touched:
                refresh(k)
            else:
                near = max(((rows[k] & rows[c]).bit_count(), -c) for c in changed if c < k) if any(c < k for c in changed) else (0, 0)
                best[k] = max(best[k], near)
    nodes, number = [], {}

    def build(part: int) -> int:
        """The number of a part's node (a single term needs none)."""
        todo = [part]
        while todo:
            p = todo[-1]
            if p in number:
                todo.pop()
                continue
            if p < parts:
                terms = sets[p][1]
                if len(terms) == 1:
                    number[p] = terms[0]
                else:
                    nodes.append(np.array(terms, np.int64))
                    number[p] = n_terms + len(nodes) - 1
            else:
                below = _bits(rows[n_queries + p - parts])
                missing = [b for b in below if b not in number]
                if missing:
                    todo += missing
                    continue
                nodes.append(np.array([number[b] for b in below], np.int64))
                number[p] = n_terms + len(nodes) - 1
            todo.pop()
        return number[part]

    ends = []
    for q in range(n_queries):
        below = [build(b) for b in _bits(rows[q])]
        if len(below) == 1:
            ends.append(below[0])
        elif below:
            nodes.append(np.array(below, np.int64))
            ends.append(n_terms + len(nodes) - 1)
        else:
            ends.append(-1)
    return nodes, ends


def _bits(x: int) -> list[int]:
    out = []
    while x:
        low = x & -x
        out.append(low.bit_length() - 1)
        x ^= low
    return out


def text_terms(texts) -> list[set[bytes]]:
    """The distinct terms of every text."""
    import pyarrow as pa
    data, offsets = P.buffer_of(pa.array(texts, pa.large_string()))
    low, starts, ends, text = P.runs(data, offsets, P.LETTERS_AND_DIGITS)
    out = [set() for _ in texts]
    whole = low.tobytes()
    for a, b, t in zip(starts.tolist(), ends.tolist(), text.tolist()):
        out[t].add(whole[a:b])
    return out


def query_blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of (id, set of terms), streamed in order of the id; rows with one id are one query."""
    src = items.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).orderBy("id")
    ids, found, size, none = [], [], 0, object()
    last = none
    for r in src.toLocalIterator():
        if last is none or r["id"] != last:
            if ids and (len(ids) >= BLOCK_ITEMS or size >= BLOCK_BYTES):
                yield ids, found
                ids, found, size = [], [], 0
            ids.append(r["id"])
            found.append(set())
            last = r["id"]
        text = r["text"] or ""
        size += len(text)
        found[-1] |= text_terms([text])[0]
    if ids:
        yield ids, found


def document_vectors(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts) of every document with a term: n terms in all, those of the vocabulary with their counts."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = src.sparkSession.sparkContext.broadcast(vocabulary)     # of one block of queries
    width = len(vocabulary.terms) + 1

    def lists(values, texts, n_texts):
        import pyarrow as pa
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(texts, np.arange(n_texts + 1)), pa.int32()), pa.array(values, pa.int32()))

    def run(batches):
        import pyarrow as pa
        vocabulary = shared.value
        for batch in batches:
            data, offsets = P.buffer_of(batch.column(1))
            for a, b in P.slices(offsets):
                low, starts, ends, text = P.runs(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], P.LETTERS_AND_DIGITS)
                n = np.bincount(text, minlength=b - a)
                number = vocabulary.numbers(low, starts, ends)
                known = number >= 0
                key, count = np.unique(text[known] * width + number[known], return_counts=True)
                own = key // width
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), lists(key % width, own, b - a), lists(count, own, b - a)],
                    ["doc_id", "n", "terms", "counts"])
                yield out.filter(pa.array(n > 0))

    return src.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<int>")


def contribution(tf: np.ndarray, m: np.ndarray, w: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


def document_weight(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """``m``: in 64-bit integers where they suffice, else in integers of any size."""
    if len(n) and 50 * int(n.max()) * documents >= 1 << 62:
        return np.array([50 + 50 * int(x) * documents // length for x in n], np.int64)
    return 50 + 50 * n * documents // max(length, 1)


def best_documents(vectors: DataFrame, queries: list, nodes: list, ends: list[int], weights: np.ndarray, documents: int,
                   length: int, top: int) -> DataFrame:
    """(query, doc_id, score): the ``top`` documents of every query in every task's share."""
    shared = vectors.sparkSession.sparkContext.broadcast((nodes, ends, weights, documents, length))    # one block of queries

    def run(batches):
        import pyarrow as pa
        nodes, ends, weights, documents, length = shared.value
        n_terms = len(weights)
        live = [q for q, end in enumerate(ends) if end >= 0]
        step = max(1, CELLS // max(1, n_terms + len(nodes)))
        held = {q: (np.empty(0, np.int64), None) for q in live}     # scores and ids, best first

        def take(batch):
            ids = batch.column(0)
            lowest = np.array(ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False))
            n = batch.column(1).to_numpy()
            terms, counts = batch.column(2), batch.column(3)
            begins = np.asarray(terms.offsets)
            number, tf = terms.values.to_numpy(), counts.values.to_numpy().astype(np.int64)
            m = document_weight(n, documents, length)
            for a in range(0, len(n), step):
                b = min(a + step, len(n))
                inside = slice(begins[a], begins[b])
                doc = np.repeat(np.arange(b - a), np.diff(begins[a: b + 1]))
                sums = np.zeros((n_terms + len(nodes), b - a), np.int64)
                sums[number[inside], doc] = contribution(tf[inside], m[a:b][doc], weights[number[inside]])
                for k, parts in enumerate(nodes):
                    sums[parts].sum(axis=0, out=sums[n_terms + k])
                for q in live:
                    score = sums[ends[q]]
                    had, had_ids = held[q]
                    least = had[-1] if len(had) >= top else 1
                    new = np.flatnonzero(score >= max(least, 1))
                    if len(new):
                        if len(new) > 4 * top:      # the best by score alone first, all ties with the last of them
                            cut = np.partition(score[new], len(new) - top)[len(new) - top]
                            new = new[score[new] >= cut]
                        new_ids = ids.take(pa.array(a + new))
                        all_ids = new_ids if had_ids is None else pa.concat_arrays([had_ids, new_ids])
                        scores = np.concatenate([had, score[new]])
                        order = np.lexsort((all_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), -scores))[:top]
                        held[q] = (scores[order], all_ids.take(pa.array(order)))

        for batch in batches:
            if batch.num_rows:
                take(batch)
        found = [(q, s, i) for q, (s, i) in held.items() if len(s)]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat([q for q, _, _ in found], [len(s) for _, s, _ in found]), pa.int32()),
                 pa.concat_arrays([i for _, _, i in found]), pa.array(np.concatenate([s for _, s, _ in found]), pa.int64())],
                ["query", "doc_id", "score"])

    return vectors.mapInArrow(run, "query int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents with a score above 0 of every item."""
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType
    out = None
    for ids, queries in query_blocks(items, item_col, item_text_col):
        vocabulary = Vocabulary(list(set().union(*queries)))
        number = {t: i for i, t in enumerate(vocabulary.terms)}
        nodes, ends = share_terms([{number[t] for t in q} for q in queries], len(number))
        vectors = materialize(document_vectors(docs, vocabulary, id_col, text_col), "term-vectors")
        documents, length = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        df = np.zeros(len(number), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():     # terms of the block
            df[r["t"]] = r["count"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        found = best_documents(vectors, queries, nodes, ends, weights, documents, length or 0, top)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
        near = Window.partitionBy("query", F.pmod(F.spark_partition_id(), F.lit(SALTS))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= top)
        names = small_table(spark, list(enumerate(ids)), _named(item_type))
        found = materialize(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"), "ranked")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = small_table(spark, [], _named(item_type)).selectExpr(
            "item_id", "0 AS rank", "CAST(0 AS bigint) AS doc_id", "CAST(0 AS bigint) AS score")
    return out


def _named(item_type):
    from pyspark.sql import types as T
    return T.StructType([T.StructField("query", T.IntegerType()), T.StructField("item_id", item_type)])
