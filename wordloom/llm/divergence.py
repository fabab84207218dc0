"""Audit of how the sources of a language differ in the terms they use.

1. Every task counts the terms of its texts by length: terms of up to 8 bytes
   are one ``uint64``, of up to 16 bytes two, sorted by radix and counted as runs
   in numpy; longer terms lie in one byte-sorted bucket per length.
2. Counts are summed per (language, source, term).  A language keeps the terms
   in at least ``min_docs`` of its documents.
3. The kept terms of a language are dealt by hash into blocks of bounded size.
   A block compares, for all its terms, the smoothed shares of every two sources
   and of every source with its language.  Sums over blocks give the divergence
   of two sources; the best terms of all blocks are a source's own terms.

``share = 1 + floor(scale * (count + 2) / (N + 2 V))``, with the count N of all
kept terms and their number V; ``f = floor((p - q)² / (p + q))``.  All arithmetic
is exact in 64-bit integers (the division is done three digits at a time).

Defined cases: null text, language and source are ''.  Every occurring (language,
source) is a group, also one without terms.  A language without kept terms gives
0 for every two sources.  A language with one source has no pairs.  Repeated rows
are documents each.  Equal values are ordered by the item's bytes.  Columns
other than those named are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import terms as P
from wordloom.operators.ranking import materialize

MIN_DOCS = 10
SCALE = 1_000_000_000
TOP = 10
HELD = 1 << 21          # counts that a task holds before it hands them on
BLOCK_ROWS = 200_000    # kept (source, term) counts in a block
CELLS = 1 << 20         # cells (term x source) compared at a time
OUT = "lang string, source string, part string, item string, value long"


class Counts:
    """(group, term) -> occurrences and documents, by length of the term."""

    def __init__(self):
        self.groups: dict[tuple, int] = {}
        self.short = {1: [], 2: []}     # number of words -> [(words ..., group, n, docs)]
        self.long: Counter = Counter()  # (group, bytes) -> n, and (group, bytes, None) -> docs
        self.held = 0

    def add(self, low, starts, ends, text, group_of_text):
        lengths, group = ends - starts, group_of_text[text].astype(np.uint32)
        for words, least, most in ((1, 1, 8), (2, 9, 16)):
            of = np.flatnonzero((lengths >= least) & (lengths <= most))
            if len(of):
                keys = [P.packed(low, starts[of], lengths[of], 8 * w) for w in range(words)]
                self._count(words, keys, group[of], text[of])
        of = np.flatnonzero(lengths > 16)
        for length in np.unique(lengths[of]):
            same = of[lengths[of] == length]
            letters = np.empty((len(same), length), np.uint8)
            if length > len(same):
                for row, at in zip(letters, starts[same]):
                    row[:] = low[at: at + length]
            else:
                for at in range(length):
                    letters[:, at] = low[starts[same] + at]
            self._count_long(letters, group[same], text[same])

    def _count(self, words, keys, group, text):
        order = P.radix_order([group, *reversed(keys)])
        keys, group, text = [k[order] for k in keys], group[order], text[order]
        new = P.fresh(*keys, group)
        at = np.flatnonzero(new)
        documents = np.add.reduceat((new | P.fresh(text)).astype(np.int64), at)
        n = np.diff(np.append(at, len(group)))
        self.short[words].append((*(k[at] for k in keys), group[at], n, documents))
        self.held += len(at)

    def _count_long(self, letters, group, text):
        term = np.ascontiguousarray(letters).view(f"S{letters.shape[1]}").ravel()
        order = np.lexsort((group, term))
        term, group, text = term[order], group[order], text[order]
        new = P.fresh(term, group)
        at = np.flatnonzero(new)
        documents = np.add.reduceat((new | P.fresh(text)).astype(np.int64), at)
        for i, n, d in zip(at, np.diff(np.append(at, len(group))), documents):
            key = (int(group[i]), bytes(term[i]))
            self.held += key not in self.long
            self.long[key] += int(n)
            self.long[(*key, None)] += int(d)

    def merge(self):
        """Sum equal (term, group) of the parts that came in one after another."""
        self.held = len(self.long) // 2
        for words, parts in self.short.items():
            if len(parts) > 1:
                cols = [np.concatenate(c) for c in zip(*parts)]
                *keys, group, n, documents = cols
                order = P.radix_order([group, *reversed(keys)])
                keys, group = [k[order] for k in keys], group[order]
                at = np.flatnonzero(P.fresh(*keys, group))
                parts[:] = [(*(k[at] for k in keys), group[at], np.add.reduceat(n[order], at), np.add.reduceat(documents[order], at))]
            self.held += sum(len(p[0]) for p in parts)

    def batches(self, size: int = 1 << 17):
        """Arrow batches of (lang, source, term, n, docs); nothing is held afterwards."""
        import pyarrow as pa
        self.merge()
        names = [pa.array([g[i] for g in self.groups], pa.string()) for i in (0, 1)]

        def batch(term, group, n, documents):
            return pa.RecordBatch.from_arrays(
                [*(s.take(pa.array(group, pa.int32())) for s in names), pa.array(term, pa.binary()).cast(pa.string()),
                 pa.array(n, pa.int64()), pa.array(documents, pa.int64())], ["lang", "source", "term", "n", "docs"])

        for words, parts in self.short.items():
            for *keys, group, n, documents in parts:
                for a in range(0, len(n), size):
                    b = slice(a, a + size)
                    yield batch(P.unpacked([k[b] for k in keys]), group[b].astype(np.int32), n[b], documents[b])
        keys = [k for k in self.long if len(k) == 2]
        for a in range(0, len(keys), 1 << 12):
            own = keys[a: a + (1 << 12)]
            yield batch([k[1] for k in own], np.array([k[0] for k in own], np.int32), [self.long[k] for k in own],
                        [self.long[(*k, None)] for k in own])
        self.__init__()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of every term in every group, and the group's documents that hold it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    src = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))

    def run(batches):
        held = Counts()
        for batch in batches:
            data, offsets = P.buffer_of(batch.column(2))
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for a, b in P.slices(offsets):
                for name in names[a:b]:
                    held.groups.setdefault(name, len(held.groups))
                group = np.fromiter((held.groups[x] for x in names[a:b]), np.int64, b - a)
                held.add(*P.runs(data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a], P.LETTERS), group)
                if held.held > HELD:
                    held.merge()
                    if held.held > HELD // 2 or len(held.groups) > HELD:
                        yield from held.batches()
        yield from held.batches()

    counted = src.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, **columns) -> DataFrame:
    """(lang, source, term, n, n_lang, lead): counts of the terms that a language keeps.

    ``n_lang`` is the term's count in the language; one row of a (language, term) is marked ``lead``.
    """
    whole = Window.partitionBy("lang", "term")
    counted = term_counts(docs, **columns)
    counted = counted.select("lang", "source", "term", "n", F.sum("docs").over(whole).alias("docs"),
                             F.sum("n").over(whole).alias("n_lang"), (F.min("source").over(whole) == F.col("source")).alias("lead"))
    return counted.filter(F.col("docs") >= min_docs).drop("docs")


def share(count: np.ndarray, total, kept, scale: int = SCALE) -> np.ndarray:
    """``1 + floor(scale * (count + 2) / (total + 2 * kept))``, exactly; scale is a power of 1000."""
    whole = np.maximum(total + 2 * kept, 1)
    digits, rest = np.divmod(count + 2, whole)
    while scale > 1:
        more, rest = np.divmod(rest * 1000, whole)
        digits, scale = digits * 1000 + more, scale // 1000
    return 1 + digits


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``floor((p - q)² / (p + q))``."""
    return (p - q) ** 2 // (p + q)


def compare_block(left, right):
    """Pairs of sources and own terms of every source, from one block of a language's terms.

    ``left``: (source, term, n, n_lang) of the block, ``right``: (lang, block, source, total, kept, lang_total)
    of all sources of the language.
    """
    import pyarrow as pa
    if not right.num_rows:
        return pa.table({c: pa.array([], t) for c, t in zip(("lang", "source", "part", "item", "value"), [pa.string()] * 4 + [pa.int64()])})
    right = right.sort_by("source")
    names, lang = right.column("source").combine_chunks(), right.column("lang")[0].as_py()
    total, kept = right.column("total").to_numpy(), int(right.column("kept")[0].as_py())
    count = len(names)
    sums = np.zeros((count, count), np.int64)
    out = []
    if left.num_rows:
        number = {s: i for i, s in enumerate(names.to_pylist())}
        source = np.fromiter(map(number.__getitem__, left.column("source").to_pylist()), np.int64, left.num_rows)
        words = left.column("term").combine_chunks().dictionary_encode()
        rank = np.argsort(np.argsort(np.array([w.encode() for w in words.dictionary.to_pylist()], object)))
        term, n = rank[words.indices.to_numpy()], left.column("n").to_numpy()
        n_terms = len(rank)
        step = max(1, CELLS // count)
        order = np.argsort(term, kind="stable")
        for a in range(0, n_terms, step):
            own = order[np.searchsorted(term[order], a): np.searchsorted(term[order], a + step)]
            table = np.zeros((min(step, n_terms - a), count), np.int64)
            table[term[own] - a, source[own]] = n[own]
            p = share(table, total[None, :], kept)
            for i in range(count - 1):
                sums[i, i + 1:] += difference(p[:, i + 1:], p[:, i: i + 1]).sum(axis=0)
        sums += sums.T
        p = share(n, total[source], kept)
        q = share(left.column("n_lang").to_numpy(), int(right.column("lang_total")[0].as_py()), kept)
        value = difference(p, q)
        more = np.flatnonzero((n > 0) & (p > q))
        more = more[np.lexsort((term[more], -value[more], source[more]))]
        begin = np.flatnonzero(P.fresh(source[more]))
        place = np.arange(len(more)) - np.repeat(begin, np.diff(np.append(begin, len(more))))
        best = more[place < TOP]
        out.append(pa.table({"lang": pa.array([lang] * len(best), pa.string()), "source": names.take(pa.array(source[best])),
                             "part": pa.array(["term"] * len(best), pa.string()),
                             "item": left.column("term").combine_chunks().take(pa.array(best)), "value": pa.array(value[best], pa.int64())}))
    told = np.ones_like(sums, bool) if right.column("block")[0].as_py() == 0 else sums > 0
    np.fill_diagonal(told, False)
    a, b = np.nonzero(told)
    out.append(pa.table({"lang": pa.array([lang] * len(a), pa.string()), "source": names.take(pa.array(a)),
                         "part": pa.array(["pair"] * len(a), pa.string()), "item": names.take(pa.array(b)),
                         "value": pa.array(sums[a, b], pa.int64())}))
    return pa.concat_tables(out)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang",
          source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language with its divergence.  Part
    ``term``: the at most ``top`` (``TOP`` or fewer) terms by which the source differs most from its language.
    """
    if top > TOP:
        raise ValueError(f"at most {TOP} terms per source are kept")
    kept = materialize(kept_terms(docs, min_docs, text_col=text_col, lang_col=lang_col, source_col=source_col), "kept-terms")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    totals = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"), F.count_if("lead").alias("leads"))
    of_lang = Window.partitionBy("lang")      # one row per source
    groups = groups.join(totals, ["lang", "source"], "left").na.fill(0).select(
        "lang", "source", "total", F.sum("leads").over(of_lang).alias("kept"), F.sum("total").over(of_lang).alias("lang_total"),
        F.ceil(F.sum("rows").over(of_lang) / F.lit(BLOCK_ROWS)).alias("blocks"))
    groups = materialize(groups, "groups")
    blocks = groups.groupBy("lang").agg(F.greatest(F.max("blocks"), F.lit(1)).alias("blocks"))
    left = kept.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").alias("block"), "source", "term", "n", "n_lang")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest("blocks", F.lit(1).cast("long")) - 1)).alias("block"),
                          "source", "total", "kept", "lang_total")
    parts = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(
        lambda a, b: compare_block(a, b), OUT)
    summed = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    ranked = summed.withColumn("rank", F.row_number().over(place))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= top))
