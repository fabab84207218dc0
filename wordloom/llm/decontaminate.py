"""Benchmark decontamination by spaced-seed hashing.

A spaced seed looks at a window of words and ignores some positions, so it still
matches where a passage had words substituted there.  Each fixed mask hashes
every window of the benchmark items and of the documents; equal hashes are hits.
Around a hit the document and the item are laid side by side, word by word, and
the longest aligned stretch is taken in which at least ``identity`` of the words
match.  A document is contaminated if it has at least ``min_words`` words, or if
it holds the whole of a shorter item without a change.

The masks find every such stretch: with 13 words or more, a fifth of them
substituted at most, wherever they stand, one of the masks has all its places on
matching words (a test goes through all patterns).

Words are runs of letters and digits in lower case.  The benchmark is the query
set: it is dealt into blocks of a checked size, and every block meets every
document inside the tasks that read them, so no text is shuffled and a document
that matches many items, or an item that is in a third of all documents, is
nothing but a few more rows.

Defined cases: null or empty texts and items have no windows and match nothing;
an item with fewer than ``min_words`` words is matched as a whole.  Two
rows with one id are examined each.  Ties between stretches go to the earlier
one.  Null item ids are reported as null.  An empty benchmark finds nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from wordloom.llm.tables import release, unused_name
from wordloom.llm.words import LETTERS, column_slices, mix, word_hashes

# 1: the word is looked at, 0: it is ignored.
MASKS = ("111111", "1110111", "1111011", "1101111", "1111101", "11101011")
MIN_WORDS = 13
IDENTITY = 0.8
BLOCK_BYTES = 16 << 20      # benchmark text that is held in a task at a time


def normalised(texts) -> list[bytes]:
    return [(t or "").lower().encode().translate(LETTERS) for t in texts]


def seed_hashes(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """Hash of every window of the mask's length; ignored positions play no part."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(mask):
            if c == "1":
                out = (out + words[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(32)
    return out


def masks_for(n: int, min_words: int) -> list[tuple[int, str]]:
    """(salt, mask) that an item of ``n`` words is looked up by; a short item by all its words."""
    return [(i + 1, m) for i, m in enumerate(MASKS)] if n >= min_words else [(100 + n, "1" * n)] if n else []


class Seeds:
    """The seeds of one block of items, sorted by hash."""

    def __init__(self, ids: list, texts: list[bytes], min_words: int):
        words, first, *_ = word_hashes(texts) if texts else (np.empty(0, np.uint64), np.zeros(1, int))
        self.ids, self.words, self.first = ids, words, first
        parts, self.masks = [], {}
        for i in range(len(texts)):
            own = words[first[i]: first[i + 1]]
            for salt, mask in masks_for(len(own), min_words):
                h = seed_hashes(own, mask, salt)
                parts.append((h, np.full(len(h), i), np.arange(len(h))))
                self.masks[salt] = mask
        none = np.empty(0, np.int64)
        h, item, at = (np.concatenate(x) for x in zip(*parts)) if parts else (none.astype(np.uint64), none, none)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], item[order], at[order]
        self.seen = np.zeros(1 << 20, bool)           # a first look that most windows fail
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray):
        """(document word, item, item word) of every hit."""
        for salt, mask in self.masks.items():
            h = seed_hashes(words, mask, salt)
            at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
            low, high = (np.searchsorted(self.hash, h[at], side) for side in ("left", "right"))
            n = high - low
            at, low, n = at[n > 0], low[n > 0], n[n > 0]
            if len(at):
                k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(at, n), self.item[k], self.at[k]


def longest_stretch(equal: np.ndarray, identity: float) -> tuple[int, int]:
    """[from, to) of the longest run of aligned words that has the identity; the first of equally long ones."""
    total = np.concatenate(([0.0], np.cumsum(np.where(equal, 1 - identity, -identity))))
    low = np.minimum.accumulate(total)
    start = np.searchsorted(-low, -total - 1e-9)    # for each end the first start from which the score is not negative
    end = int(np.argmax(np.arange(len(total)) - start))
    return int(start[end]), end


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", min_words: int = MIN_WORDS,
         identity: float = IDENTITY, key_cols: tuple = ()) -> DataFrame:
    """Verified overlaps: doc_id, item_id, doc_start, item_start (in words), words, matches.

    ``key_cols`` are further columns of ``docs`` to carry along.  One row per
    document, item and diagonal with a stretch that passes.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), *key_cols, F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    keys = [f for f in src.schema.fields if f.name != "text"]
    schema = T.StructType([*keys, T.StructField("item_id", items.schema["item_id"].dataType),
                           *[T.StructField(c, T.IntegerType()) for c in ("doc_start", "item_start", "words", "matches")]])
    names = [f.name for f in schema.fields]
    item_type = to_arrow_type(items.schema["item_id"].dataType)

    def verified(doc: np.ndarray, seeds: Seeds, hits) -> list[tuple]:
        """Stretches of one document, from its hits (document word, item, item word)."""
        out = []
        for item, shift in sorted(set(zip(hits[1].tolist(), (hits[0] - hits[2]).tolist()))):
            own = seeds.words[seeds.first[item]: seeds.first[item + 1]]
            a, b = max(0, -shift), min(len(own), len(doc) - shift)
            equal = own[a:b] == doc[a + shift: b + shift]
            s, e = longest_stretch(equal, identity)
            if e - s >= min_words or len(own) < min_words and len(equal) == len(own) and equal.all():
                out.append((item, a + s + shift, a + s, e - s, int(equal[s:e].sum())))
        return out

    found = None
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast([(r["item_id"], t) for r, t in zip(part, normalised(r["text"] for r in part))])

        def run(batches, held=held):
            import pyarrow as pa
            seeds = Seeds([i for i, _ in held.value], [t for _, t in held.value], min_words)
            for batch in batches:
                row, rest = [], []
                for a, _, texts in column_slices(batch.column(len(keys)), 4 << 20):
                    words, first, *_ = word_hashes(normalised(texts))
                    every = [np.concatenate(x) for x in zip(*seeds.hits(words))]
                    if not every:
                        continue
                    owner = np.searchsorted(first, every[0], "right") - 1
                    order = np.argsort(owner, kind="stable")
                    for own in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1):
                        d = owner[own[0]]
                        doc = words[first[d]: first[d + 1]]
                        for s in verified(doc, seeds, (every[0][own] - first[d], every[1][own], every[2][own])):
                            row.append(a + d)
                            rest.append(s)
                cols = [batch.column(c).take(pa.array(row, pa.int64())) for c in range(len(keys))]
                cols.append(pa.array([seeds.ids[s[0]] for s in rest], item_type))
                cols += [pa.array([s[c] for s in rest], pa.int32()) for c in range(1, 5)]
                yield pa.RecordBatch.from_arrays(cols, names)
            release()

        rows = src.mapInArrow(run, schema)
        found = rows if found is None else found.unionByName(rows)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows without any overlap, with all their columns.

    Only the row hashes of contaminated rows move; a row goes if its id and
    text are those of a contaminated one.
    """
    keys = [unused_name(docs, k) for k in ("__k1", "__k2")]
    hashes = F.xxhash64(F.col(id_col), F.col(text_col)), F.hash(F.col(text_col), F.col(id_col))
    named = docs.withColumns(dict(zip(keys, hashes)))
    bad = find(named, benchmark, id_col, text_col, key_cols=tuple(keys), **how)
    return named.join(bad.select(*keys).distinct(), keys, "left_anti").select(*docs.columns)
