"""Substring dedup by prefix-partitioned suffix trees over words.

The suffixes of all texts are split into groups by a prefix of variable length:
a prefix that starts more suffixes than a group may hold is extended by another
word.  A group is one subtree of the corpus' suffix tree and fits in a task.
Only its deep internal nodes matter, those ``window`` words down: two suffixes
pass through the same node exactly if their first ``window`` words are equal.
A node with suffixes of several documents is a repeat; consecutive repeats in a
text merge into its maximal repeats.

How it runs:

1. One pass counts the suffixes of every prefix code (fixed table size) and the
   table is cut into groups (``prefix_groups``).
2. Texts are dealt into chunks by a hash.  A chunk sends each group the sorted
   digests of its suffixes' first words, once per distinct digest with the
   smallest document that has it, so a passage that is in every text is one
   entry per chunk.  Sorted digests are sent as compressed differences.
3. A group merges its chunks' entries into nodes and answers each chunk with
   one bit per entry: does a smaller document go through this node?
4. A chunk joins the answers with its texts and drops the covered words.

Digests have 64 bits of the window and the group's prefix besides; within a group of
two million suffixes a false match is expected once in several million groups.

Defined cases: null text has no words.  A null id is not comparable, so such a
document neither loses words nor makes others lose any.  Rows with the same id
do not count as smaller than each other.  Repeats inside one document stay.
Texts shorter than the window stay whole.  An empty table gives an empty result.
Only the id (an integer) and the text are read.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.words import batches as slices, mix, word_hashes

WINDOW = 13
GROUP_SUFFIXES = 1 << 21     # suffixes of a group, about
CHUNK_BYTES = 8 << 20        # text of a chunk, about
CODE_BITS = (16, 24)         # prefix codes have so many bits, at least and at most


def code_bits(size: int, most: int = GROUP_SUFFIXES) -> int:
    """Bits of the prefix codes for so many bytes: an average code is far below a group."""
    return min(max((size // (4 * most)).bit_length() + 6, CODE_BITS[0]), CODE_BITS[1])


def prefix_codes(words: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Code of the first three words of the suffixes 0..n-1: most bits for the first, four for each further word."""
    one = words[:n] >> np.uint64(64 - (bits - 8))
    two, three = (words[k:n + k] >> np.uint64(60) for k in (1, 2))
    return ((one << np.uint64(8)) | (two << np.uint64(4)) | three).astype(np.int64)


def prefix_groups(counts: np.ndarray, most: int = GROUP_SUFFIXES) -> np.ndarray:
    """Group of every prefix code.

    A one-word prefix with at most ``most`` suffixes is kept whole, a larger one
    is extended to two words, then to three.  Neighbouring prefixes share a
    group as long as they fit.
    """
    one, two = counts.reshape(-1, 256).sum(axis=1), counts.reshape(-1, 16).sum(axis=1)
    groups, group, held = np.empty(len(counts), np.int32), 0, 0

    def put(at: int, width: int, n: int) -> None:
        nonlocal group, held
        if held and held + n > most:
            group, held = group + 1, 0
        groups[at:at + width] = group
        held += n

    for i, n in enumerate(one):
        if n <= most:
            put(i * 256, 256, int(n))
            continue
        for j in range(i * 16, i * 16 + 16):
            if two[j] <= most:
                put(j * 16, 16, int(two[j]))
            else:
                for k in range(j * 16, j * 16 + 16):
                    put(k, 1, int(counts[k]))
    return groups


class Suffixes:
    """The suffixes of one chunk's texts (ordered by document id), one entry per group and digest."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, groups: np.ndarray, bits: int, window: int):
        words, self.first, *_ = word_hashes(texts)
        n = max(0, len(words) - window + 1)
        digest = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(window):
                digest = (digest + words[k:k + n]) * np.uint64(0xD6E8FEB86659FD93)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))[:n]
        whole = np.arange(n) + window <= self.first[owner + 1]      # the window stays inside its text
        self.at = np.flatnonzero(whole)
        self.doc = owner[self.at]
        digest = mix(digest[self.at])
        group = groups[prefix_codes(words, n, bits)[self.at]]
        order = np.argsort(digest, kind="stable")                   # then texts are in order within a digest
        order = order[np.argsort(group[order], kind="stable")]
        d, g = digest[order], group[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
        self.entry = np.empty(len(order), np.int64)                 # entry of each suffix
        self.entry[order] = np.cumsum(new) - 1
        self.digest, self.group, self.least = d[new], g[new], self.doc[order[new]]
        self.ids = ids

    def messages(self):
        """(group, first entry, last entry + 1)."""
        edge = np.flatnonzero(np.diff(self.group)) + 1
        bounds = np.concatenate(([0], edge, [len(self.group)]))
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b > a:
                yield int(self.group[a]), int(a), int(b)

    def removed(self, smaller: np.ndarray, window: int) -> np.ndarray:
        """Which words go, given for each entry whether another chunk has a smaller document."""
        gone = smaller[self.entry] | (self.ids[self.doc] > self.ids[self.least[self.entry]])
        edge = np.zeros(int(self.first[-1]) + 1, np.int32)
        np.add.at(edge, self.at[gone], 1)
        np.add.at(edge, self.at[gone] + window, -1)
        return np.cumsum(edge)[:-1] > 0


def squeeze(values: np.ndarray) -> bytes:
    """Integers as compressed byte planes."""
    import zstandard
    wide = values.astype("<u8")
    return zstandard.compress(np.ascontiguousarray(wide.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def expand(data: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _ordered(table, with_ids: bool):
    """Texts and ids of one chunk in a fixed order; without ids only the rows that have none."""
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").to_pylist()
    rows = sorted((i, t.encode()) for i, t in zip(ids, texts) if i is not None) if with_ids else \
        [(None, t.encode()) for i, t in zip(ids, texts) if i is None]
    return [t for _, t in rows], [i for i, _ in rows]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   group_suffixes: int = GROUP_SUFFIXES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (words joined by a space) and spans.

    ``spans`` are the maximal repeats that were taken out: [start, end) in words.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = code_bits(size, group_suffixes)

    def count(batches):
        import pyarrow as pa
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                own = [t.encode() for t in texts[a:b]]
                words, *_ = word_hashes(own)
                n = max(0, len(words) - window + 1)
                total += np.bincount(prefix_codes(words, n, bits), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["code", "n"])

    counts = np.zeros(1 << bits, np.int64)
    found = src.select("text").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts[found["code"].to_numpy()] = found["n"].to_numpy()
    groups = spark.sparkContext.broadcast(prefix_groups(counts, group_suffixes))       # 2**bits numbers
    chunks = max(1, size // chunk_bytes)
    dealt = src.withColumn("chunk", F.pmod(F.xxhash64("text", "doc_id"), F.lit(chunks)).cast("int"))

    def send(table):
        import pyarrow as pa
        texts, ids = _ordered(table, True)
        s = Suffixes(texts, np.array(ids, np.int64), groups.value, bits, window)
        chunk = table.column("chunk")[0].as_py()
        out = []
        for g, a, b in s.messages():
            least = s.least[a:b]
            used, place = np.unique(least, return_inverse=True)
            out.append((g, chunk, squeeze(np.diff(s.digest[a:b], prepend=np.uint64(0))), squeeze(place),
                        squeeze(s.ids[used])))
        cols = list(zip(*out)) or [[]] * 5
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), *[pa.binary()] * 3))],
                        names=["grp", "chunk", "digests", "least", "ids"])

    def answer(table):
        import pyarrow as pa
        rows = [c.to_pylist() for c in table.columns]
        digests = [np.cumsum(expand(x), dtype=np.uint64) for x in rows[2]]
        least = [expand(i).view(np.int64)[expand(p).astype(np.int64)] for p, i in zip(rows[3], rows[4])]
        edges = np.cumsum([0, *map(len, digests)])
        d, doc = np.concatenate(digests), np.concatenate(least)
        order = np.argsort(d, kind="stable")
        node = np.concatenate(([0], np.flatnonzero(np.diff(d[order])) + 1))   # first suffix of each deep node
        smallest = np.repeat(np.minimum.reduceat(doc[order], node), np.diff(np.append(node, len(d))))
        smaller = np.empty(len(d), bool)
        smaller[order] = smallest < doc[order]
        out = [(rows[1][i], rows[0][i], np.packbits(smaller[a:b]).tobytes())
               for i, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if smaller[a:b].any()]
        cols = list(zip(*out)) or [[]] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()))],
                        names=["chunk", "grp", "bits"])

    def drop(table, answers):
        import pyarrow as pa
        out = []
        for with_ids in (True, False):
            texts, ids = _ordered(table, with_ids)
            if with_ids:
                s = Suffixes(texts, np.array(ids, np.int64), groups.value, bits, window)
                told = dict(zip(answers.column("grp").to_pylist(), answers.column("bits").to_pylist()))
                smaller = np.zeros(len(s.digest), bool)
                for g, a, b in s.messages():
                    if g in told:
                        smaller[a:b] = np.unpackbits(np.frombuffer(told[g], np.uint8), count=b - a)
                gone = s.removed(smaller, window)
            for i, (t, doc) in enumerate(zip(texts, ids)):
                words = t.split()
                mine = gone[s.first[i]: s.first[i + 1]] if with_ids else np.zeros(len(words), bool)
                n = int(mine.sum())
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mine, [0])))).reshape(-1, 2) if n else ()
                out.append((doc, len(words), n, b" ".join(compress(words, (~mine).tolist()) if n else words).decode(),
                            [{"start": int(x), "end": int(y)} for x, y in edge]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        cols = list(zip(*out)) or [[]] * 5
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)],
                        names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    sent = dealt.groupBy("chunk").applyInArrow(send, "grp int, chunk int, digests binary, least binary, ids binary")
    answers = sent.groupBy("grp").applyInArrow(answer, "chunk int, grp int, bits binary")
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        drop, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>")
