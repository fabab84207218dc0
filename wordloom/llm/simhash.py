"""SimHash near-dedup with bit-sliced comparison.

A text's fingerprint has a bit set where over half of its shingle hashes have
it.  Fingerprints at most ``radius`` bits apart are linked; documents of one
connected component are near duplicates.

* Equal fingerprints are one node, so copies never meet in pairs.
* Candidates: the 64 bits are cut into ``radius + e`` bands; two fingerprints
  within the radius agree on ``e`` bands at least.  Every choice of ``e`` bands
  deals the nodes into buckets.  ``e`` only balances bucket size against the
  number of choices; any ``e`` finds every link.
* A bucket beyond ``BUCKET`` nodes is cut into blocks, and each pair of blocks
  is a bucket of its own, so no task compares more than two blocks at once.
* Inside a task the sorted nodes are compared in tiles.  A tile holds its
  fingerprints as 64 vertical bit planes, one machine word for 64 of them; the
  planes are XORed with a query's bits and added into carry-save counters, so
  one pass updates 64 distances at a time, and a tile is abandoned once every
  counter is past the radius.
* A task gives back a spanning forest of what it linked: one row per node at
  most, whatever the number of links.

Defined cases: null text counts as empty; a text without words has fingerprint
zero and is linked like any other.  Null ids are ignored when the smallest id of
a component is taken (null if there is no other).  Repeated rows are linked like
other copies.  An empty table gives an empty result.  Other columns are not read
by ``near_duplicates``; ``survivors`` returns rows as they came.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.graph import components
from wordloom.llm.words import word_blocks
from wordloom.llm.tables import release, unused_name
from wordloom.operators.ranking import materialize

SHINGLE = 4
RADIUS = 4
BUCKET = 4_096          # nodes of a bucket before it is cut into blocks
QUERIES, LANES = 256, 4_096   # a tile: so many fingerprints against so many


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of one lower-cased text as a signed integer."""
    from xxhash import xxh64_intdigest
    ones, total, rest = np.zeros(64, np.int64), 0, []
    for words in word_blocks(data):
        words = rest + words
        if len(words) >= shingle:
            texts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
            found = np.fromiter(map(xxh64_intdigest, texts, repeat(42)), np.dtype("<u8"), len(words) - shingle + 1)
            bits = np.unpackbits(found.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            total += len(found)
            words = words[len(words) - shingle + 1:]
        rest = words
    if not total and rest:
        found = np.array([xxh64_intdigest(b" ".join(rest), 42)], np.dtype("<u8"))
        ones, total = np.unpackbits(found.view(np.uint8), bitorder="little").astype(np.int64), 1
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, k1, k2, fp): k1 and k2 tell rows apart by id and text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("k1"),
                      F.hash(F.col(text_col), F.col(id_col)).alias("k2"), text.alias("text"))
    schema = T.StructType([*src.schema.fields[:3], T.StructField("fp", T.LongType())])

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            found = [fingerprint(t.as_py().encode().lower(), shingle) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())],
                                             ["doc_id", "k1", "k2", "fp"])
        release()

    return src.mapInArrow(run, schema)


class Forest:
    """Spanning forest of numbered nodes, fed with arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (r != (s := self.up[r])).any():
            r = s
        self.up[x] = r
        return r

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))


def tile_links(queries: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, lane) at most ``radius`` bits apart, by bit-sliced counters."""
    q = queries.view(np.uint64)
    words = -(-len(lanes) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(lanes)] = lanes.view(np.uint64)
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")          # lane x bit
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # bit x word
    counters = [np.zeros((len(q), words), np.uint64) for _ in range((radius + 1).bit_length())]
    past = np.zeros((len(q), words), np.uint64)       # lanes whose distance is past the radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    target = radius + 1
    for b in range(64):
        flip = np.where((q >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))[:, None]
        carry = planes[b][None, :] ^ flip             # 1: this bit differs
        for c in counters:                            # carry-save addition of one bit to 64 counters a word
            carry, c[...] = c & carry, c ^ carry
        past |= carry
        if b >= target - 1:
            reached = full
            for k, c in enumerate(counters):
                reached = reached & (c if target >> k & 1 else ~c)
            past |= reached
            if b % 8 == 7 and (past == full).all():
                return np.empty(0, np.int64), np.empty(0, np.int64)
    near = np.unpackbits((~past).view(np.uint8), axis=1, bitorder="little")[:, : len(lanes)]
    return np.nonzero(near)


def bucket_forest(run: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (a, b) among rows sorted by bucket; ``run`` is the end of each row's bucket."""
    forest = Forest(len(fps))
    for i in range(0, len(fps), QUERIES):
        to = min(i + QUERIES, len(fps))
        for j in range(i, int(run[to - 1]), LANES):
            a, b = tile_links(fps[i:to], fps[j: min(j + LANES, int(run[to - 1]))], radius)
            a, b = a + i, b + j
            forest.link(a[a < b], b[a < b])
    nodes = np.arange(len(fps))
    root = forest.roots(nodes) if len(fps) else nodes
    return fps[root != nodes], fps[root[root != nodes]]


def bands(radius: int, extra: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``radius + extra`` bands that cover 64 bits."""
    n = radius + extra
    edge = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def band_choices(nodes: int, radius: int, bucket: int) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """Bands, and the choices of them that must agree: as few as keep an average bucket small."""
    for extra in range(1, 5):
        if nodes >> (64 * extra // (radius + extra)) <= bucket // 4 or extra == 4:
            return bands(radius, extra), list(combinations(range(radius + extra), extra))


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints ``nodes.fp`` within the radius."""
    cut, choices = band_choices(nodes.count(), radius, bucket)

    def key(choice):
        parts = [F.shiftrightunsigned("fp", cut[k][0]).bitwiseAND(F.lit((1 << cut[k][1]) - 1)) for k in choice]
        return F.xxhash64(F.lit(choices.index(choice)), *parts)

    dealt = nodes.select("fp", F.explode(F.array(*[key(c) for c in choices])).alias("key"))
    large = (dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket)
             .select("key", F.ceil(F.col("n") / bucket).cast("int").alias("blocks")))
    large = materialize(large, "large-buckets")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    cuts = (dealt.join(large, "key").withColumn("mine", mine)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("fp", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key")))
    whole = dealt.join(large, "key", "left_anti").select("fp", "key")
    sorted_rows = whole.unionByName(cuts).repartition("key").sortWithinPartitions("key", "fp")

    def run(batches):
        import pyarrow as pa
        held = None
        for last, batch in _with_last(batches):
            rows = np.stack([batch.column(c).to_numpy() for c in ("key", "fp")])
            rows = rows if held is None else np.concatenate([held, rows], axis=1)
            # rows of the last bucket wait for the rest of it
            full = rows.shape[1] if last else int(np.searchsorted(rows[0], rows[0, -1]))
            if full:
                keys = rows[0, :full]
                end = np.searchsorted(keys, keys, "right")
                a, b = bucket_forest(end, rows[1, :full], radius)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            held = rows[:, full:]

    return sorted_rows.mapInArrow(run, "a long, b long")


def _with_last(items):
    """(is it the last, item), leaving out empty batches."""
    items = (x for x in items if x.num_rows)
    before = next(items, None)
    for item in items:
        yield False, before
        before = item
    if before is not None:
        yield True, before


def component_table(rows: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(fp, component_id, k1, k2) of every distinct fingerprint; k1, k2 name the row that stays."""
    own = materialize(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2"))
                                             .alias("least")), "fingerprint-classes")
    root = components(links(own.select("fp"), radius, bucket))
    grouped = (own.join(root.withColumnRenamed("node", "fp"), "fp", "left")
               .select("fp", F.coalesce("root", "fp").alias("root"), "least"))
    best = grouped.groupBy("root").agg(F.min("least").alias("best"))
    return grouped.join(best, "root").select("fp", F.col("best.doc_id").alias("component_id"), "best.k1", "best.k2")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    found = component_table(rows, radius).select("fp", "component_id")
    return rows.join(found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
              radius: int = RADIUS) -> DataFrame:
    """The rows that stay: of each component the one with the smallest id (then row hash)."""
    rows = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    keys = [unused_name(docs, k) for k in ("__k1", "__k2")]
    kept = component_table(rows, radius).select(*[F.col(k).alias(name) for k, name in zip(("k1", "k2"), keys)]).distinct()
    hashes = F.xxhash64(F.col(id_col), F.col(text_col)), F.hash(F.col(text_col), F.col(id_col))
    stay = docs.withColumns(dict(zip(keys, hashes))).join(kept, keys, "left_semi")
    return stay.dropDuplicates(keys).select(*docs.columns)
