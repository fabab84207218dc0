"""Exact top-k search by inner product, pruned with multi-resolution segment statistics.

Every vector is cut into 1, 4, 16, ... segments of about equal length.  Of a
segment of ``l`` components, with mean ``mu`` and deviation ``s`` (both of the
population), two vectors differ by at least ``l ((mu_a - mu_b)² + (s_a - s_b)²)``,
so squared distances have a lower bound at every resolution, and with the norms
``<a, b> = (|a|² + |b|² - d²) / 2`` has an upper one.  A block of queries
meets a block of candidates chunk by chunk, the most promising chunk at the coarsest
resolution first; the last of a query's best scores so far is its floor, finer and
finer bounds drop the candidates below it, and the survivors get exact integer scores.

Queries are dealt into blocks of ``QUERY_BLOCK`` and every block of queries meets
every block of candidates in one task: both sides are joined by (query block,
candidate block), neither passes through the driver.  A task hands on at
most ``top`` rows per query.

Defined cases: vectors that are null or hold null or non-finite components, and
rows without an id, take no part.  Of rows with one id, the one with the least
vector (component by component) counts.  Vectors of another length than the
query's are no candidates of it; an empty vector has score 0 with empty ones.
Equal scores go to the smaller id.  Scores are exact whatever the components; one
beyond a long is the nearest long.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.ranking import materialize

SCALE = 64
TOP = 20
EVERY = 20              # ids divisible by it are queries
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 16_384
LEAST_BLOCK = 1024      # no smaller blocks of candidates are made to use more tasks
CHUNK = 1024             # queries and candidates whose bounds are held at a time
SALTS = 16
SAFE = float(1 << 53)   # integers up to here are exact as doubles


def segment_features(v: np.ndarray, segments: int) -> np.ndarray:
    """[vector x (mean and deviation of every segment, times the root of its length)]."""
    edges = np.linspace(0, v.shape[1], segments + 1).astype(np.int64)
    length = np.diff(edges)
    mean = np.add.reduceat(v, edges[:-1], axis=1) / length
    gap = v - np.repeat(mean, length, axis=1)
    deviation = np.sqrt(np.add.reduceat(gap * gap, edges[:-1], axis=1) / length)
    return np.hstack([mean, deviation]) * np.sqrt(np.tile(length, 2))


def resolutions(width: int) -> list[int]:
    """Numbers of segments, coarse to fine: powers of four, four components in the finest."""
    out = [1]
    while out[-1] * 16 <= width:
        out.append(out[-1] * 4)
    return out


def most_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of every row with every row, from their segment features.

    The least squared distance, the sum of ``l ((mu_a - mu_b)² + (s_a - s_b)²)``, is ``|a|² +
    |b|² - 2 <features of a, features of b>``, since a segment's squares sum up to ``l (mu² +
    s²)``.  So the features' inner product is the score that belongs to the least distance.
    """
    return a @ b.T


def exact_scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Integer inner products of every query with every candidate; the components are whole numbers."""
    most = max(np.abs(queries).max(initial=0.0), 1.0) * max(np.abs(candidates).max(initial=0.0), 1.0) * max(queries.shape[1], 1)
    if most < SAFE:
        return (queries @ candidates.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in candidates.tolist()]
    out = [[sum(m * n for m, n in zip([int(x) for x in q], c)) for c in whole] for q in queries.tolist()]
    return np.array([[min(max(x, -1 << 63), (1 << 63) - 1) for x in row] for row in out], np.int64).reshape(len(queries), len(candidates))


def kept(query: np.ndarray, score: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """Places of every query's ``top`` best pairs, best first; ties to the smaller id."""
    order = np.lexsort((ids, ~score, query))        # ~score falls as the score rises, without overflow
    begin = np.flatnonzero(np.concatenate(([True], np.diff(query[order]) != 0))) if len(order) else np.empty(0, np.int64)
    place = np.arange(len(order)) - np.repeat(begin, np.diff(np.append(begin, len(order))))
    return order[place < top]


def search_block(query_ids, queries, ids, candidates, top: int):
    """(query id, candidate id, score) of the best candidates in the block of every query, and how many pairs were scored.

    Queries and candidates are cut into chunks of close coarse means.  A chunk of
    queries meets the chunks of candidates best bound first, so its floor, the last of
    its best scores so far, rises early; what finer and finer bounds leave of a
    chunk (rows and columns with any pair not below the floor) is scored exactly.
    """
    far = lambda x: np.abs(x).max(initial=0.0) > 1e150      # noqa: E731  squares would overflow: no bounds, all pairs are scored
    levels = [] if not queries.shape[1] or far(queries) or far(candidates) else resolutions(queries.shape[1])
    if levels:
        a, b = np.argsort(queries.mean(axis=1), kind="stable"), np.argsort(candidates.mean(axis=1), kind="stable")
        query_ids, queries, ids, candidates = query_ids[a], queries[a], ids[b], candidates[b]
    of_query, of_candidate = ([segment_features(x, n) for n in levels] for x in (queries, candidates))
    most = np.sqrt(max((queries * queries).sum(axis=1).max(initial=0.0), 1.0) * max((candidates * candidates).sum(axis=1).max(initial=0.0), 1.0)) if levels else 0.0
    slack = 1e-9 * most + 1e-6      # far above the rounding error of a bound
    out, scored = [], 0
    for a in range(0, len(query_ids), CHUNK):
        mine = slice(a, min(a + CHUNK, len(query_ids)))
        n = mine.stop - a
        floor = np.full(n, -np.inf)
        found = (np.empty(0, np.int64),) * 3     # query in the chunk, candidate id, score
        chunks = [slice(c, min(c + CHUNK, len(ids))) for c in range(0, len(ids), CHUNK)]
        if levels:
            # the first resolution of every chunk, from its extremes: the chunks that can hold the best
            reach = [most_scores(of_query[0][mine], of_candidate[0][c]).max() for c in chunks]
            chunks = [chunks[i] for i in np.argsort(-np.array(reach), kind="stable")]
        for c in chunks:
            rows, cols = np.arange(n), np.arange(c.stop - c.start)
            for fq, fc in zip(of_query, of_candidate):
                alive = most_scores(fq[mine][rows], fc[c][cols]) >= floor[rows, None] - slack
                keep_rows, keep_cols = alive.any(axis=1), alive.any(axis=0)
                rows, cols = rows[keep_rows], cols[keep_cols]
                if not len(rows):
                    break
            if not len(rows) or not len(cols):
                continue
            score = exact_scores(queries[mine][rows], candidates[c][cols])
            scored += score.size
            good = (score >= floor[rows, None]) & (ids[c][cols][None, :] != query_ids[mine][rows, None])
            if good.sum() > 4 * top * len(rows):    # more than the best of this chunk, with all ties of the last, are not needed
                own = np.where(good, score, np.iinfo(np.int64).min)
                good &= score >= np.partition(own, score.shape[1] - top, axis=1)[:, [score.shape[1] - top]]
            i, j = np.nonzero(good)
            found = tuple(np.concatenate(x) for x in zip(found, (rows[i], ids[c][cols][j], score[i, j])))
            best = kept(*(found[k] for k in (0, 2, 1)), top)
            found = tuple(x[best] for x in found)
            last = np.flatnonzero(np.bincount(found[0], minlength=n) == top)
            if len(last):
                floor[last] = found[2][np.searchsorted(found[0], last, "right") - 1]
        out.append((query_ids[mine][found[0]], found[1], found[2]))
    if not out:
        return (np.empty(0, np.int64),) * 3, scored
    return tuple(np.concatenate(x) for x in zip(*out)), scored


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component, as whole doubles; one row per id."""
    v = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    src = src.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(good, F.lit(False)))
    return src.groupBy("vec_id").agg(F.min("v").alias("v"))


def nearest(vectors: DataFrame, top: int = TOP, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding",
            scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` highest inner products of every query with all other vectors."""
    spark = vectors.sparkSession
    rows = materialize(scaled(vectors, id_col, vector_col, scale), "vectors")
    query = F.pmod(F.col("vec_id"), F.lit(every)) == 0
    total, asked = rows.agg(F.count(F.lit(1)), F.count_if(query)).first()
    slots = max(spark.sparkContext.defaultParallelism, 1)
    query_blocks = max(1, -(-asked // QUERY_BLOCK))
    blocks = max(-(-total // CANDIDATE_BLOCK), min(2 * slots, total // LEAST_BLOCK), 1)
    key = lambda n, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(n))
    to_all = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    width = F.size("v").alias("width")
    left = rows.filter(query).select(width, key(query_blocks, 1).alias("q"), to_all(blocks).alias("c"), "vec_id", "v")
    right = rows.select(width, to_all(query_blocks).alias("q"), key(blocks, 2).alias("c"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))   # names of its own

    def arrays(table):
        n = table.num_rows
        v = table.column("v").combine_chunks()
        flat = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) if n else np.empty(0)
        return table.column("vec_id").to_numpy(), flat.reshape(n, len(flat) // n if n else 0)

    def meet(a, b):
        import pyarrow as pa
        names = ["query_id", "vec_id", "score"]
        if not a.num_rows or not b.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names})
        found, _ = search_block(*arrays(a), *arrays(b), top)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, found)})

    by = ["width", "q", "c"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(meet, "query_id long, vec_id long, score long")
    order = [F.col("score").desc(), "vec_id"]
    if blocks > SALTS:      # the best of some blocks first, so that no task ranks the rows of all of them
        near = Window.partitionBy("query_id", F.pmod(F.spark_partition_id(), F.lit(SALTS))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return found.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
