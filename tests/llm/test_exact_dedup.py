import hashlib

import pytest
from pyspark.sql import functions as F

from wordloom.llm import exact_dedup as E


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, first = max(known) if known else None, True
        for i in ids:
            out.append((i, keep, len(ids), i == keep and first, hashlib.sha256(t.encode()).hexdigest()))
            first = first and i != keep
    return sorted(out, key=repr)


ROWS = [(1, "a"), (2, "a"), (3, ""), (4, None), (5, "b"), (5, "b"), (5, "c"), (None, "n"), (None, "n"), (None, "a"),
        (6, "x" * 300_000), (7, "x" * 300_000), (8, "x" * 300_000 + "y")] + [(100 + i, "hot") for i in range(60)] + [(300 + i, f"t{i}") for i in range(80)]


@pytest.mark.parametrize("how", [{}, {"capacity": 4, "hot_rows": 5}, {"capacity": 1, "hot_rows": 1}])
def test_brute_force(spark, how):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in ROWS], "doc_id long, text string, h int, bucket int").repartition(5)
    got = E.classes(docs, **how)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(ROWS)


def test_survivors(spark):
    docs = spark.createDataFrame([(i, t, f"s{n}", n) for n, (i, t) in enumerate(ROWS)], "doc_id long, text string, h string, keep int").repartition(4)
    got = E.survivors(docs, capacity=8, hot_rows=3)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len({t or "" for _, t in ROWS})
    given = {tuple(r) for r in docs.collect()}
    for r in rows:
        assert tuple(r) in given
        same = [i for i, t in ROWS if (t or "") == (r["text"] or "") and i is not None]
        assert r["doc_id"] == (max(same) if same else None)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert E.classes(docs).count() == 0 and E.survivors(docs).count() == 0


@pytest.mark.parametrize("n, capacity", [(0, 4), (1, 4), (500, 7), (500, 1), (500, 1000)])
def test_directory_covers_all_hashes(spark, n, capacity):
    keys = spark.range(n).select(F.xxhash64("id").alias("h"))
    depth, buckets = E.directory(keys, capacity)
    slots = sorted((r["slot"], r["bucket"]) for r in E.slots(keys, depth, buckets).collect())
    assert [s for s, _ in slots] == list(range(2 ** depth))
    assert [b for _, b in slots] == sorted(b for _, b in slots)     # a bucket is one range of hashes
    table = dict(slots)
    sizes = {}
    for r in keys.collect():
        b = table[(r["h"] % 2 ** 64) >> (64 - depth) if depth else 0]
        sizes[b] = sizes.get(b, 0) + 1
    assert max(sizes.values(), default=0) <= capacity


def test_crowded_hashes_double_the_directory(spark):
    keys = spark.range(64).select((F.col("id") + 2 ** 40).alias("h"))       # equal in their first 58 bits
    depth, buckets = E.directory(keys, 32)
    assert depth == 59 and len(buckets) == 60
