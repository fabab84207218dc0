import numpy as np
import pytest
import xxhash

from wordloom.llm import simhash as S
from wordloom.llm.graph import components
from wordloom.llm.words import word_blocks

rng = np.random.default_rng(7)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def clustered(n):
    base = rng.integers(-2 ** 63, 2 ** 63 - 1, n)
    near = [base ^ np.bitwise_or.reduce([np.int64(1) << rng.integers(0, 64, n) for _ in range(k)]) for k in (1, 2, 3, 4, 5, 6)]
    return np.unique(np.concatenate([base, *near]))


def brute_components(fps, radius):
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_tiles_equal_popcounts(radius):
    fps = clustered(120)
    a, b = S.tile_links(fps[:200], fps, radius)
    near = np.bitwise_count((fps[:200, None] ^ fps[None, :]).view(np.uint64)) <= radius
    want = np.nonzero(near)
    assert (a == want[0]).all() and (b == want[1]).all()


@pytest.mark.parametrize("bucket", [4096, 24, 2])
def test_components_equal_brute_force(spark, bucket):
    fps = clustered(40)
    rows = spark.createDataFrame([(int(f),) for f in fps], "fp long").repartition(3)
    root = {r["node"]: r["root"] for r in components(S.links(rows, 4, bucket)).collect()}
    got = [root.get(int(f), int(f)) for f in fps]
    want = brute_components(fps, 4)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


@pytest.mark.parametrize("extra", [1, 2, 3, 4])
def test_any_choice_of_bands_keeps_every_link(extra, monkeypatch, spark):
    fps = clustered(25)
    monkeypatch.setattr(S, "band_choices", lambda *_: (S.bands(4, extra), list(S.combinations(range(4 + extra), extra))))
    root = {r["node"]: r["root"] for r in components(S.links(spark.createDataFrame([(int(f),) for f in fps], "fp long"), 4)).collect()}
    got = [root.get(int(f), int(f)) for f in fps]
    want = brute_components(fps, 4)
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want)))


def test_long_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(200)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = ["", None, " \n", "a", "A", "a b c", "a b c d", "A b\tc\nd", "é É x y z"]


def test_documents(spark):
    base = " ".join(f"w{i}" for i in rng.integers(0, 500, 400))
    texts = TEXTS + [base, base + " tail", base.upper(), "Long " * 100_000] + [f"other {i} " * 30 for i in range(10)]
    rows = [(i * 3 % 101, t) for i, t in enumerate(texts)] + [(5, "dup"), (5, "dup"), (None, "dup")]
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, k1 string, fp int")
    got = S.near_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(np.array(fps, np.uint64).view(np.int64), 4)
    least = [min(rows[k][0] for k in range(len(rows)) if label[k] == label[i] and rows[k][0] is not None) for i in range(len(rows))]
    want = sorted(((i, f"{f:016x}", m) for (i, _), f, m in zip(rows, fps, least)), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want

    kept = S.survivors(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({m for m in least})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(docs).count() == 0 and S.survivors(docs).count() == 0


def test_word_blocks():
    data = " ".join(f"w{i}" for i in rng.integers(0, 99, 3000)).encode()
    assert sum(word_blocks(data, size=50), []) == data.split()
    assert sum(word_blocks(b"a" * 10_000 + b" b", size=50), []) == [b"a" * 10_000, b"b"]
    assert sum(word_blocks(b"\n  \t", size=2), []) == []
