import random
import re

import numpy as np
import pytest

from wordloom.llm import substring_dedup as S
from wordloom.llm.words import word_hashes


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k:k + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k:k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def corpus(n=60):
    r = random.Random(3)
    shared = [" ".join(f"p{r.randrange(40)}" for _ in range(20)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(0, 25))) for _ in range(3)]
        rows.append((r.randrange(45), f" {r.choice(shared)}\n".join(parts) + r.choice(["", " ", "\x0b\x0c\r"])))
    return rows + [(2, rows[0][1]), (90, rows[0][1]), (90, rows[0][1]), (None, rows[0][1]), (91, None), (92, ""), (93, "\xa0 é \x1c x"),
                   (94, "run " * 20_000), (95, "run " * 20_000)]


@pytest.mark.parametrize("window, how", [(13, {}), (13, {"group_suffixes": 50, "chunk_bytes": 2000}), (3, {"group_suffixes": 7, "chunk_bytes": 300})])
def test_brute_force(spark, window, how):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, chunk int, kept string").repartition(4)
    got = S.remove_repeats(docs, window=window, **how)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=repr) == brute(rows, window)


def test_spans_are_what_went(spark):
    rows = corpus(20)
    for r in S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
        assert all(s["end"] - s["start"] >= 13 for s in r["spans"])


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_hold_a_prefix_each_and_fit():
    counts = np.zeros(1 << 16, np.int64)
    counts[[0, 5, 300, 301, 302, 65_535]] = [5, 5, 90, 90, 500, 1]
    groups = S.prefix_groups(counts, 100)
    held = np.bincount(groups, counts)
    assert groups[0] == groups[5] and len({groups[300], groups[301], groups[302]}) == 3
    assert sorted(held[held > 0])[-1] == 500 and (np.diff(groups) >= 0).all()


def test_hashes_do_not_depend_on_neighbours():
    a, first, *_ = word_hashes([b"x yy  zzz", b"", b"yy x"])
    assert first.tolist() == [0, 3, 3, 5] and a[0] == a[4] and a[1] == a[3] and len(set(a.tolist())) == 3
    long = b"k" * 3_000_000
    b, *_ = word_hashes([b"x " + long + b" x " + long])
    assert b[0] == b[2] == a[0] and b[1] == b[3]


def test_coded_integers():
    values = np.array([0, 1, 2 ** 63, 2 ** 64 - 1, 77], np.uint64)
    assert (S.expand(S.squeeze(values)) == values).all() and len(S.expand(S.squeeze(values[:0]))) == 0
