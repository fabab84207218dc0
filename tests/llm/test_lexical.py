import math
import re
from collections import Counter

import numpy as np
import pytest

from wordloom.llm import lexical

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def found(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    docs = [(i, Counter(found(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    N, L = len(docs), sum(n for _, _, n in docs)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(found(t))
    out = []
    for item, own in queries.items():
        w = {t: math.floor(1000 * math.log((2 * N + 2) / (2 * sum(t in c for _, c, _ in docs) + 1))) for t in own}
        scores = []
        for i, c, n in docs:
            m = 100 - 50 + 50 * n * N // L
            score = sum(w[t] * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scores.append((i, score))
        scores.sort(key=lambda x: (-x[1], x[0] is not None, x[0] or 0))
        out += [(item, r, i, s) for r, (i, s) in enumerate(scores[:top], 1)]
    return sorted(out, key=repr)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    words = ["the", "Eightchr", "ninechars", "ninecharz", "ninechars2", "sixteencharacter", "seventeencharactr", "seventeencharacts", "é", "éé" * 9,
             "naïve", "x" * 40, "12", "a1", "語" * 5] + [f"w{i}" for i in range(60)]
    text = lambda n: "".join(words[k] + " -_\n\x7f"[int(rng.integers(5))] for k in rng.zipf(1.2, n) % len(words))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(150)]
    docs += [(500 - i, docs[3][1]) for i in range(70)] + [(None, docs[3][1]), (9, docs[3][1]), (900, None), (901, ""), (902, "?!")]
    shared = [text(8) for _ in range(3)]
    items = [(i, text(int(rng.integers(0, 9))) + " " + shared[i % 3] + shared[(i + 1) % 3] * (i % 2)) for i in range(14)]
    return docs, items + [(3, "x1 w3 the"), (None, "the w1"), (77, None), (78, "nowhere"), (79, "the the THE")]


@pytest.mark.parametrize("top, cells, block", [(50, 1 << 21, 512), (5, 300, 4)])
def test_brute_force(spark, monkeypatch, top, cells, block):
    """Also with few accumulators at a time and the queries in several blocks."""
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", block)
    docs, items = corpus(top)
    d = spark.createDataFrame([(*r, 1, "r") for r in docs], "doc_id long, text string, n int, rank string").repartition(4)
    q = spark.createDataFrame([(*r, "z") for r in items], "item_id long, text string, doc_id string")
    got = sorted(map(tuple, lexical.search(d, q, top).collect()), key=repr)
    assert got == brute(docs, items, top)


def test_cases(spark):
    docs, items = "doc_id long, text string", "item_id string, text string"
    none, some = spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b"), (2, "b " * 300_000)], docs)
    assert lexical.search(none, spark.createDataFrame([("x", "a")], items)).collect() == []
    assert lexical.search(some, spark.createDataFrame([], items)).collect() == []
    got = lexical.search(some, spark.createDataFrame([("x", "A"), ("y", "b")], items)).collect()
    assert sorted(map(tuple, got)) == brute([(1, "a b"), (2, "b " * 300_000)], [("x", "A"), ("y", "b")], 50)


def test_graph_computes_every_query_once():
    rng = np.random.default_rng(2)
    common = [set(rng.choice(200, 12, replace=False).tolist()) for _ in range(5)]
    queries = [set(rng.choice(200, 6, replace=False).tolist()) | common[i % 5] | common[(i * 3 + 1) % 5] for i in range(40)] + [set(), {4}]
    nodes, ends = lexical.share_terms(queries, 200)
    covered = [Counter({t: 1}) for t in range(200)]
    for parts in nodes:
        assert max(parts) < len(covered)       # parts stand before the node
        covered.append(sum((covered[p] for p in parts), Counter()))
    for query, end in zip(queries, ends):
        assert (covered[end] if end >= 0 else Counter()) == Counter(query)      # every term exactly once
    assert sum(map(len, nodes)) < 0.8 * sum(map(len, queries))                  # shared sums are computed once
