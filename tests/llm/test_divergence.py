import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wordloom.llm import divergence, terms

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_docs):
    counts, docs, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall(lower(text or ""))
        sources[lang].add(source)
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, own in sources.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= min_docs)
        whole = Counter()
        for s in own:
            whole.update(counts[lang, s])

        def share(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in own}, share(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in own if o != s]
            best = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", best, 10)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(items, 1)]
    return sorted(out)


def rows(seed=0, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "THE", "eightchr", "ninechars", "sixteencharacter", "seventeencharactr", "seventeencharacts", "é", "éé" * 9, "naïve", "x" * 40,
                  "a", "b", "ab", "語" * 5, "languages"] + [f"w{c}" for c in "abcdefghijklmnop"]
    seps = [" ", "-", "1", "\n", "\x00", "\x7f", "_"]
    out = []
    for i in range(n):
        words = [vocabulary[k] for k in rng.zipf(1.3, rng.integers(0, 40)) % len(vocabulary)]
        text = "".join(w + seps[int(rng.integers(len(seps)))] for w in words)
        out.append((["en", "de", None][int(rng.integers(3))], ["s1", "s2", "é", None, "s10"][int(rng.zipf(1.6)) % 5], text))
    return out + [("en", "silent", None), ("en", "silent", ""), ("lonely", "one", "the the"), ("void", "a", "1 2"), ("void", "b", None)] + out[:7]


@pytest.mark.parametrize("min_docs", [10, 2, 1000])
def test_brute_force(spark, monkeypatch, min_docs):
    data = rows(min_docs)
    docs = spark.createDataFrame([(*r, 1, 2) for r in data], "lang string, source string, text string, rank int, n int").repartition(5)
    assert sorted(map(tuple, divergence.audit(docs, min_docs).collect())) == brute(data, min_docs)


def test_small_bounds(spark, monkeypatch):
    """Counts handed on early, many blocks per language, few cells at a time: the same rows."""
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "BLOCK_ROWS", 7)
    monkeypatch.setattr(divergence, "CELLS", 11)
    data = rows(5, 200)
    docs = spark.createDataFrame(data, "lang string, source string, text string").repartition(3)
    assert sorted(map(tuple, divergence.audit(docs, 3).collect())) == brute(data, 3)


def test_cases(spark):
    schema = "lang string, source string, text string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    long = "word " * 400_000 + "y" * 3_000_000
    data = [("en", "a", long), ("en", "b", long)] * 5 + [("en", "a", "other")] * 10
    got = sorted(map(tuple, divergence.audit(spark.createDataFrame(data, schema)).collect()))
    assert got == brute(data, 10)


def test_share_is_exact_beyond_64_bits():
    for count, total, kept in [(10**12, 10**13, 5), (0, 0, 1), (7, 9 * 10**14, 10**6), (3, 10, 4)]:
        want = 1 + 10**9 * (count + 2) // (total + 2 * kept)
        assert divergence.share(np.array([count]), total, kept)[0] == want


def test_radix_order_and_packing():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(1, 256, rng.integers(1, 17)).astype(np.uint8)) for _ in range(500)]
    low = np.frombuffer(b"".join(words) + bytes(terms.PAD), np.uint8)
    n = np.array([len(w) for w in words])
    keys = [terms.packed(low, np.cumsum(n) - n, n, at) for at in (0, 8)]
    assert terms.unpacked(keys).tolist() == words
    assert [words[i] for i in terms.radix_order(keys[::-1])] == sorted(words)
