import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import language_id as L
from wordloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return L.train(docs.filter(~L.held_out()))


def test_held_out_accuracy(spark):
    got = Q.QUERIES["op9_language_id"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    import zlib
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    out = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert np.mean(out) > 0.98


def test_mixed_text_has_spans(spark, model):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("n_chars between 800 and 1200").collect()}
    parts = [docs[x] for x in ("en", "de", "fr", "es")]
    text = "\n".join(parts)
    [row] = L.identify(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).collect()
    edges = list(itertools.accumulate((len(p) + 1 for p in parts), initial=0))
    for lang, a, b in zip(("en", "de", "fr", "es"), edges, edges[1:]):
        inside = sum(min(s["end"], b) - max(s["start"], a) for s in row["spans"] if s["lang"] == lang and s["start"] < b and s["end"] > a)
        assert inside > 0.8 * (b - a)


CASES = ["½ ² ① Ⅷ ⅷ ٣ 〇", "हिन्दी भाषा में लिखा", "é́", "\u0301", None, "", "  \n", "12 34 !!", "İİ the and of", "the " * 200_000, "日本語のテキスト", "und der die"]


def test_cases(spark, model):
    docs = spark.createDataFrame([(i, t, "x", 0.5, 1) for i, t in enumerate(CASES)] + [(None, "the and of the", "x", 0.5, 2)] * 2,
                                 "doc_id long, text string, lang_pred string, score double, `__x` int")
    got = L.identify(docs, model)
    assert got.columns == ["doc_id", "text", "__x", "lang_pred", "score", "spans"]
    rows = got.collect()
    for r in rows:
        letters = any(unicodedata.category(c)[0] == "L" for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1 and bool(r["spans"]) == letters
        assert (r["score"] > 0) == letters
    assert [r["lang_pred"] for r in rows if r["doc_id"] in (8, 9, None)] == ["en"] * 4


def test_words_keep_their_marks():
    for beyond in ("", " 😀 𝒜b"):       # with and without characters beyond the basic plane
        text = "हिन्दी, भाषा½x²y 3é\u0301z" + beyond
        assert L.word_pattern(text).findall(text) == ["हिन्दी", "भाषा", "x", "y", "é\u0301z"] + ["𝒜b"] * bool(beyond)


def test_other_names(spark, model):
    docs = spark.createDataFrame([(1, "the and of", 7.5, "mine")], "doc_id long, text string, score double, lang_pred string")
    [r] = L.identify(docs, model, spans=False, added=("a", "b", "c")).collect()
    assert r.asDict() == {"doc_id": 1, "text": "the and of", "score": 7.5, "lang_pred": "mine", "a": "en", "b": 1.0}


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([(1, None, "en"), (2, "text", None)], "doc_id long, text string, lang string")
    model = L.train(none)
    assert model["langs"] == []
    assert {r["lang_pred"] for r in L.identify(none, model).collect()} == {"und"}
    assert L.identify(none.limit(0), model).count() == 0


def test_lang_and_source_are_no_inputs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = L.train(docs)
    plain = L.identify(docs, model, spans=False).select("doc_id", "lang_pred", "score").collect()
    turned = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    assert sorted(plain) == sorted(L.identify(turned, model, spans=False).select("doc_id", "lang_pred", "score").collect())


def brute_viterbi(scores, switch):
    best = (-np.inf, None)
    for path in itertools.product(range(scores.shape[1]), repeat=len(scores)):
        s = sum(scores[i, p] for i, p in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))
        if s > best[0] + 1e-9:
            best = (s, path)
    return best


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(2)
    for switch in (0.0, 1.5, 8.0):
        counts = np.array([4, 0, 1, 6, 3])
        starts = np.concatenate(([0], np.cumsum(counts)))[:-1]
        scores = rng.normal(0, 2, (counts.sum(), 3)).astype(np.float32)
        got = L.viterbi(scores, starts, counts, switch)
        for a, n in zip(starts, counts):
            if n:
                s, path = brute_viterbi(scores[a:a + n].astype(float), switch)
                mine = got[a:a + n]
                value = sum(scores[a + i, p] for i, p in enumerate(mine)) - switch * sum(x != y for x, y in zip(mine, mine[1:]))
                assert abs(value - s) < 1e-4


def test_trigrams_and_scripts():
    words = ["the", "a", "über"]
    bucket, owner = L.trigrams(words)
    assert np.bincount(owner).tolist() == [3, 1, 4]
    again, _ = L.trigrams(random.sample(words, 3))
    assert sorted(bucket) == sorted(again)
    assert [L.NAMES[L.script_of(w)] for w in ("the", "über", "слово", "日本", "ไทย", "ꬰ")] == ["Latin", "Latin", "Cyrillic", "Han", "Thai", "Other"]


@pytest.mark.parametrize("n", [4, 127, 128, 129, 200, 255, 256, 300])
def test_labels_of_many_languages(n):
    scores = np.full((2 * n, n), -50, np.float32)
    scores[np.arange(2 * n), np.arange(2 * n) // 2] = 0       # two words of each language
    got = L.viterbi(scores, np.array([0, n]), np.array([n, n]))
    assert got.tolist() == (np.arange(2 * n) // 2).tolist()


def test_more_languages_than_a_byte_has(spark):
    words = ["".join(chr(97 + (i * 7 + k * (i // 26 + 1)) % 26) for k in range(12)) + chr(97 + i // 26) * 3 for i in range(200)]
    rows = [(i, f"l{i:03}", (w + " ") * 20) for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = L.identify(docs, L.train(docs)).select("lang", "lang_pred", "score", "spans").collect()
    assert len(got) == 200 and all(r["lang"] == r["lang_pred"] and r["score"] == 1 and len(r["spans"]) == 1 for r in got)
