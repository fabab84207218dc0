import itertools
import random

import numpy as np
import pytest

from wordloom.llm import decontaminate as D

r = random.Random(5)
ITEMS = [" ".join(f"b{r.randrange(400)}" for _ in range(n)) for n in (40, 60, 13, 6, 25)]


def filler(n):
    return " ".join(f"f{r.randrange(900)}" for _ in range(n))


def swapped(text, share):
    words = text.split()
    for k in r.sample(range(len(words)), int(len(words) * share)):
        words[k] = f"z{k}"
    return " ".join(words)


def brute(doc, item, min_words=13, identity=0.8):
    """Is there a stretch of aligned words that passes?  All alignments, all stretches."""
    d, b = ([w for x in D.normalised([t]) for w in x.split()] for t in (doc, item))
    for shift in range(-len(b) + 1, len(d)):
        equal = [b[k] == d[k + shift] for k in range(len(b)) if 0 <= k + shift < len(d)]
        if len(b) < min_words:
            if b and len(equal) == len(b) and all(equal):
                return True
            continue
        for s in range(len(equal)):
            for e in range(s + min_words, len(equal) + 1):
                if sum(equal[s:e]) >= identity * (e - s) - 1e-9:
                    return True
    return False


DOCS = [filler(50) + " " + ITEMS[0] + " " + filler(20), filler(5) + "\n" + swapped(ITEMS[1], 0.1) + ". " + filler(9), filler(300),
        swapped(ITEMS[0], 0.5), ITEMS[2].upper().replace(" ", ", ") + "!", filler(4) + " " + ITEMS[3], " ".join(ITEMS[3].split()[:5]),
        " ".join(ITEMS[4].split()[3:18]) + " " + filler(30), " ".join(ITEMS[4].split()[3:12]) + " " + filler(30), "", None, "the", ITEMS[0] + " " + ITEMS[1],
        swapped(ITEMS[1], 0.18)]


@pytest.mark.parametrize("block", [1 << 20, 200])
def test_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in enumerate(DOCS)], "doc_id long, text string, item_id string, words int").repartition(3)
    items = spark.createDataFrame([*enumerate(ITEMS), (9, None), (10, ""), (None, ITEMS[2])], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in D.find(docs, items).collect()}
    want = {(i, j) for i, d in enumerate(DOCS) for j, t in [*enumerate(ITEMS), (None, ITEMS[2])] if d and brute(d, t)}
    assert got == want
    kept = D.clean(docs, items)
    assert kept.columns == docs.columns
    assert {x["doc_id"] for x in kept.collect()} == set(range(len(DOCS))) - {i for i, _ in want}


def test_stretch_is_where_it_says(spark):
    docs = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    for x in D.find(docs, items).collect():
        d, b = ([w for t in D.normalised([s]) for w in t.split()] for s in (DOCS[x["doc_id"]], ITEMS[x["item_id"]]))
        same = sum(d[x["doc_start"] + k] == b[x["item_start"] + k] for k in range(x["words"]))
        assert same == x["matches"] >= 0.8 * x["words"]


def test_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, ITEMS[0]), (1, ITEMS[0]), (1, "clean text"), (None, ITEMS[0]), (None, "n")], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    assert [tuple(x) for x in sorted(D.clean(docs, items).collect(), key=repr)] == [(1, "clean text"), (None, "n")]
    assert D.find(docs, items.limit(0)).count() == 0 and D.clean(docs, items.limit(0)).count() == 5
    assert D.find(docs.limit(0), items).count() == 0


def test_seeds_ignore_their_gaps():
    for i, mask in enumerate(D.MASKS):
        words = np.arange(1, len(mask) + 1).astype(np.uint64)
        changed = words.copy()
        changed[[k for k, c in enumerate(mask) if c == "0"]] = 99
        assert (D.seed_hashes(words, mask, i) == D.seed_hashes(changed, mask, i)).all()
        changed[mask.index("1")] = 99
        assert (D.seed_hashes(words, mask, i) != D.seed_hashes(changed, mask, i)).all()


def test_masks_find_every_stretch():
    """All ways to substitute a fifth of 13 to 20 words."""
    for n in range(13, 21):
        for gone in itertools.combinations(range(n), n // 5):
            equal = ["0" if k in gone else "1" for k in range(n)]
            assert any(all(equal[k + j] == "1" for j, c in enumerate(m) if c == "1") for m in D.MASKS for k in range(n - len(m) + 1)), gone


def test_longest_stretch_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(300):
        equal = rng.random(rng.integers(0, 25)) < 0.7
        s, e = D.longest_stretch(equal, 0.8)
        spans = [(y - x, -x) for x in range(len(equal) + 1) for y in range(x, len(equal) + 1) if equal[x:y].sum() >= 0.8 * (y - x) - 1e-9]
        assert e - s == max(spans)[0] and equal[s:e].sum() >= 0.8 * (e - s) - 1e-9


def test_every_document_that_quotes_an_item_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    quoted = {d["doc_id"] for d in docs.collect() for b in items.collect() if b["text"] in d["text"]}
    assert quoted and quoted <= {x["doc_id"] for x in D.find(docs, items).collect()}


@pytest.mark.parametrize("kind", ["int", "string", "decimal(5,1)"])
def test_item_ids_of_any_type(spark, kind):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, "x " + text), (2, "y")], "doc_id long, text string")
    items = spark.createDataFrame([("7", text)], "item_id string, text string").selectExpr(f"cast(item_id as {kind}) item_id", "text")
    found = D.find(docs, items)
    assert dict(found.dtypes)["item_id"] == kind and [str(float(r["item_id"])) for r in found.collect()] == ["7.0"]
