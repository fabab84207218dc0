import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import packing

TEXTS = ["", None, "one", "one", "a  b\n\n c\t\td  ", "x\x85y\xa0z \x1c\x1d", "don't 's ½² ١٢٣ 中文 😀 <|endoftext|>", "word " * 5000, "é" * 3000]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def check(rows, seq_len):
    """Pieces lie gapless from 0 in their sequences; returns the number of sequences."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= seq_len
    return len(by)


def test_ids_equal_the_tokenizer(spark, tokenizer):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, length string")
    rows = packing.pack(docs, with_ids=True).collect()
    assert check(rows, 1024)
    for i, t in enumerate(TEXTS):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == want
        at = 0
        for k, r in enumerate(mine):
            assert (r["piece"], r["start"], r["length"]) == (k, at, len(r["ids"]))
            assert k == 0 or r["length"] == 1024
            assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
            at += r["length"]
        assert len(mine) == -(-len(want) // 1024)


def test_whole_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(docs).collect()
    tokens = sum(len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert sum(r["length"] for r in rows) == tokens
    assert check(rows, 1024) <= 1.01 * -(-tokens // 1024) + 1


def test_empty_null_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, None), (None, "a"), (3, "a"), (3, "a")], "doc_id long, text string")).collect()
    assert len(rows) == 4 and check(rows, 1024) == 1


def test_many_tasks_share_nothing(spark):
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
                                      (F.pmod(F.xxhash64("id"), F.lit(100)) + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    rows = packing.assign_sequences(pieces, 100, 16, pieces_per_task=500).collect()
    assert len(rows) == 3000
    assert check(rows, 100) <= 1.25 * sum(r["length"] for r in rows) / 100
    rows = packing.assign_sequences(pieces, 100, 1000, pieces_per_task=500).collect()
    assert check(rows, 100) <= 1.03 * sum(r["length"] for r in rows) / 100


def test_open_bins_is_best_fit():
    rng = np.random.default_rng(1)
    for most in (1, 3, 50):
        bins, brute, closed = packing.OpenBins(64, most), {}, set()
        for n in rng.integers(1, 65, 400).tolist():
            sequence, offset = bins.place(n)
            fits = [(64 - used, s) for s, used in brute.items() if 64 - used >= n]
            if fits:
                assert 64 - brute[sequence] == min(f for f, _ in fits) and offset == brute[sequence]
                brute[sequence] += n
            else:
                if len(brute) == most:      # the fullest has closed
                    gone = max(brute, key=brute.get)
                    closed.add(brute.pop(gone))
                assert sequence not in brute and offset == 0
                brute[sequence] = n
            brute = {s: u for s, u in brute.items() if u < 64}
            assert bins.count == len(brute) <= most
            # the same fullness may be either of two bins: keep what the bins hold
            live = {s: 64 - f for f, held in bins.by_free.items() for s in held}
            assert sorted(live.values()) == sorted(brute.values())
            brute = live


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>  b\n", "中文<|endoftext|> 😀 ", "<|endoftext| >", "<<|endoftext|>>",
         "don't <|ENDOFTEXT|> ", "word <|endoftext|>\n\n" * 600]


@pytest.mark.parametrize("name", ["op1_best_fit_packing", "pipeline"])
def test_added_tokens_equal_the_tokenizer_as_loaded(spark, tmp_path, name):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline
    from wordloom.llm import queries
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert t.encode(ADDED[0], add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = [*ADDED, *TEXTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if name == "pipeline":
        rows = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)).collect()
    else:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
    check(rows, 1024)
    mine = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        for s, n in packing.cut(len(ids), 1024):
            want[i, s] = n, zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes())
    assert mine == want
