"""The pipeline's stages against brute-force versions, each on its own input."""
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from wordloom.llm import decontaminate, language_id
from wordloom.operators.ranking import materialize

from test_decontaminate import brute as quotes
from test_packing import check
from test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ODD = [(10_000, None, None, None, None), (10_001, "", "en", "s", 0), (10_002, "12 %% 34", "en", "s", 8), (None, "the and of the this is", "en", None, 3)]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD, docs.schema)).unionByName(docs.limit(3))
    out = [docs]
    for name, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], SF), "stage"))
    return [x.collect() for x in out]


def test_names():
    assert [n for n, _ in P.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_language(spark, steps):
    before, after = steps[:2]
    assert not {10_000, 10_001, 10_002} & {r["doc_id"] for r in after}
    lost = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert all(not language_id.WORD.search(r["text"] or "") for r in before if r["doc_id"] in lost)
    assert list(after[0].asDict()) == COLUMNS


def test_copies(steps):
    before, after = steps[1:3]
    best = {}
    for r in before:
        best[r["text"]] = max(best.get(r["text"], (False, 0)), (r["doc_id"] is not None, r["doc_id"] or 0))
    assert sorted((r["text"], (r["doc_id"] is not None, r["doc_id"] or 0)) for r in after) == sorted(best.items())
    assert {tuple(r) for r in after} <= {tuple(r) for r in before}


def test_near_copies(steps):
    before, after = steps[2:4]
    fps = np.array([brute_fingerprint(r["text"]) for r in before], np.uint64).view(np.int64)
    group = {}
    for r, label in zip(before, brute_components(fps, 4)):
        group.setdefault(label, []).append((r["doc_id"] is None, r["doc_id"] or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in after) == sorted(min(g) for g in group.values())


def test_contaminated(spark, steps):
    before, after = steps[3:5]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r["doc_id"] for r in after}
    seeds = decontaminate.Seeds(list(range(len(items))), decontaminate.normalised(items), 13)
    for r in before:
        literal = any(b in r["text"] for b in items)
        if r["doc_id"] not in kept:
            assert literal or any(quotes(r["text"], b) for b in items)
        else:
            assert not literal
    assert len(seeds.hash) and len(kept) == len(after)


def test_packed(steps):
    before, after = steps[4:6]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    assert check(after, 1024) <= 1.1 * sum(r["length"] for r in after) / 1024 + 2


def test_run_and_registration(spark, steps):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is P.run
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in entry.queries()}
    rows = P.run(spark, SF).collect()
    assert check(rows, 1024)
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        empty = materialize(stage(spark, empty, SF), "empty")
        assert empty.count() == 0


def test_columns_of_the_user_survive(spark):
    """Columns under the names that operators use, in any stage that returns the columns of its input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).withColumns(
        {c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("score", "lang_pred", "spans", "h", "fp", "__k1", "keep", "language")})
    given = {r["doc_id"]: r for r in docs.collect()}
    for _, stage in P.STAGES[:-1]:
        docs = materialize(stage(spark, docs, SF), "stage")
        rows = docs.collect()
        assert rows and all(r == given[r["doc_id"]] for r in rows)
