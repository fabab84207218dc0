import random

import pytest
from pyspark.sql import functions as F

from wordloom.llm import toxicity as X

r = random.Random(11)
BAD = ["idiot", "scum", "moron"]


def corpus(n=240):
    rows = []
    for i in range(n):
        words = [f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}" for _ in range(r.randrange(5, 60))]
        insult, threat = r.random() < 0.3, r.random() < 0.2
        if insult:
            words.insert(r.randrange(len(words)), r.choice(BAD).upper() + ",")
        if threat:
            words.insert(0, f"lowei{r.choice(['ung', 'heit', 'en'])}")
        rows.append((i, " ".join(words), int(insult), int(threat), int(insult or threat)))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_chain_learns_and_scores_all(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0.1) for i, t, *_ in rows], "doc_id long, text string, toxic string, fold double")
    labels = spark.createDataFrame([(i, a, b, c) for i, _, a, b, c in rows if i % 3], "doc_id long, insult int, threat int, toxic int")
    model = X.fit(docs, labels, ["insult", "threat", "toxic"])
    assert len(model["models"]) == 3 and len(model["vocabulary"]) <= X.MAX_FEATURES
    got = X.predict(docs, model)
    assert got.columns == ["doc_id", "text", "fold", "insult_prob", "threat_prob", "toxic_prob", "insult", "threat", "toxic"]
    truth = {x[0]: x[2:] for x in rows}
    unseen = [x for x in got.collect() if x["doc_id"] % 3 == 0]
    for j, c in enumerate(("insult", "threat", "toxic")):
        right = sum(x[c] == bool(truth[x["doc_id"]][j]) for x in unseen)
        assert right >= 0.95 * len(unseen), c
    weights, _ = model["models"][2]
    assert abs(weights[len(model["vocabulary"]):]).sum() > 0        # the earlier probabilities are used


def test_cases(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows] + [(1000, None), (1001, ""), (None, "idiot"), (None, "idiot"), (1002, "idiot " * 300_000)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, a, 0) for i, _, a, *_ in rows] + [(5, None, 0), (None, 1, 0), (99_999, 1, 0), (7, 0, 0)],
                                   "doc_id long, toxic int, never int")
    got = X.predict(docs, X.fit(docs, labels, ["never", "toxic"])).collect()
    assert len(got) == len(rows) + 5
    by = {x["doc_id"]: x for x in got}
    assert by[1002]["toxic"] and not by[1000]["toxic"] and not by[1001]["toxic"] and not any(x["never"] for x in got)
    assert by[1000]["toxic_prob"] == by[1001]["toxic_prob"]


def test_without_labels(spark, rows):
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows[:5]], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    got = X.predict(docs, X.fit(docs, labels, ["toxic"]))
    assert [(x["toxic_prob"], x["toxic"]) for x in got.collect()] == [(None, False)] * 5
    assert X.predict(docs.limit(0), X.fit(docs, labels, ["toxic"])).count() == 0


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = X.fit(docs, labels.filter("doc_id % 4 != 1"), ["toxic"])
    got = X.predict(docs.select("doc_id", "text"), model).join(
        labels.filter("doc_id % 4 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    assert sum(x["toxic"] == bool(x["y"]) for x in got) >= 0.9 * len(got)


def test_features_of_a_word():
    assert X.word_features("abc") == ["<abc>", "<abc", "abc>"] and "<abcde" in X.word_features("abcdef")
    f = X.Features(["<abc>", "abc>"])
    assert f.text("ABC, abc 1") == {0, 1} and f.text(None) == set()
