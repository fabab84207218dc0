from pyspark.sql import functions as F

from wordloom.sources import readers as S
from wordloom.sources import writers as K


def write_lines(spark, path, lines):
    spark.createDataFrame([(l,) for l in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


LINES = [
    "Filename,Prompt,NL,Text",
    '1.txt,P1,GER,"Hello, world ""quoted"" end"',
    '2.txt,P2,FRE,"He said,"no" then"',
]


def test_three_parsers_disagree(spark, tmp_out):
    # trap 1: the same lines give different texts through the three readers
    p = tmp_out("corpus")
    write_lines(spark, p, LINES)
    s1 = {r.id: r.text for r in S.read_corpus(spark, p).collect()}
    s2 = {r.id: r.text for r in S.read_corpus_quoted(spark, p).collect()}
    assert s1 == {"1.txt": 'Hello, world ""quoted"" end', "2.txt": 'He said,"no" then'}
    assert s2["1.txt"] == 'hello, world ""quoted"" end'
    assert s2["2.txt"] == "he sai"           # a ,\" inside the text truncates it, then one more character goes
    s3 = [r.text for r in S.read_label_slice(spark, p, "GER").collect()]
    assert s3 == ["hello, world "]           # text up to the first inner quote


def test_header_detected_by_content(spark, tmp_out):
    # trap 13: the header is dropped wherever it is
    p = tmp_out("corpus2")
    write_lines(spark, p, [LINES[1], LINES[0], LINES[2]])
    assert S.read_corpus(spark, p).count() == 2


def test_corpus_round_trip_keeps_commas(spark, tmp_out):
    df = spark.createDataFrame([("7.txt", "p", "SPA", 'a, b\nc "d"')], "id string, prompt string, label string, text string")
    p = tmp_out("rt")
    K.write_corpus(df, p)
    assert [r.text for r in S.read_corpus(spark, p).collect()] == ['a, b c "d']
    K.write_corpus(df, p, quote_to_apostrophe=True)
    assert [r.text for r in S.read_corpus(spark, p).collect()] == ["a, b c 'd'"]


def test_dense_csv_round_trip(spark, tmp_out):
    df = spark.createDataFrame([(i, i % 3, [float(i), 0.5, -1.25]) for i in range(20)],
                               "id long, label_code int, features array<double>")
    p = tmp_out("dense")
    K.write_dense_csv(df, p, order=("id",))
    raw = spark.read.text(p).first()[0]
    assert raw.endswith(",")                 # trailing comma of the format
    back = S.read_dense_csv(spark, p).orderBy("line").collect()
    assert [r.label for r in back] == [i % 3 for i in range(20)]
    assert [r.features for r in back] == [[float(i), 0.5, -1.25] for i in range(20)]


def test_libsvm_round_trip(spark, tmp_out):
    from pyspark.ml.functions import vector_to_array
    df = spark.createDataFrame([(1, [0.0, 2.0, 0.0]), (2, [1.5, 0.0, 3.0])], "label_code int, features array<double>")
    p = tmp_out("svm")
    K.write_libsvm(df, p)
    back = S.read_libsvm(spark, p, 3).select("label", vector_to_array("features").alias("f")).orderBy("label").collect()
    assert [(r.label, r.f) for r in back] == [(1.0, [0.0, 2.0, 0.0]), (2.0, [1.5, 0.0, 3.0])]


def test_positional_join_and_line_numbers(spark, tmp_out):
    t, l = tmp_out("t"), tmp_out("l")
    write_lines(spark, t, [f"text {i}" for i in range(50)])
    write_lines(spark, l, [f" LAB{i} " for i in range(50)])
    rows = S.positional_join(spark, t, l).orderBy("line").collect()
    assert [(r.line, r.text, r.label) for r in rows] == [(i, f"text {i}", f"lab{i}") for i in range(50)]


def test_context_embeddings_round_trip(spark, tmp_out):
    v = spark.createDataFrame([(o, w, [float(o), 1.0]) for o in (-1, 1) for w in ("a", "b")],
                              "offset int, word string, embedding array<double>")
    p = tmp_out("ctx")
    K.write_context_embeddings(v, p)
    back = S.read_context_embeddings(spark, p, 4, 2).orderBy("offset", "word").collect()
    assert [(r.offset, r.word, r.embedding) for r in back] == [(-1, "a", [-1.0, 1.0]), (-1, "b", [-1.0, 1.0]),
                                                              (1, "a", [1.0, 1.0]), (1, "b", [1.0, 1.0])]


def test_per_label_partition_pruned(spark, tmp_out):
    df = spark.createDataFrame([("A", "X y"), ("B", "Z")], "label string, text string")
    p = tmp_out("per_label")
    K.write_per_label(df, p)
    q = spark.read.text(p).filter(F.col("label") == "A")
    assert "PartitionFilters: [isnotnull(label" in q._jdf.queryExecution().executedPlan().toString()
    assert [r.value for r in q.collect()] == ["x y"]


def test_line_numbers_across_many_splits_and_files(spark, tmp_out):
    p = tmp_out("many")
    spark.createDataFrame([(f"line {i:05d}",) for i in range(3000)], "value string") \
        .repartitionByRange(3, "value").write.mode("overwrite").text(p)   # 3 files, in order
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")        # many splits per file
    try:
        lines = spark.read.text(p)
        assert lines.rdd.getNumPartitions() > 6
        rows = S.line_numbers(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line, r.value) for r in rows) == [(i, f"line {i:05d}") for i in range(3000)]
