import numpy as np
from pyspark.sql import functions as F

from cartlens.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    scores = quality.op1_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").filter("held_out and quality is not null")
    right = scores.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")), F.count("*")).head()
    assert right[1] > 50 and right[0] >= 0.95


def test_fold_is_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(F.expr("crc32(cast(doc_id as string)) % 3 = 1"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(docs, labels), quality.train(docs, wrong)
    assert a.bias == b.bias and np.array_equal(a.weights, b.weights)


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "word " * 50000, "x"), (3, "word " * 50000, "x"), (None, "!!! ???", "x"), (4, "é", None)],
                                 "doc_id long, text string, Score string")
    model = quality.Model(10, 0.3, np.linspace(-1, 1, 1024))
    got = quality.with_score(docs, model)
    assert got.columns == ["doc_id", "text", "score"] and got.count() == 6
    by = {(r.doc_id, r.text): r.score for r in got.collect()}
    assert by[1, None] == by[2, ""] == 1 / (1 + np.exp(-0.3)) and all(0 <= s <= 1 for s in by.values())
    assert quality.with_score(docs.limit(0), model).count() == 0


def test_without_labels_all_are_even(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, none)
    assert [r.score for r in quality.with_score(docs, model).collect()] == [0.5, 0.5]


def test_row_features_do_not_depend_on_neighbours():
    texts = [b"", b"One two, two three!", b"", "ÑU ñu 12ab".encode(), b"Zz"]
    bounds = np.cumsum([0, *map(len, texts)])
    model = quality.Model(12, -0.1, np.random.default_rng(0).standard_normal(4096))
    together = model.score(np.frombuffer(b"".join(texts), np.uint8), bounds)
    alone = [model.score(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone)


def test_sample_bound_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "$$$ %%% ###") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] * 2, "doc_id long, quality int")
    model = quality.train(docs, labels, max_rows=100)
    got = quality.with_score(docs, model).collect()
    assert all((r.score >= 0.5) == bool(r.doc_id % 2) for r in got)


def test_one_labelled_id_on_many_rows_is_bounded(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("if(id < 2000, 5, id) AS doc_id", "concat('good text number ', id) AS text")
    labels = spark.createDataFrame([(5, 1)] + [(i, i % 2) for i in range(2000, 2040)], "doc_id long, quality int")
    seen = spark.sparkContext.accumulator(0)
    plain = quality._ftrl

    def counted(rows, *args):
        seen.add(len(rows))
        return plain(rows, *args)

    monkeypatch.setattr(quality, "_ftrl", counted)
    quality.train(docs, labels, max_rows=100, learn="true")
    assert 50 <= seen.value <= 200
    seen.value = 0
    quality.train(docs.filter("doc_id = 5").limit(1).crossJoin(spark.range(500)).select("doc_id", "text"), labels, max_rows=100, learn="true")
    assert seen.value <= 1      # equal rows count once
