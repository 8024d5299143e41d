from ripple.llm import cotrain


def test_held_out_accuracy(spark):
    """Train on the labels of even ids, judge by those of odd ids."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = cotrain.quality_scores(docs, labels.where("doc_id % 2 = 0"))
    seen = got.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    right = seen.kept == (seen.quality == 1)
    assert got.count() == docs.count()
    assert right.mean() > 0.97 and right[seen.quality == 1].mean() > 0.99 and right[seen.quality == 0].mean() > 0.8
    assert ((seen.words_score > 0.5) == (seen.quality == 1)).mean() > 0.93
    assert ((seen.meta_score > 0.5) == (seen.quality == 1)).mean() > 0.93
    assert abs(seen.score.mean() - seen.quality.mean()) < 0.03  # calibrated


def test_edges(spark):
    shape = "doc_id long, text string, lang string, source string, quality int, words string, meta string"
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else "a b c", None, None, 9, "x", "y") for i in range(6)] + [(None, "z " * 50000, "en", "s", 9, "x", "y"), (2, "a b c", "en", "s", 9, "x", "y")]
    docs = spark.createDataFrame(rows, shape)
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = cotrain.quality_scores(docs, labels)
    assert got.count() == 8
    alone = cotrain.quality_scores(docs, labels.where("quality = 1"))
    assert [r.kept for r in alone.collect()] == [True] * 8 and alone.where("score is not null").isEmpty()
    assert cotrain.quality_scores(docs.limit(0), labels).collect() == []
    assert cotrain.good_documents(docs, labels.limit(0)).count() == 8
    many = docs.unionByName(docs)
    assert cotrain.good_documents(many, labels).columns == docs.columns
