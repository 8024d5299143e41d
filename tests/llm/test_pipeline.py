"""The stages on given documents, each against its own brute-force version on its own input."""

import duckdb

import brute
import corpus_pipeline
from ripple.llm.common import table

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs.toPandas())
        if name != "tokens":
            assert docs.columns == columns
    before, after = seen["quality"]
    labels = table(spark, SF, "labels").toPandas().set_index("doc_id").quality
    kept = set(after.doc_id)
    good = [i for i in before.doc_id if labels.get(i) == 1]
    bad = [i for i in before.doc_id if labels.get(i) == 0]
    assert sum(i in kept for i in good) >= 0.99 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)
    before, after = seen["near_duplicates"]
    sets = {i: brute.shingles(t, 5) for i, t in zip(before.doc_id, before.text)}
    root = brute.roots(sets, brute.near_links(sets, 80))
    assert set(after.doc_id) == {i for i in sets if root[i] == i}
    before, after = seen["decontamination"]
    items = [brute.shingles(t, 5) for (t,) in duckdb.sql(f"select text from '{SF}/benchmark.parquet'").fetchall()]
    dirty = {i for i, t in zip(before.doc_id, before.text) for own in [brute.shingles(t, 5)] if any(len(own & s) >= 0.8 * len(s) for s in items)}
    assert dirty and set(after.doc_id) == set(before.doc_id) - dirty
    before, after = seen["mixing"]
    count = lambda frame: sum(len(brute.WORD.findall(t)) for t in frame.text)
    assert count(after) == count(before) * 3 // 5 and set(after.doc_id) <= set(before.doc_id)
    before, after = seen["tokens"]
    assert sorted(after.doc_id) == sorted(before.doc_id)
    after = after.sort_values("start")
    assert after.doc_id.is_monotonic_increasing and (after.start.shift(-1).dropna() == (after.start + after.n_tokens)[:-1]).all()


def test_edges(spark):
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", None, "s", 0), (2, "a b c d e f", "en", None, 11), (2, "a b c d e f", "en", None, 11), (3, "z " * 40000, "en", "src0", 80000)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        stage(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()) == ["1", "2", "2", "3", "None"]
