import random

import duckdb


import brute
from ripple.llm import hamming


def expected(rows, size, percent):
    sets = {i: brute.shingles(t, size) for i, t in rows}
    root = brute.roots(sets, brute.near_links(sets, percent))
    return {(i, len(sets[i]), root[i], root[i] == i) for i in sets}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, n_shingles int, component_id string")


def test_given_documents(spark):
    d = "/root/testdata/sf0.01/documents.parquet"
    got = {tuple(r) for r in hamming.op5_minhash_hamming(spark, "/root/testdata/sf0.01").collect()}
    assert got == expected(duckdb.sql(f"select doc_id, text from '{d}'").fetchall(), 3, 85)


def test_a_large_family_around_one_text(spark, monkeypatch):
    """Copies that link with the original and not with each other, chains, in several blocks."""
    monkeypatch.setattr(hamming, "BLOCK", 16)
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(500, " ".join(base))]
    for i in range(150):
        w = list(base)
        for k in r.sample(range(120), r.randint(1, 5)):
            w[k] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    w = list(base)
    for i in range(60):
        w[i] = f"y{i}"
        rows.append((1000 + i, " ".join(w)))
    got = {tuple(x) for x in hamming.near_duplicates(frame(spark, rows), size=3, percent=85).collect()}
    assert got == expected(rows, 3, 85)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"), (7, "z " * 30000), (8, "z " * 20000), (9, "a b c d e f g"), (10, "a b c d e f g")]
    got = {tuple(x) for x in hamming.near_duplicates(frame(spark, rows), size=3, percent=85).collect()}
    assert got == expected(rows, 3, 85)
    twice = hamming.near_duplicates(frame(spark, [(5, "p q r s"), (5, "p q r s"), (5, "k l m n"), (None, "p q r s"), (6, "K l m N")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in twice) == [("5", "5", True)] * 3 + [("6", "5", False), ("None", "None", True)]
    assert hamming.near_duplicates(frame(spark, [])).collect() == []


def test_exploded_keys_are_not_collected_for_a_broadcast(spark, tmp_path):
    """A signature has fifty keys, which Spark takes for one row: at this size it would broadcast them all."""
    rows = [(i, bytes([i % 7]) * (2 * hamming.N)) for i in range(40)]
    spark.createDataFrame(rows, "cls long, sig binary").write.parquet(str(tmp_path / "classes"))
    members = hamming._members(spark.read.parquet(str(tmp_path / "classes")))
    members.collect()
    plan = members._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {tuple(r) for r in members.groupBy("cls").count().collect()} == {(i, hamming.N) for i in range(40)}
