import duckdb
from pyspark.sql import functions as F

from ripple.llm import sharding


def shards(frame, limit):
    return frame, [tuple(r) for r in sharding.extendible_shards(frame, "doc_id", F.octet_length("text"), limit).collect()]


def test_given_documents_and_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = sharding.op4_extendible_sharding(spark, d)
    cols = ["doc_id", "depth", "shard", "n_bytes", "shard_bytes", "shard_rows"]
    assert sorted(tuple(r) for r in got.select(*cols).collect()) == sorted(c.execute(f"SELECT {', '.join(cols)} FROM ({sharding.OP4_SQL})").fetchall())


def test_every_shard_fits(spark):
    """Nulls, empty texts, a hot key, equal rows and rows beyond the limit; every row has one shard that fits or holds it alone."""
    rows = [(i, "x" * (i % 90)) for i in range(400)] + [(7, "hot" * n) for n in range(60)] + [(9, "same row")] * 200 + [(None, "n"), (None, None), (11, None), (12, "y" * 5000)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, shard string")
    _, got = shards(frame, 300)
    assert sorted((str(r[0]), r[3]) for r in got) == sorted((str(k), len(t or "")) for k, t in rows)
    by = {}
    for r in got:
        by.setdefault(r[1:3], []).append(r)
    for rs in by.values():
        assert len(rs) == rs[0][5] and sum(r[3] for r in rs) == rs[0][4]
        assert rs[0][4] <= 300 or len(rs) == 1
    assert shards(frame.where("false"), 300)[1] == []


def test_written_folders(spark, tmp_path):
    frame = spark.createDataFrame([(i, "t" * i) for i in range(60)], "doc_id long, text string")
    out = sharding.extendible_shards(frame, "doc_id", F.octet_length("text"), 200)
    sharding.write_shards(frame, out, "doc_id", str(tmp_path / "out"))
    sizes = [sum(r.n_bytes for r in out.collect() if (r.depth, r.shard) == s) for s in {(r.depth, r.shard) for r in out.collect()}]
    assert max(sizes) <= 200
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(i, "t" * i) for i in range(60)]
    assert len(list((tmp_path / "out").glob("depth=*/shard=*"))) == len({(r.depth, r.shard) for r in out.collect()}) > 5
