import hashlib
import math

import duckdb
import numpy as np

from ripple.llm import clustering


def expected(rows, k=40, rounds=5):
    """Plain k-means over Python integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)[:k]
    centroids = [v for _, v in start]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(centroids)):
            mine = [v for (_, v), (_, m) in zip(kept, found) if m == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine)]
    found = assign()
    total = sum(d for d, _ in found)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sum(x for x, m in found if m == n), total, digest[n]) for (i, _), (d, n) in zip(kept, found)), key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_given_vectors_and_sql(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = clustering.op13_walsh_clusters(spark, d)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == expected(rows)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert sorted(c.execute(clustering.OP13_SQL).fetchall(), key=str) == got


def test_transform_is_exact():
    r = np.random.default_rng(1)
    x = r.integers(-(1 << 20), 1 << 20, size=(50, 64))
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(64)] for i in range(64)])
    w = clustering.coefficients(x)
    assert sorted(map(tuple, w.T.tolist())) == sorted(map(tuple, (x @ h).T.tolist()))
    assert (w[:, 0] == x.sum(1)).all() and ((w**2).sum(1) == 64 * (x**2).sum(1)).all()


def test_search_with_ties_and_close_centroids():
    """Equal centroids, centroids one apart, and vectors far beyond the exact range of a long."""
    r = np.random.default_rng(2)
    for scale in (2, 300, 1 << 40):
        x = r.integers(-scale, scale + 1, size=(200, 64))
        c = np.concatenate([x[:5], x[:5], x[:5] + r.integers(-1, 2, size=(5, 64)), r.integers(-scale, scale + 1, size=(9, 64))])
        number, distance = clustering.nearest(clustering.coefficients(x), clustering.coefficients(c))
        plain = ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2)
        assert number.tolist() == [min(range(len(c)), key=lambda n: (p[n], n)) for p in plain]
        assert [d // 64 for d in distance.tolist()] == plain.min(1).tolist()


def test_edges(spark):
    r = np.random.default_rng(3)
    v = [r.normal(size=64).tolist() for _ in range(6)]
    odd = [(90, None), (91, []), (92, v[0][:63]), (93, v[0] + [0.0]), (94, [None] + v[0][1:]), (95, [float("nan")] + v[0][1:]), (96, [float("inf")] * 64), (97, [1e300] * 64)]
    rows = [(i, x) for i, x in enumerate(v)] + [(1, v[1]), (1, v[2]), (None, v[3]), (7, [0.0] * 64), (8, [-0.001] * 64), (9, [70000.5] * 64)] + odd
    got = sorted((tuple(x) for x in clustering.clusters(frame(spark, rows)).collect()), key=str)
    assert got == expected([x for x in rows if x[0] != 97])
    few = sorted((tuple(x) for x in clustering.clusters(frame(spark, rows), k=3).collect()), key=str)
    assert few == expected([x for x in rows if x[0] != 97], k=3)
    same = frame(spark, [(i, v[0]) for i in range(100)]).selectExpr("*", "1 as cluster", "'x' as distance", "vec_id as _key")
    assert {(x.cluster, x.distance, x.inertia) for x in clustering.clusters(same).collect()} == {(0, 0, 0)}
    assert clustering.clusters(frame(spark, [])).collect() == []
    assert clustering.clusters(frame(spark, odd)).collect() == []


def test_beyond_a_long(spark):
    rows = [(1, [2.0**40] * 64), (2, [-(2.0**40)] * 64), (3, [2.0**40] * 64)]
    got = clustering.clusters(frame(spark, rows), k=1, rounds=1).collect()
    assert {(x.distance, x.inertia) for x in got} == {((1 << 63) - 1, (1 << 63) - 1)}
