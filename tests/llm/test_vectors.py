import numpy as np

import brute
from ripple.llm import lattice


def expected(ids, x, cosine=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = np.argwhere(np.triu(unit @ unit.T >= cosine, 1))
    links = np.bincount(close.ravel(), minlength=len(ids))
    root = brute.roots(range(len(ids)), close.tolist())
    low = {}
    for n, r in root.items():
        low[r] = min(low.get(r, ids[n]), ids[n])
    return close, {(ids[n], int(links[n]), low[root[n]], ids[n] == low[root[n]]) for n in range(len(ids))}


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").toPandas()
    _, want = expected(rows.vec_id.tolist(), np.stack(rows.embedding).astype(np.float64))
    assert {tuple(r) for r in lattice.op3_lattice(spark, "/root/testdata/sf0.1").collect()} == want


def test_recall_at_the_threshold():
    """Pairs with a cosine of exactly 0.95 to 0.96 meet in a cell."""
    r = np.random.default_rng(3)
    a = r.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    d = r.normal(size=a.shape)
    d -= (d * a).sum(1, keepdims=True) * a
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    c = r.uniform(0.95, 0.96, size=(4000, 1))
    x, y = lattice.cells(a, 0.95), lattice.cells(c * a + np.sqrt(1 - c * c) * d, 0.95)
    met = ((x == y[:, :, :1]) | (y == x[:, :, :1])).any(axis=(1, 2))
    assert met.mean() > 0.95


def test_dense_cells_and_copies(spark, monkeypatch):
    monkeypatch.setattr(lattice, "BLOCK", 32)
    r = np.random.default_rng(4)
    centre = r.normal(size=(3, 20))
    x = np.concatenate([centre[0] + r.normal(size=(150, 20)) * 0.05, centre[1] + r.normal(size=(40, 20)) * 0.02, np.repeat(centre[2:], 30, 0), r.normal(size=(60, 20))])
    ids = r.permutation(len(x)).tolist()
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, n_links int")
    got = {tuple(t) for t in lattice.near_vectors(frame).collect()}
    close, want = expected(ids, x)
    found = sum(t[1] for t in got) / 2
    assert 0.97 * len(close) <= found <= len(close)
    assert {(t[0], t[2], t[3]) for t in got} == {(t[0], t[2], t[3]) for t in want}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (10, [1e30, -0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in lattice.near_vectors(frame).collect())
    want = [(str(i), 0, str(i), True) for i in (1, 2, 3, 4, 5, 6, 9, None)] + [("7", 3, "7", True)] * 2 + [("8", 3, "7", False), ("10", 3, "7", False)]
    assert got == sorted(want)
    assert lattice.near_vectors(frame.limit(0)).collect() == []
