"""Centroid clustering of integer vectors; the nearest centroid is found by a progressive search over Walsh-Hadamard coefficients."""

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ripple.llm.common import cut, table

#: Coefficients that are looked at one after another, coarse ones first; the last block ends the sum.
BLOCKS = (8, 8, 16, 32)
#: Vectors searched at once.
STEP = 1024
#: Components of this magnitude or more have no exact coefficients in a long.
LARGEST = 2.0**56
#: Differences of coefficients below this have squares whose sum is exact in a long.
EXACT = 1 << 28
LONG = (1 << 63) - 1


def _butterflies(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        pairs = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


@functools.lru_cache(maxsize=4)
def _coarse_first(n: int) -> np.ndarray:
    """The order of the Walsh functions by their sign changes."""
    return np.argsort((np.diff(_butterflies(np.eye(n, dtype=np.int64)), axis=1) != 0).sum(1), kind="stable")


def coefficients(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of integer rows, coarse coefficients first; squared distances grow by the row length exactly."""
    return _butterflies(x)[:, _coarse_first(x.shape[1])]


def integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors that are kept, and their components as ``floor(256 * x)``."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    rows = np.flatnonzero(lengths == dim)
    flat = pc.fill_null(column.take(pa.array(rows)).flatten().cast(pa.float64()), float("nan"))
    with np.errstate(over="ignore"):
        x = np.floor(256 * np.asarray(flat).reshape(len(rows), dim))
    good = (np.abs(x) < LARGEST).all(1)  # a comparison with nan is false
    return rows[good], x[good].astype(np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (the smaller number of equal ones) and the squared distance, both of coefficients.

    The first block gives a sum for each pair. The centroid of the least sum is finished; whatever has a larger sum than that
    full distance is strictly worse, as sums only grow, and is dropped before the next block is added.
    """
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) >= EXACT:
        x, centroids = x.astype(object), centroids.astype(object)
    a = BLOCKS[0]
    so_far = ((x[:, None, :a] - centroids[None, :, :a]) ** 2).sum(2)
    leader = so_far.argmin(1)
    bound = ((x - centroids[leader]) ** 2).sum(1)
    row, number = np.nonzero(so_far <= bound[:, None])
    so_far = so_far[row, number]
    for size in (*BLOCKS[1:], x.shape[1]):
        if a >= x.shape[1]:
            break
        so_far = so_far + ((x[row, a:a + size] - centroids[number, a:a + size]) ** 2).sum(1)
        live = so_far <= bound[row]
        row, number, so_far = row[live], number[live], so_far[live]
        a += size
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(so_far, starts)
    hits = np.flatnonzero(so_far == np.repeat(least, np.diff(np.append(starts, len(row)))))
    _, first = np.unique(row[hits], return_index=True)
    return number[hits[first]], least


def _searched(column: pa.Array, centroids: np.ndarray):
    """Kept places, components, nearest centroid and squared distance of the vectors of a batch, some at a time."""
    dim = centroids.shape[1]
    known = coefficients(centroids)
    for a in range(0, len(column), STEP):
        rows, x = integers(column.slice(a, STEP), dim)
        if len(rows):
            number, distance = nearest(coefficients(x), known)
            yield rows + a, x, number, distance // dim


def _first_centroids(vectors: DataFrame, key: str, vector: str, k: int, dim: int, seed: str) -> np.ndarray:
    def smallest(batches):
        held: list[tuple[str, list[int]]] = []
        for batch in batches:
            rows, x = integers(batch.column(vector), dim)
            names = ["" if v is None else str(v) for v in batch.column(key).take(pa.array(rows)).to_pylist()]
            held += [(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest(), v) for name, v in zip(names, x.tolist())]
            held = sorted(held)[:k]
        if held:
            yield pa.RecordBatch.from_pydict({"h": [h for h, _ in held], "v": [v for _, v in held]}, pa.schema([("h", pa.string()), ("v", pa.list_(pa.int64()))]))

    found = vectors.mapInArrow(smallest, "h string, v array<long>").orderBy("h", "v").limit(k).collect()  # k rows of dim numbers
    return np.array([r.v for r in found], dtype=np.int64).reshape(len(found), dim)


def _moved(vectors: DataFrame, vector: str, centroids: np.ndarray) -> np.ndarray:
    """Every centroid that is nearest to some vector replaced by the floored mean of those vectors."""
    k, dim = centroids.shape

    def sums(batches):
        n, high, low = np.zeros(k, dtype=np.int64), np.zeros((k, dim), dtype=np.int64), np.zeros((k, dim), dtype=np.int64)
        for batch in batches:
            for _, x, number, _ in _searched(batch.column(vector), centroids):
                n += np.bincount(number, minlength=k)
                np.add.at(high, number, x >> 32)
                np.add.at(low, number, x & 0xFFFFFFFF)
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_pydict({"c": some, "n": n[some], "high": list(high[some]), "low": list(low[some])})

    wide = "decimal(38,0)"  # a sum of longs may not fit a long
    parts = vectors.mapInArrow(sums, "c long, n long, high array<long>, low array<long>")
    parts = parts.select("c", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "x"))
    found = parts.groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x.high").cast(wide)).alias("high"), F.sum(F.col("x.low").cast(wide)).alias("low"))
    out = centroids.copy()
    for r in found.collect():  # k * dim rows
        out[r.c, r.i] = ((int(r.high) << 32) + int(r.low)) // r.n
    return out


def clusters(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2") -> DataFrame:
    """``key, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector that is kept.

    Components count as ``floor(256 * x)``, so all sums, means and distances are exact integers. Centroids start as the vectors with
    the smallest sha256 of ``seed:key`` (of equal hashes, the smaller components) and move ``rounds`` times to the floored mean of the
    vectors that are nearest to them; an empty one stays. Each round is one pass over the input with a sum per task and centroid;
    only centroids (``k * dim`` numbers) pass through the driver. Vectors are transformed where they are read, nothing is shuffled or stored
    but the last assignment. ``dim`` is a power of two of at least 8.

    Left out are null vectors, those of another length, with null or non-finite components, or with components of 2^48 and more. A
    squared distance or sum of them beyond a long is given as the largest long. Rows that repeat a key or a vector are vectors of their
    own; a null key is kept and hashes as an empty string. With fewer than ``k`` vectors there are as many centroids as vectors; without
    any the result is empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col(key).alias("_key"), F.col(vector).alias("_v"))
    kind = vectors.schema["_key"].dataType.simpleString()
    centroids = _first_centroids(vectors, "_key", "_v", k, dim, seed)
    result = f"_key {kind}, cluster int, distance long"
    if not len(centroids):
        centroids = np.zeros((1, dim), dtype=np.int64)
    for _ in range(rounds):
        centroids = _moved(vectors, "_v", centroids)

    def assign(batches):
        for batch in batches:
            for rows, _, number, distance in _searched(batch.column("_v"), centroids):
                distance = np.minimum(distance, LONG).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(distance)], ["_key", "cluster", "distance"])

    assigned = cut(vectors.mapInArrow(assign, result), "clusters")
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums = {r.cluster: int(r.s) for r in sums.collect()}  # at most k rows
    total = min(LONG, sum(sums.values()))
    digest = [hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for v in centroids.tolist()]
    known = spark.createDataFrame([(c, min(LONG, s), total, digest[c]) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_walsh_clusters(spark, sf_dir):
    return clusters(table(spark, sf_dir, "embeddings"))


def _sql(k: int = 40, rounds: int = 5) -> str:
    steps = [f"""
kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE len(embedding) = 64 AND len([x for x in embedding if isfinite(x)]) = 64),
x AS MATERIALIZED (SELECT r, i::INTEGER AS i, v[i] AS x FROM kept, range(1, 65) t(i)),
s0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS c, v FROM kept
  ORDER BY c LIMIT {k}),
c0 AS MATERIALIZED (SELECT c, i::INTEGER AS i, v[i] AS x FROM s0, range(1, 65) t(i))"""]
    for n in range(rounds + 1):
        steps.append(f"""
a{n} AS MATERIALIZED (SELECT r, min({{'d': d, 'c': c}}) AS m FROM (
  SELECT x.r, c.c, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{n} c ON x.i = c.i GROUP BY x.r, c.c) GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN o ELSE (s - ((s % n) + n) % n) // n END::BIGINT AS x FROM (
  SELECT c.c, c.i, any_value(c.x) AS o, sum(x.x) AS s, nullif(count(x.x), 0) AS n
  FROM c{n} c LEFT JOIN a{n} a ON a.m.c = c.c LEFT JOIN x ON x.r = a.r AND x.i = c.i GROUP BY c.c, c.i))""")
    return f"""WITH {",".join(steps)},
h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT k.vec_id, a.m.c AS cluster, a.m.d::BIGINT AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
  (sum(a.m.d) OVER ())::BIGINT AS inertia, h.centroid_sha256
FROM kept k JOIN a{rounds} a USING (r) JOIN h ON h.c = a.m.c"""


OP13_SQL = _sql()
