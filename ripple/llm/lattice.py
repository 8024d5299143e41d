"""Near-duplicate embeddings: random projections decoded to E8 lattice points, neighbouring cells probed, cosines verified."""

import functools
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from ripple.llm.common import cut, mix, multipliers, table
from ripple.llm.components import components, in_blocks, spanning_roots, whole_groups

#: Tables, lattices side by side in a table's key, and neighbouring points probed in each of them.
TABLES, LATTICES, PROBES = 12, 2, 2
#: Distance of a pair at the threshold within one lattice, in units of the lattice.
NEAR = 0.65
SEED = 37
#: Members of a cell that one task compares with each other.
BLOCK = 1024


@functools.lru_cache(maxsize=1)
def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or eight of +-1/2 with an even number of minus signs."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even_integers(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum (the lattice D8)."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1) % 2)
    worst = np.abs(x[odd] - r[odd]).argmax(1)
    r[odd, worst] += np.where(x[odd, worst] >= r[odd, worst], 1, -1)
    return r


def nearest_points(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the union of D8 and D8 moved by one half."""
    a, b = _even_integers(x), _even_integers(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


@functools.lru_cache(maxsize=8)
def _projection(dim: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    wide = 8 * LATTICES
    full = rng.normal(size=(TABLES, dim, wide))
    axes = np.stack([np.linalg.qr(m)[0] if dim >= wide else m / np.sqrt(dim) for m in full])
    return axes, rng.uniform(0, 2, size=(TABLES, wide))


def cells(unit: np.ndarray, cosine: float) -> np.ndarray:
    """Keys of each unit vector: (vector, table, probe) where probe 0 is the cell it lies in."""
    n, dim = unit.shape
    axes, shift = _projection(dim)
    width = np.sqrt(2 - 2 * cosine) * np.sqrt(8 / max(dim, 8)) / NEAR
    out = np.zeros((n, TABLES, (PROBES + 1) ** LATTICES), dtype=np.uint64)
    odd = multipliers(8 * LATTICES, SEED).reshape(LATTICES, 8)
    for t in range(TABLES):
        x = unit @ axes[t] / width + shift[t]
        keys = np.full((n, 1), t * 1000003 + dim, dtype=np.uint64)
        for l in range(LATTICES):
            part = x[:, 8 * l:8 * l + 8]
            base = nearest_points(part)
            near = np.argsort(-2 * ((part - base) @ minimal_vectors().T), axis=1, kind="stable")[:, :PROBES]  # all are equally long
            points = np.concatenate([base[:, None], base[:, None] + minimal_vectors()[near]], axis=1)
            hashed = mix(((2 * points).astype(np.int64).view(np.uint64) * odd[l]).sum(2))
            keys = mix(keys[:, :, None] * np.uint64(31) + hashed[:, None, :]).reshape(n, -1)
        out[:, t] = keys
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _all_cells(column: pa.Array, cosine: float) -> tuple[list[np.ndarray], np.ndarray]:
    """The unit vectors of a batch and their keys; those of a bucket are equally long."""
    dims = np.asarray(pa.compute.list_value_length(column))
    units, keys = [None] * len(column), np.zeros((len(column), TABLES, (PROBES + 1) ** LATTICES), dtype=np.uint64)
    for d in np.unique(dims):
        for rows in np.array_split(np.flatnonzero(dims == d), max(1, np.count_nonzero(dims == d) // 2048)):
            unit = _unit(_vectors(column.take(pa.array(rows))))
            keys[rows] = cells(unit, cosine)
            for r, u in zip(rows, unit):
                units[r] = u
    return units, keys


def _keyed(classes: DataFrame, cosine: float) -> DataFrame:
    """``bucket, cls, resident``: each class in its own cells and, as a visitor, in the neighbouring ones."""
    def rows(batches):
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                for a in range(0, len(part), 2048):
                    some = part.slice(a, 2048)
                    keys = cells(_unit(_vectors(some.column("v"))), cosine)
                    per = keys.shape[1] * keys.shape[2]
                    resident = np.tile(np.arange(keys.shape[2]) == 0, len(some) * keys.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(some.column("cls")), per)), pa.array(resident)], ["bucket", "cls", "resident"])

    return classes.select("cls", "dim", "v").mapInArrow(rows, "bucket long, cls long, resident boolean")


def _block_links(v: np.ndarray, keys: np.ndarray, bucket: np.uint64, resident: np.ndarray, allowed: np.ndarray, cls: np.ndarray, cosine: float):
    """Links (i, j), i < j, of one pair of blocks that have this bucket as the first one they meet in."""
    close = np.triu((v @ v.T >= cosine) & (resident[:, None] | resident[None]) & allowed, 1)
    i, j = np.nonzero(close)
    swap = cls[i] > cls[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    open_ = np.ones(len(i), dtype=bool)
    good = np.zeros(len(i), dtype=bool)
    for t in range(TABLES):
        w = np.flatnonzero(open_)
        if not len(w):
            break
        a, b = keys[i[w], t], keys[j[w], t]
        of_a, of_b = (b == a[:, :1]).any(1), (a == b[:, :1]).any(1)  # met in a's own cell, in b's own cell
        meet = of_a | of_b
        place = np.where(of_a, a[:, 0], b[:, 0])
        good[w[meet & (place == bucket)]] = True
        open_[w[meet]] = False
    return i[good], j[good]


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """``key, n_links, component_id, kept`` of every vector, by links of at least ``cosine``.

    Equal vectors form a class, so copies are never paired. Each class lies in one cell per table and visits the cells of
    the nearest lattice points; a cell with one member is dropped by a count. A large cell is compared in blocks of ``BLOCK`` by
    matrix products. Each block adds up the links of its members and reports them with a spanning forest, so a dense cell
    does not give a row for each pair; a pair that meets in several cells counts in the first.

    Null, empty, zero and non-finite vectors link with nothing, nor do vectors of different lengths or rows with a null key.
    Rows that repeat a key count as vectors of their own. An empty table gives no rows; other columns are ignored.
    """
    v = F.col("v")
    ok = F.coalesce(F.col("_key").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
                    & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("_key"), F.transform(vector, lambda x: x.cast("double") + F.lit(0.0)).alias("v")).withColumn("ok", ok)
    classes = rows.where("ok").groupBy("v").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = cut(classes.withColumns({"cls": F.monotonically_increasing_id(), "dim": F.size("v")}), "vectors")
    keyed = cut(_keyed(classes, cosine), "cells")
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("resident").alias("any")).where("n > 1 and any").drop("any")
    members = in_blocks(keyed.join(shared, "bucket"), "bucket", "cls", "n", BLOCK).join(classes.select("cls", "v", "copies"), "cls")
    members = members.select("bucket", "left", "right", "own", "resident", "cls", "copies", "v").repartition("bucket", "left", "right")

    def compare(batches):
        for batch, starts in whole_groups(batches, ["bucket", "left", "right"]):
            out = []
            units, keys = _all_cells(batch.column("v"), cosine)
            for a, b in zip(starts, np.append(starts[1:], len(batch))):
                if b - a < 2:
                    continue
                part = batch.slice(int(a), int(b - a))
                cls, copies, own = (np.asarray(part.column(c)) for c in ("cls", "copies", "own"))
                unit = np.stack(units[a:b])
                across = part.column("left")[0].as_py() != part.column("right")[0].as_py()
                allowed = (own[:, None] != own[None]) if across else np.ones((len(part), len(part)), dtype=bool)
                bucket = np.asarray(part.column("bucket")).view(np.uint64)[0]
                i, j = _block_links(unit, keys[a:b], bucket, np.asarray(part.column("resident")), allowed, cls, cosine)
                if len(i):
                    n = np.bincount(i, copies[j], len(part)) + np.bincount(j, copies[i], len(part))
                    some = np.flatnonzero(n)
                    out.append((cls[some], n[some].astype(np.int64), cls[spanning_roots(len(part), i, j)[some]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["cls", "n", "root"])

    found = cut(members.sortWithinPartitions("bucket", "left", "right").mapInArrow(compare, "cls long, n long, root long"), "vector_links")
    joined = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    lowest = joined.join(classes.select(F.col("cls").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(lowest, "component").select(F.col("node").alias("cls"), "component_id")
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "cls", "left").join(named, "cls", "left").select(
        F.col("v").alias("_v"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    out = rows.join(known, (F.col("v") == F.col("_v")) & F.col("ok"), "left").select(
        F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op3_lattice(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))
