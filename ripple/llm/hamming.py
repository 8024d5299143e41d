"""Near-duplicates by b-bit MinHash signatures, joined by a multi-index under a signature distance."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, functions as F

from ripple.llm.common import cut, mix, multipliers, shingle_hashes, slices, table
from ripple.llm.components import components, in_blocks, pairs_within, send, spanning_roots, whole_groups

#: A signature has CHUNKS x WIDTH values of 16 bits. Two signatures that differ in at most 2 * CHUNKS - 1 values have a chunk
#: with one difference at most; each chunk is looked up with each of its values left out, so they meet in a bucket.
CHUNKS, WIDTH = 10, 5
N = CHUNKS * WIDTH
SEED = 11
#: Members of a bucket that one task compares with each other.
BLOCK = 512


def signatures(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """``key, n_shingles, digest, sig`` of whole texts; the digest is of the sorted set, null for a text without words."""
    def sign(batches):
        a = multipliers(N, SEED)
        for batch in batches:
            for part in slices(batch, text):
                h, offsets = shingle_hashes(part.column(text), size)
                n = len(offsets) - 1
                counts, digests = np.zeros(n, dtype=np.int64), [None] * n
                full = np.flatnonzero(np.diff(offsets))
                sig = np.zeros((n, N), dtype="<u2")
                for i in full:
                    own = np.unique(h[offsets[i]:offsets[i + 1]])
                    counts[i], digests[i] = len(own), xxhash.xxh3_128_digest(own.tobytes())
                for k in range(N if len(full) else 0):
                    least = np.minimum.reduceat(h * a[k], offsets[full])
                    sig[full, k] = (mix(least) & np.uint64(0xFFFF)).astype("<u2")
                raw = [r.tobytes() if d is not None else None for r, d in zip(sig, digests)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.array(counts), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())],
                    [key, "n_shingles", "digest", "sig"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(sign, f"{key} {kind}, n_shingles long, digest binary, sig binary")


def shingle_sets(rows: DataFrame, text: str, size: int) -> DataFrame:
    """``cls, items`` for the rows whose set has the digest that the row states."""
    def build(batches):
        for batch in batches:
            for part in slices(batch, text):
                h, offsets = shingle_hashes(part.column(text), size)
                own = [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                good = [i for i, (s, d) in enumerate(zip(own, part.column("digest").to_pylist())) if xxhash.xxh3_128_digest(s.tobytes()) == d]
                sets = [own[i].view(np.int64) for i in good]
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                items = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("cls").take(pa.array(good, pa.int64())), items], ["cls", "items"])

    return rows.select("cls", "digest", text).mapInArrow(build, "cls long, items array<long>")


def _keys(classes: DataFrame) -> DataFrame:
    """A row for each value left out of each chunk: ``cls, k, bucket``."""
    rows = classes.select("cls", "sig", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("k"))
    at, skip = f"(k div {WIDTH}) * {2 * WIDTH}", f"(k % {WIDTH}) * 2"
    rest = f"concat(substring(sig, cast({at} + 1 as int), cast({skip} as int)), substring(sig, cast({at} + {skip} + 3 as int), cast({2 * WIDTH - 2} - {skip} as int)))"
    return rows.select("cls", "k", F.xxhash64(F.col("k"), F.expr(rest)).alias("bucket"))


def _members(classes: DataFrame) -> DataFrame:
    """``cls, k, bucket, n`` of the buckets that several classes share.

    Spark sizes an exploded side by what it was exploded from, many times too low, and would collect it on the driver to broadcast it;
    so both sides are shuffled whatever it thinks.
    """
    keys = _keys(classes)
    shared = keys.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return keys.join(shared.hint("merge"), "bucket")


def _sigs(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype="<u2").reshape(len(batch), N)


def _stars(members: DataFrame, allowed: int) -> DataFrame:
    """Each member of a block with the member that is nearest to all others of the block, if within ``allowed``."""
    def link(batches):
        for batch, starts in whole_groups(batches, ["bucket", "own"]):
            sig, cls = _sigs(batch), np.asarray(batch.column("cls"))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(batch))))
            total = np.zeros(len(batch), dtype=np.int64)
            for a, b in pairs_within(starts, len(batch), 1 << 18):
                far = np.count_nonzero(sig[a] != sig[b], axis=1)
                total += np.bincount(a, far, len(batch)).astype(np.int64) + np.bincount(b, far, len(batch)).astype(np.int64)
            order = np.lexsort([cls, total, group])
            middle = order[np.searchsorted(group[order], np.arange(len(starts)))][group]
            near = (np.count_nonzero(sig != sig[middle], axis=1) <= allowed) & (cls != cls[middle])
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(cls, cls[middle])[near]), pa.array(np.minimum(cls, cls[middle])[near])], ["a", "b"])

    rows = members.withColumn("own", F.pmod(F.xxhash64("cls"), F.ceil(F.col("n") / BLOCK)).cast("int")).select("bucket", "own", "cls", "sig")
    rows = rows.repartition("bucket", "own").sortWithinPartitions("bucket", "own")
    return rows.mapInArrow(link, "a long, b long").distinct()


def _across(members: DataFrame, allowed: int) -> DataFrame:
    """Members of each block that have a partner of another component within ``allowed``, in the first bucket shared with it."""
    names = ["bucket", "left", "right", "own", "cls", "component"]

    def choose(batches):
        for batch, starts in whole_groups(batches, ["bucket", "left", "right"]):
            sig, cls, comp, k, own = _sigs(batch), *(np.asarray(batch.column(c)) for c in ("cls", "component", "k", "own"))
            cross = np.asarray(batch.column("left")) != np.asarray(batch.column("right"))
            some = np.zeros(len(batch), dtype=bool)
            for a, b in pairs_within(starts, len(batch), 1 << 18):
                keep = (comp[a] != comp[b]) & ~(cross[a] & (own[a] == own[b]))
                a, b = a[keep], b[keep]
                differ = (sig[a] != sig[b]).reshape(len(a), CHUNKS, WIDTH)
                wrong = differ.sum(2)
                chunk = np.argmax(wrong <= 1, axis=1)
                first = chunk * WIDTH + np.argmax(differ[np.arange(len(a)), chunk], axis=1)  # value 0 where none differs
                good = (wrong.sum(1) <= allowed) & (first == k[a]) & (wrong[np.arange(len(a)), chunk] <= 1)
                some[a[good]] = some[b[good]] = True
            if some.any():
                yield batch.select(names).filter(pa.array(some))

    rows = in_blocks(members, "bucket", "cls", "n", BLOCK).select(*names, "k", "sig")
    rows = rows.repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    return rows.mapInArrow(choose, "bucket long, left int, right int, own int, cls long, component long")


def _common(items: pa.Array) -> np.ndarray:
    """Sizes of all intersections of a block's sets, added up over slices of the items that several sets hold."""
    n = len(items)
    row = np.repeat(np.arange(n), np.diff(np.asarray(items.offsets)))
    _, item, times = np.unique(np.asarray(items.flatten()), return_inverse=True, return_counts=True)
    shared = times[item] > 1
    order = np.argsort(item[shared], kind="stable")
    row, item = row[shared][order], item[shared][order]
    _, column = np.unique(item, return_inverse=True)
    both = np.zeros((n, n), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [start, start + 4096])
        some = np.zeros((n, 4096), dtype=np.float32)
        some[row[a:b], column[a:b] - start] = 1
        both += some @ some.T
    return both.astype(np.int64)


def _confirmed_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components that full sets confirm, as a spanning forest of each block."""
    def link(batches):
        for batch, starts in whole_groups(batches, ["bucket", "left", "right"]):
            found = []
            for a, b in zip(starts, np.append(starts[1:], len(batch))):
                part = batch.slice(int(a), int(b - a))
                cls, comp, own = (np.asarray(part.column(c)) for c in ("cls", "component", "own"))
                sizes = np.asarray(pa.compute.list_value_length(part.column("items")), dtype=np.int64)
                both = _common(part.column("items"))
                good = np.triu((100 * both >= percent * (sizes[:, None] + sizes[None] - both)) & (comp[:, None] != comp[None]), 1)
                if len(part) > 1 and part.column("left")[0] != part.column("right")[0]:
                    good &= own[:, None] != own[None]
                i, j = np.nonzero(good)
                root = spanning_roots(len(part), i, j)
                some = np.flatnonzero(root != np.arange(len(part)))
                found.append((cls[some], cls[root[some]]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

    rows = members.join(sets, "cls").repartition("bucket", "left", "right").sortWithinPartitions("bucket", "left", "right")
    return rows.mapInArrow(link, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets share enough: 100 * intersection >= percent * union."""
    left = sets.select(F.col("cls").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("both") * 100 >= (F.size("x") + F.size("y") - F.col("both")) * percent).select("a", "b")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row, by links of at least ``percent`` Jaccard similarity.

    Rows with equal shingle sets form a class, so copies are never paired. Classes meet in a bucket if they differ in at
    most one value of a chunk of their signature; buckets with one class are dropped by a count. A first pass links each
    member with the most central one of its bucket, and the links that full sets confirm give first components. A second
    pass compares all members of the buckets that hold several components, in blocks of ``BLOCK``; the members that have a
    near partner elsewhere bring their full sets to a task per block, which reports a spanning forest of the confirmed links
    and no row for each pair. Pairs that differ in at most 2 * CHUNKS - 1 values always meet; those beyond, up to the allowed
    distance, meet only if some chunk has at most one differing value, and so may be missed. Pairs that meet are either in one
    component already or compared. The allowed distance is five standard deviations beyond that of a pair at the threshold.

    A null or empty text has no shingles and links with nothing; neither does a row with a null key. A text of fewer than
    ``size`` words is one shingle. Rows that repeat a key are handled each by its own text. Other columns are ignored.
    """
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    far = (100 - percent) / 100
    allowed = max(2 * CHUNKS - 1, math.ceil(N * far + 5 * math.sqrt(N * far * (1 - far))))
    rows = cut(signatures(docs, "_key", "_text", size), "signatures")
    classes = rows.where("digest is not null and _key is not null").groupBy("digest").agg(F.min("_key").alias("first"), F.first("sig").alias("sig"))
    classes = cut(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")  # stored, so the numbers stay
    members = cut(_members(classes), "buckets")
    involved = cut(members.select("cls").distinct().join(classes.select("cls", "first", "digest", "sig"), "cls"), "involved")
    sets = cut(shingle_sets(docs.join(send(involved.select("cls", "first", "digest"), 64), F.col("_key") == F.col("first")), "_text", size), "sets")
    sigs = involved.select("cls", "sig")
    centred = _stars(members.where(f"k % {WIDTH} = 0").join(sigs, "cls"), allowed)
    links = cut(_confirmed(centred, sets, percent), "links_first")
    first = components(links)
    placed = members.join(first.select(F.col("node").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    rest = _across(placed.join(mixed, "bucket", "left_semi").join(sigs, "cls"), allowed)
    more = _confirmed_blocks(rest, sets, percent)
    joined = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    named = joined.join(classes.select(F.col("cls").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("component_id"))
    named = joined.join(named, "component").select(F.col("node").alias("cls"), "component_id")
    known = classes.join(named, "cls", "left").select("digest", F.coalesce("component_id", "first").alias("component_id"))
    out = rows.join(known, (rows["digest"] == known["digest"]) & rows["_key"].isNotNull(), "left").select(
        F.col("_key").alias(key), "n_shingles", F.coalesce("component_id", "_key").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, with all their columns, but for those that are not the first of their near-duplicate group.

    Rows that repeat a key stay or go together, as they have one group if their texts are near; where one of them is
    dropped and another kept by different texts, both stay. Rows with a null key stay.
    """
    found = near_duplicates(docs, key, text, size, percent)
    gone = cut(found.groupBy(key).agg(F.max("kept").alias("kept")).where("not kept").select(key), "dropped")
    return docs.join(send(gone, 32), key, "left_anti").select(*docs.columns)


def op5_minhash_hamming(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)
