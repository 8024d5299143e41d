"""Connected components of a table of links, and tools to compare the members of large buckets in blocks."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ripple.llm.common import cut

#: Bytes of a stored table under which it is sent to every task; a larger one is joined by a shuffle.
SMALL = 48 << 20


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node of ``links`` (columns a, b): the smallest node it is connected with.

    Large-star and small-star steps by turns, each over all links in one shuffle; rounds are stored in the shared
    scratch folder. The number of rounds grows with the logarithm of the longest path. Links of a node with itself
    keep the node; null ends are left out.
    """
    links = links.where("a is not null and b is not null")
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        after = _mark(now)
        if after == state:
            break
        state = after
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b >= a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        now = cut(small.select("x.a", "x.b").distinct(), "links")
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def _mark(links: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(links.select(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())


def send(small: DataFrame, row_bytes: int) -> DataFrame:
    """Mark a stored table for broadcast if its rows take fewer than ``SMALL`` bytes; otherwise leave it as it is."""
    return F.broadcast(small) if small.count() * row_bytes <= SMALL else small


def in_blocks(members: DataFrame, key: str, member: str, count: str, most: int) -> DataFrame:
    """Split the members of each key into blocks of about ``most`` and repeat each for all pairs of blocks it is in.

    Adds ``own`` (its block), ``left`` and ``right`` (the pair). A key of up to ``most`` members makes one pair,
    block 0 with itself; a larger one is compared by several tasks, each of which sees two blocks.
    """
    blocks = F.ceil(F.col(count) / most).cast("int")
    out = members.withColumn("_blocks", blocks).withColumn("own", F.pmod(F.xxhash64(member), F.col("_blocks")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return out.withColumns({"left": F.least("own", "_other"), "right": F.greatest("own", "_other")}).drop("_blocks", "_other")


def whole_groups(batches, columns: list[str]):
    """Batches of rows sorted by ``columns``, cut anew so that no group of equal values is divided; yields (batch, group starts)."""
    held: list[pa.RecordBatch] = []

    def starts_of(batch):
        change = np.zeros(len(batch), dtype=bool)
        change[0] = True
        for c in columns:
            v = np.asarray(batch.column(c))
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def joined(parts):
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        whole = joined(held)
        starts = starts_of(whole)
        if len(starts) > 1:
            yield whole.slice(0, int(starts[-1])), starts[:-1]
        held = [whole.slice(int(starts[-1]))]
    if held:
        whole = joined(held)
        yield whole, starts_of(whole)


def pairs_within(starts: np.ndarray, n: int, step: int = 1 << 20):
    """All pairs of rows of the same group, in arrays of about ``step`` pairs."""
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    live = np.arange(n)
    left, right, size, d = [], [], 0, 0
    while len(live):
        d += 1
        live = live[live + d < ends[live]]
        left.append(live)
        right.append(live + d)
        size += len(live)
        if size >= step:
            yield np.concatenate(left), np.concatenate(right)
            left, right, size = [], [], 0
    if size:
        yield np.concatenate(left), np.concatenate(right)


def spanning_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest of the n members that each is connected with by the links (i, j)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label
