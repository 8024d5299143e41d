"""Helpers shared by the operators: stored steps, stable hashes, words of Arrow batches."""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ripple.session import cut

__all__ = ["cut", "table", "md5_bits", "mix", "words_of", "word_codes", "word_hashes", "slices", "shingle_hashes"]

#: Words are runs of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Odd 64-bit multipliers of the mixing steps.
ODD = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_bits(text: Column) -> Column:
    """The first 60 bits of the md5 of a string, as a non-negative long; null counts as a string of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(text, F.lit("\x00")).cast("binary")), 1, 15), 16, 10).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= ODD[1]
    x ^= x >> np.uint64(27)
    x *= ODD[2]
    x ^= x >> np.uint64(31)
    return x


def compact(texts: pa.Array) -> pa.Array:
    """The texts without nulls in a buffer of their own; string kernels misread a slice whose offsets do not begin at 0."""
    texts = texts.take(pa.array(np.arange(len(texts))))
    return pc.fill_null(texts.cast(pa.large_string()), "")


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch, and the offsets of each text in them; a null text has none."""
    texts = compact(texts)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    if not full.all():  # white space at an end of a text leaves an empty word
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    return flat, offsets


def word_codes(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = flat.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def word_hashes(flat: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of every word; distinct words of the batch are hashed once."""
    codes, distinct = word_codes(flat)
    known = np.fromiter(map(xxhash.xxh64_intdigest, distinct.to_pylist()), dtype=np.uint64, count=len(distinct))
    return known[codes]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """Cut a batch into pieces of about ``most`` bytes of text, so that long texts never meet in one piece."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    piece = np.cumsum(sizes) // most
    starts = np.concatenate([[0], np.flatnonzero(np.diff(piece)) + 1, [len(sizes)]])
    for a, b in zip(starts[:-1], starts[1:]):
        if b > a:
            yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()  # workers live on


def shingle_hashes(texts: pa.Array, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text in order, with repeats, and their offsets.

    With ``short``, a text of fewer than ``size`` words (but at least one) has its whole word sequence as its
    only shingle.
    """
    flat, offsets = words_of(texts)
    h = word_hashes(flat)
    n_words = np.diff(offsets)
    counts = np.maximum(n_words - size + 1, 0)
    few = (n_words > 0) & (n_words < size) if short else np.zeros(len(n_words), dtype=bool)
    out_offsets = np.concatenate([[0], np.cumsum(counts + few)])
    # shingles that start at each word, then only those that end inside their text
    rolled = np.full(len(h), size, dtype=np.uint64)
    for k in range(size):
        part = np.zeros(len(h), dtype=np.uint64)
        part[: len(h) - k] = h[k:] if k else h
        rolled = mix(rolled * ODD[0] + part)
    starts = np.arange(len(h)) - np.repeat(offsets[:-1], n_words)
    out = np.empty(out_offsets[-1], dtype=np.uint64)
    whole = starts < np.repeat(counts, n_words)
    is_short = np.repeat(few, counts + few)
    out[~is_short] = rolled[whole]
    for i in np.flatnonzero(few):
        x = np.array([n_words[i]], dtype=np.uint64)
        for w in h[offsets[i]:offsets[i + 1]]:
            x = mix(x * ODD[0] + w)
        out[out_offsets[i]] = x[0]
    return out, out_offsets


@functools.lru_cache(maxsize=8)
def multipliers(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
