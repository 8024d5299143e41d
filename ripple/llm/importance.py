"""Resampling towards a target by word-window features in hashed buckets, words found by an untrained pre-tokeniser."""

import functools
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ripple.llm.common import compact, cut, slices, table

#: What stands between words: all of ASCII but digits and, after lower-casing, letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
#: Consecutive words of the longest feature.
LONGEST = 2
#: Text of a piece of a batch, and of one call of the pre-tokeniser.
PIECE, CALL = 2 << 20, 1 << 17


@functools.lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(BETWEEN), "removed")


def _calls(text: str):
    """Cut a text between words into parts of about ``CALL`` characters; yields (place, part)."""
    at, gap = 0, re.compile(BETWEEN)
    while len(text) - at > CALL:
        found = gap.search(text, at + CALL)
        if not found:
            break
        yield at, text[at:found.end()]
        at = found.end()
    yield at, text[at:]


class Words:
    """The words of a batch of lowered texts: a number, a first and an end offset each; ``counts`` by text."""

    def __init__(self, texts: list[str]):
        known: dict[str, int] = {}
        number, spans, counts = [], [], []
        for text in texts:
            n = 0
            for at, part in _calls(text):
                found = _splitter().pre_tokenize_str(part)
                if found:
                    words, offsets = zip(*found)
                    number.append(np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words)))
                    spans.append(np.fromiter(itertools.chain.from_iterable(offsets), dtype=np.int64, count=2 * len(words)).reshape(-1, 2) + at)
                    n += len(words)
            counts.append(n)
        self.counts = np.array(counts, dtype=np.int64)
        self.number = np.concatenate(number) if number else np.zeros(0, dtype=np.int64)
        self.spans = np.concatenate(spans) if spans else np.zeros((0, 2), dtype=np.int64)
        raw = [w.encode() for w in known]
        self.crc = np.array([zlib.crc32(w) for w in raw], dtype=np.uint32)
        self.size = np.array([len(w) for w in raw], dtype=np.int64)


def _through(columns: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map over bits, given by what it makes of each single bit."""
    out = np.zeros(x.shape, dtype=np.uint32)
    for bit in range(32):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), columns[bit], np.uint32(0))
    return out


@functools.lru_cache(maxsize=512)
def _moved_by(size: int) -> np.ndarray:
    """Tables, one a byte, that carry a crc over ``size`` further bytes."""
    one = np.array([zlib.crc32(b"\0", 1 << bit) ^ zlib.crc32(b"\0") for bit in range(32)], dtype=np.uint32)
    whole = np.uint32(1) << np.arange(32, dtype=np.uint32)
    while size:
        if size & 1:
            whole = _through(one, whole)
        one, size = _through(one, one), size >> 1
    return np.stack([_through(whole, np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The crc of byte strings one after another, from both crcs and the size of the second one."""
    out = second.copy()
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        tables, x = _moved_by(int(n)), first[at]
        for b in range(4):
            out[at] ^= tables[b][(x >> np.uint32(8 * b)) & np.uint32(255)]
    return out


def windows(words: Words, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of 1 to ``longest`` words of a text: (text number, first and end offset, crc of the words joined by one space)."""
    n = len(words.number)
    text = np.repeat(np.arange(len(words.counts)), words.counts)
    left = np.repeat(np.cumsum(words.counts), words.counts) - np.arange(n)  # words from here to the end of the text
    crc, space = words.crc[words.number], np.uint32(zlib.crc32(b" "))
    out = [(text, words.spans, crc)]
    here = np.arange(n)
    for more in range(1, longest):
        live = left[here] > more
        here, crc = here[live], crc[live]
        last = here + more
        crc = joined_crc(crc, np.full(len(here), space, dtype=np.uint32), np.ones(len(here), dtype=np.int64))
        crc = joined_crc(crc, words.crc[words.number[last]], words.size[words.number[last]])
        out.append((text[here], np.stack([words.spans[here, 0], words.spans[last, 1]], axis=1), crc))
    return tuple(np.concatenate(x) for x in zip(*out))


def histograms(docs: DataFrame, text: str, keep: list[str], buckets: int, longest: int) -> DataFrame:
    """The columns ``keep`` with ``n_words, n_features`` and the features of each text as pairs of a bucket and a count."""
    def rows(batches):
        for batch in batches:
            for part in slices(batch, text, PIECE):
                words = Words(pc.ascii_lower(compact(part.column(text))).to_pylist())
                of, _, crc = windows(words, longest)
                keys, times = np.unique(of * buckets + crc % np.uint32(buckets), return_counts=True)
                offsets = pa.array(np.searchsorted(keys, np.arange(len(part) + 1) * buckets), pa.int32())
                features = np.bincount(of, minlength=len(part)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(words.counts), pa.array(features), pa.ListArray.from_arrays(offsets, pa.array(keys % buckets, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))], [*keep, "n_words", "n_features", "bucket", "times"])

    kept = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*keep, text).mapInArrow(rows, f"{kept}n_words long, n_features long, bucket array<int>, times array<int>")


def bucket_totals(rows: DataFrame, buckets: int) -> DataFrame:
    """``bucket, n``: the features of all texts, added up in each task first."""
    def sums(batches):
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            n += np.bincount(np.asarray(batch.column("bucket").flatten()), np.asarray(batch.column("times").flatten()), buckets).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return rows.select("bucket", "times").mapInArrow(sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int) -> np.ndarray:
    """By bucket, a thousand times the logarithm of the smoothed share in the target over that in the source, rounded down."""
    s, t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return np.array([math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s / ((source.get(b, 0) + 1.0) * t))) for b in range(buckets)], dtype=np.int64)


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 25,
              least_words: int = 20, seed: str = "7", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """``key, n_words, n_features, weight, score, rank`` of every row; those with a rank are the sample.

    Texts are lower-cased (A-Z only) and split whole by the pre-tokeniser of the tokenizers library; runs of 1 to ``longest`` words are
    features. Texts are read once: what is stored of each is its own bucket counts. The totals of both tables (``buckets`` numbers) give
    a gain for each bucket, ``weight`` is the floored mean gain of a text, and ``score`` adds Gumbel noise from a hash of the key, so the
    ``percent`` of highest scores among texts of at least ``least_words`` words are a sample without replacement. They are
    numbered by sorted ranges, whose sizes alone are added up.

    A null or empty text has no feature and weight 0. A null key hashes as an empty string and comes last among equal scores; rows that
    repeat a key are rows of their own, in their stored order where all else is equal. An empty target leaves the prior alone; an empty
    table gives no rows. Other columns are ignored.
    """
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = histograms(docs, "_text", ["_key"], buckets, longest)
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "histograms")  # stored, so the numbers stay
    aims = histograms(target.select(F.col(target_text).alias("_text")), "_text", [], buckets, longest)
    source_n, target_n = ({r.bucket: r.n for r in bucket_totals(x, buckets).collect()} for x in (rows, aims))  # at most a row a bucket
    gain = gains(source_n, target_n, buckets)

    def scores(batches):
        for batch in batches:
            offsets = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(batch.column("bucket"))))])
            each = gain[np.asarray(batch.column("bucket").flatten())] * np.asarray(batch.column("times").flatten())
            total = np.diff(np.concatenate([[0], np.cumsum(each)])[offsets])
            weight = total // np.maximum(1, np.asarray(batch.column("n_features")))
            names = ["" if k is None else str(k) for k in batch.column("_key").to_pylist()]
            h = (int(hashlib.sha256(f"{seed}:{k}".encode()).hexdigest()[:8], 16) for k in names)
            noise = np.fromiter((math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h), dtype=np.int64, count=len(names))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_key", "n_words", "n_features")), pa.array(weight), pa.array(weight + noise)],
                                             ["_row", "_key", "n_words", "n_features", "weight", "score"])

    kind = docs.schema["_key"].dataType.simpleString()
    scored = cut(rows.mapInArrow(scores, f"_row long, _key {kind}, n_words long, n_features long, weight long, score long"), "scores")
    ranked = _numbered(scored.where(F.col("n_words") >= least_words), [F.desc("score"), F.asc_nulls_last("_key"), F.asc("_row")])
    most = percent * ranked.count() // 100
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("_key").alias(key), "n_words", "n_features", "weight", "score", "rank")


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    """Add ``rank``, the place of each row in the whole order; only the sizes of the sorted ranges meet in one task."""
    columns = rows.columns
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), place.alias("_place")), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one short row a range
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return rows.join(sizes.select("_range", "_before"), "_range").select(*columns, (F.col("_before") + F.col("_place") + 1).alias("rank"))


def op12_importance(spark, sf_dir):
    out = resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
