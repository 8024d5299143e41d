"""Token counts of whole texts: pieces are counted once per distinct pre-token and joined to pre-token frequencies."""

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import public_tokenizers
from pyspark.sql import DataFrame, functions as F

from ripple.llm.common import cut, slices, table
from ripple.llm.pieces import pieces, pretoken_frequencies

#: Pre-tokens that count as frequent: their counts are sent to every task, the others are joined by a shuffle.
HEAD = 50_000
#: Text in a piece of a batch, and distinct pre-tokens that a task holds before it hands them on.
PIECE, HELD = 8 << 20, 150_000


def lexicon(docs: DataFrame, text: str, path: str) -> DataFrame:
    """``pretoken, n, n_pieces``: every distinct pre-token of the corpus, its frequency and its number of pieces."""
    def frequencies(batches):
        held: dict[str, int] = {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pretoken", "n"])

        for batch in batches:
            for part in slices(batch, text, PIECE):
                _, token, n, names = pretoken_frequencies(pieces(path), part.column(text))
                totals = np.bincount(token, weights=n, minlength=len(names)).astype(np.int64)
                for w, k in zip(names, totals.tolist()):
                    held[w] = held.get(w, 0) + k
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        if held:
            yield rows()

    def counted(batches):
        for batch in batches:
            p = pieces(path)
            size = np.dtype(p.width).itemsize
            n = [len(x) // size for x in p.encode(batch.column("pretoken").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("pretoken"), batch.column("n"), pa.array(n, pa.int64())], ["pretoken", "n", "n_pieces"])

    found = docs.select(text).mapInArrow(frequencies, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return cut(found.mapInArrow(counted, "pretoken string, n long, n_pieces long"), "lexicon")


def _frequent(words: DataFrame) -> DataFrame:
    """The pre-tokens seen at least 2^k times, for the smallest k that leaves at most HEAD of them."""
    levels = words.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()  # one row per power of two
    room, least = HEAD, 64
    for k, count in sorted(((r.k, r["count"]) for r in levels), reverse=True):
        room -= count
        if room < 0:
            break
        least = k
    return words.where(F.col("n") >= F.lit(float(2**least)))


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """``key, n_bytes, n_tokens`` of each row, as the tokenizers library counts them for the file at ``path``.

    The lexicon holds every distinct pre-token with its number of pieces. A second pass over the texts makes
    pre-token frequencies by document. The most frequent pre-tokens (at most ``HEAD``, whatever the corpus)
    are sent to the tasks and added up there, so that no frequent pre-token is shuffled; all others are joined to the
    lexicon. Ids are never made for a text. A null or empty text has 0 bytes and 0 tokens; repeated rows and null or
    repeated keys keep a row each; other columns are ignored.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    docs = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    words = lexicon(docs, "_text", path)
    head = dict(_frequent(words).select("pretoken", "n_pieces").collect())
    shared = docs.sparkSession.sparkContext.broadcast(head)
    kind = docs.schema["_key"].dataType.simpleString()

    def split(batches):
        known = shared.value
        for batch in batches:
            for part in slices(batch, "_text", PIECE):
                texts = part.column("_text")
                doc, token, n, names = pretoken_frequencies(pieces(path), texts)
                size = np.fromiter((known.get(w, -1) for w in names), dtype=np.int64, count=len(names))[token]
                sums = np.bincount(doc, weights=np.where(size >= 0, n * size, 0), minlength=len(texts)).astype(np.int64)
                rare = np.flatnonzero(size < 0)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[rare], minlength=len(texts)))])
                tails = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(names, pa.string()).take(pa.array(token[rare])))
                counts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(n[rare], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_key"), pa.compute.binary_length(texts).cast(pa.int64()), pa.array(sums), tails, counts],
                    ["_key", "n_bytes", "head", "rare", "times"])

    rows = docs.mapInArrow(split, f"_key {kind}, n_bytes long, head long, rare array<string>, times array<long>")
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "frequencies")  # stored, so the numbers stay
    tail = rows.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("_row", F.col("x.rare").alias("pretoken"), "x.times")
    tail = tail.join(words.select("pretoken", "n_pieces"), "pretoken").groupBy("_row").agg(F.sum(F.col("times") * F.col("n_pieces")).alias("tail"))
    return rows.join(tail, "_row", "left").select(
        F.col("_key").alias(key), "n_bytes", (F.col("head") + F.coalesce("tail", F.lit(0))).alias("n_tokens"))


def op8_token_counts(spark, sf_dir):
    counts = token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
