"""Token ids of a corpus as binary files whose document boundaries are Elias-Fano encoded."""

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ripple.llm.common import cut, slices, table
from ripple.llm.pieces import encode_texts, pieces
from ripple.session import scratch_root

#: File: ids | document ids | boundaries | footer. Footer: magic, documents, null keys, ids, id width, bytes of both lists.
FOOTER = "<8sQQQQQQ"
MAGIC = b"EFTOKEN1"
#: Head of an Elias-Fano list: values, universe, first value, low bits, samples. A sample is the place of each 256th one bit.
HEAD = "<QQqQQ"
SAMPLE = 256
PIECE = 6 << 20


class EliasFano:
    """A non-decreasing list: low bits packed as they are, high bits in unary, and samples to select from."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits, self.low, self.high, self.samples = n, base, low_bits, low, high, samples

    @staticmethod
    def dumps(values: np.ndarray) -> bytes:
        n, base = len(values), int(values[0]) if len(values) else 0
        v = (values.astype(np.int64) - base).astype(np.uint64)
        universe = int(v[-1]) + 1 if n else 0
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        bits = (v[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        ones = (v >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        samples = ones[::SAMPLE].astype(np.uint32)
        return struct.pack(HEAD, n, universe, base, low_bits, len(samples)) + samples.tobytes() + low.tobytes() + np.packbits(high, bitorder="little").tobytes()

    @classmethod
    def loads(cls, raw: bytes) -> "EliasFano":
        n, _, base, low_bits, n_samples = struct.unpack_from(HEAD, raw)
        at = struct.calcsize(HEAD)
        samples = np.frombuffer(raw, np.uint32, n_samples, at)
        at += samples.nbytes
        n_low = (n * low_bits + 7) // 8
        low = np.frombuffer(raw, np.uint8, n_low, at)
        return cls(n, base, low_bits, low, np.frombuffer(raw, np.uint8, offset=at + n_low), samples)

    def _lows(self, start: int, stop: int) -> np.ndarray:
        a, b = start * self.low_bits, stop * self.low_bits
        bits = np.unpackbits(self.low[a // 8:(b + 7) // 8], bitorder="little")[a % 8:a % 8 + b - a]
        return bits.reshape(stop - start, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def select(self, i: int) -> int:
        """The i-th value, read from its sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block, left = divmod(i, SAMPLE)
        at, first = int(self.samples[block]) // 8, int(self.samples[block])
        end = int(self.samples[block + 1]) // 8 + 1 if block + 1 < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at:end], bitorder="little")) + at * 8
        one = int(ones[np.searchsorted(ones, first) + left])
        return self.base + ((one - i) << self.low_bits) + int(self._lows(i, i + 1)[0])

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[:self.n]
        return self.base + ((ones - np.arange(self.n)) << self.low_bits) + self._lows(0, self.n)


class TokenFile:
    """One written file: ``ids(i)`` are the ids of its i-th document."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        size, foot = self.file.size(), struct.calcsize(FOOTER)
        self.file.seek(size - foot)
        magic, self.n, self.nulls, self.n_ids, width, n_keys, n_bounds = struct.unpack(FOOTER, self.file.read())
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token file")
        self.dtype = np.dtype(f"<u{width}")
        self.file.seek(size - foot - n_keys - n_bounds)
        self.keys = EliasFano.loads(self.file.read(n_keys))
        self.bounds = EliasFano.loads(self.file.read(n_bounds))

    def ids(self, i: int, j: int | None = None) -> np.ndarray:
        """The ids of documents i to j - 1 (of document i alone without j)."""
        start, stop = self.bounds.select(i), self.bounds.select(i + 1 if j is None else j)
        self.file.seek(start * self.dtype.itemsize)
        return np.frombuffer(self.file.read((stop - start) * self.dtype.itemsize), dtype=self.dtype)


def write_tokens(docs: DataFrame, root: str, end_id: int, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Write the ids of all texts in ascending order of ``key`` and return the stored list of files.

    Documents are range-partitioned by key and each task writes one file, under a name of its own, so a task that runs
    twice harms nothing: the list names the file of the attempt that counted. ``file, uri, n_docs, n_ids, first`` where
    ``first`` is the number of ids in all files before. A null text is an empty one; rows with a null key come
    first; rows with equal keys follow each other by text. An empty table gives an empty list.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    docs = docs.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def write(batches):
        p = pieces(path)
        number = TaskContext.get().partitionId()
        uri, out, n_ids, n_docs = f"{root}/ids-{number:07d}-{uuid.uuid4().hex}.tok", None, 0, 0
        keys, bounds, nulls = [], [np.zeros(1, dtype=np.int64)], 0
        for batch in batches:
            for part in slices(batch, "_text", PIECE):
                if out is None:
                    fs, local = pa.fs.FileSystem.from_uri(uri)
                    out = fs.open_output_stream(local)
                ids, offsets = encode_texts(p, part.column("_text"))
                ids = np.insert(ids, offsets[1:], p.width(end_id))
                ends = offsets[1:] + np.arange(1, len(offsets)) + n_ids
                nulls += part.column("_key").null_count
                keys.append(np.asarray(part.column("_key").drop_null(), dtype=np.int64))
                bounds.append(ends)
                out.write(ids.tobytes())
                n_ids, n_docs = n_ids + len(ids), n_docs + len(part)
        if out is not None:
            k, b = EliasFano.dumps(np.concatenate(keys)), EliasFano.dumps(np.concatenate(bounds))
            out.write(k + b + struct.pack(FOOTER, MAGIC, n_docs, nulls, n_ids, np.dtype(p.width).itemsize, len(k), len(b)))
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [number], "uri": [uri], "n_docs": [n_docs], "n_ids": [n_ids]},
                                             pa.schema([("file", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    spread = docs.repartitionByRange("_key").sortWithinPartitions("_key", "_text")
    files = cut(spread.mapInArrow(write, "file long, uri string, n_docs long, n_ids long"), "token_files")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one short row a file
    return files.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(files: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document from the files themselves: ``key, start, n_tokens, ids_crc32``."""
    def read(batches):
        for batch in batches:
            for uri, first in zip(batch.column("uri").to_pylist(), batch.column("first").to_pylist()):
                f = TokenFile(uri)
                bounds = f.bounds.all()
                keys = [None] * f.nulls + f.keys.all().tolist()
                for a in range(0, f.n, 4096):
                    b = min(a + 4096, f.n)
                    ids = f.ids(a, b).astype("<u4")
                    at = bounds[a:b + 1] - bounds[a]
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1], at[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[a:b], pa.int64()), pa.array(bounds[a:b] + first), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                        [key, "start", "n_tokens", "ids_crc32"])

    spread = files.select("uri", "first", "file").repartition(F.col("file"))
    return spread.mapInArrow(read, f"{key} long, start long, n_tokens long, ids_crc32 long")


def store_tokens(spark: SparkSession, docs: DataFrame) -> DataFrame:
    root = f"{scratch_root(spark)}/tokens_{uuid.uuid4().hex}"
    fs, local = pa.fs.FileSystem.from_uri(root)
    fs.create_dir(local, recursive=True)
    return read_tokens(write_tokens(docs, root, end_id=2))


def op7_token_store(spark, sf_dir):
    return store_tokens(spark, table(spark, sf_dir, "documents"))
