"""Benchmark items inside documents: MinHash containment search by item size, confirmed on exact shingles."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ripple.llm.common import multipliers, shingle_hashes, slices, table

#: Words of a shingle, share of an item's shingles that a document must hold, and MinHash values of a window.
SIZE, SHARE, N = 5, 0.8, 64
SEED = 23
#: Items whose index is sent to every task at a time; more items take more passes over the documents.
BLOCK = 4096
#: Low bits of a MinHash value by which the index is looked up first.
LOW = 16
#: Bytes of text that are worked on at a time.
PIECE = 1 << 20


class ItemIndex:
    """MinHash values of a block of items, by size class k (2^k to 2^(k+1) - 1 distinct shingles)."""

    def __init__(self, ids: list, texts: list[str]):
        h, at = shingle_hashes(pa.array(texts, pa.string()), SIZE)
        self.ids, self.sets = [], []
        for i, x in enumerate(ids):
            own = np.unique(h[at[i]:at[i + 1]])
            if len(own):
                self.ids.append(x)
                self.sets.append(own)
        self.by_class = {}
        a = multipliers(N, SEED)
        classes = np.array([len(s).bit_length() - 1 for s in self.sets], dtype=np.int64)
        for k in sorted(set(classes.tolist())):
            who = np.flatnonzero(classes == k)
            least = np.array([[(self.sets[i] * m).min() for m in a] for i in who], dtype=np.uint64)
            coarse = np.zeros((N, 1 << LOW), dtype=bool)
            coarse[np.tile(np.arange(N), len(who)), (least & np.uint64((1 << LOW) - 1)).astype(np.int64).ravel()] = True
            coarse = np.packbits(coarse, axis=1, bitorder="little")  # every worker holds its own copy
            exact = []
            for j in range(N):
                order = np.argsort(least[:, j], kind="stable")
                exact.append((least[order, j], who[order]))
            self.by_class[k] = (coarse, exact)

    def candidates(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text number, item number) of windows that share a MinHash value with an item of their class.

        A window of class k is two neighbouring blocks of 2^(k+1) shingles, so an item's whole run lies in one. A window
        that holds SHARE of an item has a Jaccard similarity of 0.19 at least, and misses all N values once in 10^5.
        """
        n = np.diff(at)
        if not len(h) or not self.by_class:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        classes = sorted(self.by_class)
        base = 1 << (classes[0] + 1)
        full = np.flatnonzero(n)
        blocks = -(-n[full] // base)  # blocks of each text that has any
        first = np.repeat(at[:-1][full], blocks) + (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)) * base
        found = []
        owners, levels = {classes[0]: np.repeat(full, blocks)}, blocks
        for k in range(classes[0] + 1, classes[-1] + 1):
            levels = -(-levels // 2)
            owners[k] = np.repeat(full, levels)
        for j, a in enumerate(multipliers(N, SEED)):
            least, count = np.minimum.reduceat(h * a, first), blocks
            for k in range(classes[0], classes[-1] + 1):
                if k > classes[0]:
                    least, count = _pairwise(least, count)
                if k not in self.by_class:
                    continue
                owner = owners[k]
                window = least.copy()
                same = owner[1:] == owner[:-1]
                window[:-1][same] = np.minimum(least[:-1], least[1:])[same]
                coarse, exact = self.by_class[k]
                low = (window & np.uint64((1 << LOW) - 1)).astype(np.int64)
                hit = np.flatnonzero((coarse[j][low >> 3] >> (low & 7).astype(np.uint8)) & 1)
                values, who = exact[j]
                lo, hi = np.searchsorted(values, window[hit]), np.searchsorted(values, window[hit], side="right")
                some = hi > lo
                for i, x, y in zip(hit[some], lo[some], hi[some]):
                    found.extend((int(owner[i]), int(w)) for w in who[x:y])
        pairs = np.array(sorted(set(found)), dtype=np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def matches(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text number, item number, shingles of the item, of them in the text) with at least SHARE of the item."""
        h, at = shingle_hashes(texts, SIZE)
        out, last, own = [], -1, None
        for t, i in zip(*self.candidates(h, at)):
            if t != last:
                last, own = t, np.unique(h[at[t]:at[t + 1]])
            item = self.sets[i]
            place = np.minimum(np.searchsorted(own, item), len(own) - 1)
            both = int(np.count_nonzero(own[place] == item))
            if both >= SHARE * len(item):
                out.append((int(t), int(i), len(item), both))
        return out


def _pairwise(least: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Minima of pairs of neighbouring blocks of each text; the last block of an odd number stays alone."""
    half = -(-count // 2)
    start = np.repeat(np.cumsum(count) - count, half) + 2 * (np.arange(half.sum()) - np.repeat(np.cumsum(half) - half, half))
    end = np.repeat(np.cumsum(count), half)
    return np.minimum(least[start], least[np.minimum(start + 1, end - 1)]), half


def indexes(items: DataFrame, key: str = "item_id", text: str = "text") -> list[ItemIndex]:
    """The items, a benchmark and so a stated query set, in blocks of BLOCK; repeated rows count once."""
    blocks, ids, texts = [], [], []
    for r in items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").distinct().orderBy("k", "t").toLocalIterator():
        ids.append(r.k)
        texts.append(r.t)
        if len(ids) == BLOCK:
            blocks.append(ItemIndex(ids, texts))
            ids, texts = [], []
    return blocks + ([ItemIndex(ids, texts)] if ids else [])


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``key, item, n_shingles, n_shared, containment`` for each row and item it holds at least SHARE of.

    Windows of each size class are looked up in the index of that class, whole texts are checked on the candidates. All of
    it happens where the text lies, nothing is shuffled. A null or empty text or item matches nothing. A text of fewer
    than five words is one shingle, so an item that short is found in an equal text only. Rows that repeat a key or have none
    give rows of their own. Other columns are ignored.
    """
    out = None
    kind, item_kind = docs.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    shape = f"{key} {kind}, {item} {item_kind}, n_shingles long, n_shared long, containment double"
    for block in indexes(items, item):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def search(batches, shared=shared):
            index = shared.value
            for batch in batches:
                for part in slices(batch, "_text", PIECE):
                    if got := index.matches(part.column("_text")):
                        t, i, n, both = (np.array(x) for x in zip(*got))
                        yield pa.RecordBatch.from_arrays(
                            [part.column("_key").take(pa.array(t)), pa.array([index.ids[x] for x in i]).cast(item_type(item_kind)), pa.array(n), pa.array(both), pa.array(both / n)],
                            [key, item, "n_shingles", "n_shared", "containment"])

        found = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(search, shape)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], shape) if out is None else out


def item_type(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def clean_documents(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item."""
    for block in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def keep(batches, shared=shared):
            for batch in batches:
                for part in slices(batch, text, PIECE):
                    good = np.ones(len(part), dtype=bool)
                    good[[m[0] for m in shared.value.matches(part.column(text))]] = False
                    yield part.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op6_containment(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _shingles_sql(source: str, key: str) -> str:
    return rf"""SELECT {key}, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {SIZE} + 2), lambda i: array_to_string(w[i:i + {SIZE} - 1], ' ')) END)) AS s
      FROM (SELECT {key}, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM {source})"""


OP6_SQL = f"""
WITH d AS ({_shingles_sql('documents', 'doc_id')}), i AS ({_shingles_sql('benchmark', 'item_id')}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS got FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_shingles, got AS n_shared, got::DOUBLE / n AS containment FROM m JOIN n USING (item_id) WHERE got >= {SHARE} * n
"""
