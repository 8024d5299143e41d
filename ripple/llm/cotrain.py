"""A quality classifier by co-training: a view of the words and a view of the page's metadata teach each other."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ripple.llm.common import compact, cut, slices, table, word_codes, words_of

#: Hashed words of the text view, and hashed sources and languages of the metadata view.
WORDS, SOURCES, LANGS = 192, 32, 8
#: Labelled rows that the driver fits on (a sample by hash, of twice as many at most), and pseudo-labels per view, class and round.
SAMPLE, POOL = 20_000, 5_000
ROUNDS = 2
#: A view hands on a label if its calibrated probability is this far from the middle.
SURE = 0.98
#: One in so many labelled rows calibrates the views and is never fitted on.
HELD_OUT = 4
#: Byte classes of the metadata view.
KINDS = np.zeros(256, dtype=np.uint8)
KINDS[[9, 11, 12, 13, 32]] = 1
KINDS[10] = 2
KINDS[48:58] = 3
KINDS[65:91] = 4
KINDS[97:123] = 5
KINDS[128:] = 6


def views(texts: pa.Array, langs: pa.Array, sources: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The two feature matrices of a batch of whole texts."""
    texts = compact(texts)
    n = len(texts)
    flat, offsets = words_of(texts)
    codes, distinct = word_codes(flat)
    names = distinct.to_pylist()
    doc = np.repeat(np.arange(n), np.diff(offsets))
    sums = lambda x: np.bincount(doc, x, n)
    total = np.maximum(np.diff(offsets), 1)
    bucket = np.fromiter((zlib.crc32(w.encode()) % WORDS for w in names), dtype=np.int64, count=len(names))
    length = np.fromiter(map(len, names), dtype=np.int64, count=len(names))
    marks = np.fromiter((sum(not c.isalnum() for c in w) for w in names), dtype=np.int64, count=len(names))
    hashed = np.log1p(np.bincount(doc * WORDS + bucket[codes], minlength=n * WORDS).reshape(n, WORDS))
    hashed /= np.maximum(np.linalg.norm(hashed, axis=1, keepdims=True), 1e-9)
    pair, times = np.unique(doc * max(1, len(names)) + codes, return_counts=True)
    of = pair // max(1, len(names))
    most = np.zeros(n)
    np.maximum.at(most, of, times)
    again = np.zeros(len(codes))
    again[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    word = np.stack([
        np.bincount(of, minlength=n) / total, most / total, sums(again) / total, sums(length[codes].astype(float)) / total / 10,
        sums(marks[codes].astype(float)) / total, sums((marks[codes] == length[codes]).astype(float)) / total,
        sums((marks[codes] >= 2).astype(float)) / total, np.diff(offsets) == 0], axis=1)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
    kinds = KINDS[raw]
    size = np.diff(at)
    full = np.flatnonzero(size)
    share = np.zeros((n, 7))
    for k in range(7 if len(full) else 0):  # the rows between two full ones are empty, so their starts delimit them
        share[full, k] = np.add.reduceat((kinds[: at[-1]] == k).astype(np.int32), at[full])
    lines = share[:, 2] + 1
    share /= np.maximum(size, 1)[:, None]
    name = lambda column, m, salt: np.eye(m)[[zlib.crc32(f"{salt}{x}".encode()) % m for x in column.to_pylist()]].reshape(n, m)
    meta = np.concatenate([share, np.stack([np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10], axis=1),
                           name(sources, SOURCES, "s"), name(langs, LANGS, "l")], axis=1)
    return np.concatenate([hashed, word], axis=1).astype(np.float32), meta.astype(np.float32)


#: Rows of a matrix that the fit copies at a time.
ROWS = 2048


class View:
    """Logistic regression over standardised features, calibrated by a slope and an offset on held-out rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cx: np.ndarray, cy: np.ndarray):
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        self.w = _logistic(x, y, 1.0, self.mean, self.scale)
        self.a, self.b = 1.0, 0.0
        if len(set(cy.tolist())) == 2:
            self.a, self.b = _logistic(self.raw(cx)[:, None], cy, 1.0)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale @ self.w[:-1] + self.w[-1], -30, 30)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.raw(x) * self.a + self.b, -30, 30)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float, mean: np.ndarray | float = 0.0, scale: np.ndarray | float = 1.0) -> np.ndarray:
    """Newton steps over the standardised columns of ``x`` and an offset; only ``ROWS`` rows at a time are copied."""
    n = x.shape[1] + 1
    w, penalty = np.zeros(n), np.full(n, ridge)
    penalty[-1] = 1e-6
    for _ in range(15):
        gradient, hessian = -penalty * w, np.diag(penalty)
        for a in range(0, len(x), ROWS):
            part = np.concatenate([(x[a:a + ROWS].astype(np.float64) - mean) / scale, np.ones((len(x[a:a + ROWS]), 1))], axis=1)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            gradient += part.T @ (y[a:a + ROWS] - p)
            hessian += (part * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ part
        step = np.linalg.solve(hessian, gradient)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


class Model:
    """Both views and the weights that combine their calibrated logits."""

    def __init__(self, words: View, meta: View, both: np.ndarray):
        self.words, self.meta, self.both = words, meta, both

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.words.logit(x), self.meta.logit(m)
        return probability(a), probability(b), probability(np.clip(a * self.both[0] + b * self.both[1] + self.both[2], -30, 30))


def _matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    read = lambda c: np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.float16).reshape(len(batch), -1).astype(np.float32)
    return read("words"), read("meta")


def features(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, words, meta``: both views of each row as 16-bit floats."""
    def build(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                x, m = (v.astype(np.float16) for v in views(part.column("_text"), part.column("_lang"), part.column("_source")))
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in m], pa.binary())], [key, "words", "meta"])

    return _inputs(docs, key).mapInArrow(build, f"{key} {docs.schema[key].dataType.simpleString()}, words binary, meta binary")


def _inputs(docs: DataFrame, *keep: str) -> DataFrame:
    """The text, language and source of each row; a table without one of the last two has nulls there."""
    column = lambda c: (F.col(c) if c in docs.columns else F.lit(None)).cast("string")
    return docs.select(*keep, F.coalesce(column("text"), F.lit("")).alias("_text"), column("lang").alias("_lang"), column("source").alias("_source"))


def fit(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> Model | None:
    """Co-train both views on stored ``features`` and labels 0 / 1; None where the labels do not hold both classes.

    The first views are fitted on a sample of about ``SAMPLE`` labelled rows, chosen by a hash of the key; a quarter of it
    only calibrates. In each of ``ROUNDS`` rounds all unlabelled rows are scored where they lie, and up to about ``POOL`` rows
    that a view is ``SURE`` of, for each class, join the other view's training rows. A key with several labels counts as the
    lowest; null labels are none.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).alias("_y"))
    order = F.xxhash64(F.lit("label"), key)
    share = min(1.0, SAMPLE / max(1, known.count()))
    sample = known.where(F.pmod(order, F.lit(1 << 30)) < share * (1 << 30)).limit(2 * SAMPLE)  # about SAMPLE; the limit bounds what is sent
    got = rows.join(F.broadcast(sample), key).select("words", "meta", "_y", (F.pmod(F.shiftright(order, 32), F.lit(HELD_OUT)) == 0).alias("_held")).limit(2 * SAMPLE).toArrow()
    if not got.num_rows:
        return None
    x, m = _matrices(got.combine_chunks().to_batches()[0])
    y, held = np.asarray(got.column("_y"), dtype=np.float64), np.asarray(got.column("_held"))
    if len(set(y[~held].tolist())) < 2:
        return None
    extra_x, extra_m = (x[:0], y[:0]), (m[:0], y[:0])
    for turn in range(ROUNDS + 1):
        words = View(np.concatenate([x[~held], extra_x[0]]), np.concatenate([y[~held], extra_x[1]]), x[held], y[held])
        meta = View(np.concatenate([m[~held], extra_m[0]]), np.concatenate([y[~held], extra_m[1]]), m[held], y[held])
        if turn < ROUNDS:
            extra_x, extra_m = _pseudo_labels(rows, known, words, meta, key, turn)
    c = held if len(set(y[held].tolist())) == 2 else np.ones(len(y), dtype=bool)
    return Model(words, meta, _logistic(np.stack([words.logit(x[c]), meta.logit(m[c])], axis=1), y[c], 1.0))


def _pseudo_labels(rows: DataFrame, known: DataFrame, words: View, meta: View, key: str, turn: int) -> tuple:
    """What each view is sure of, as (features of the other view, label): for the text view, for the metadata view."""
    def judge(batches):
        for batch in batches:
            if len(batch):
                x, m = _matrices(batch)
                sides = [np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1)) for p in (probability(words.logit(x)), probability(meta.logit(m)))]
                sure = pa.array((sides[0] >= 0) | (sides[1] >= 0))
                out = [batch.column(key), *(pa.array(v.astype(np.int32)) for v in sides)]
                yield pa.RecordBatch.from_arrays(out, [key, "by_words", "by_meta"]).filter(sure)

    kind = rows.schema[key].dataType.simpleString()
    sure = rows.mapInArrow(judge, f"{key} {kind}, by_words int, by_meta int").join(known.select(key), key, "left_anti")
    sure = cut(sure.where(F.col(key).isNotNull()), "sure")
    n = {(r.by_words, r.by_meta): r["count"] for r in sure.groupBy("by_words", "by_meta").count().collect()}  # nine rows at most
    chance = F.pmod(F.xxhash64(F.lit(turn), key), F.lit(1 << 30)) / (1 << 30)
    share = F.lit(0.0)
    for column, place in (("by_words", 0), ("by_meta", 1)):
        for c in (0, 1):
            some = sum(v for k, v in n.items() if k[place] == c)
            share = F.greatest(share, F.when(F.col(column) == c, min(1.0, POOL / max(1, some))).otherwise(0.0))
    chosen = sure.where(chance < share).groupBy(key).agg(F.min("by_words").alias("by_words"), F.min("by_meta").alias("by_meta"))
    chosen = chosen.limit(8 * POOL)  # four pools are expected; the limit bounds what is sent
    got = rows.join(F.broadcast(chosen), key).select("words", "meta", "by_words", "by_meta").toArrow()
    if not got.num_rows:
        return tuple((np.zeros((0, len(v.mean)), np.float32), np.zeros(0)) for v in (words, meta))
    x, m = _matrices(got.combine_chunks().to_batches()[0])
    by_words, by_meta = (np.asarray(got.column(c)) for c in ("by_words", "by_meta"))
    return (x[by_meta >= 0], by_meta[by_meta >= 0].astype(np.float64)), (m[by_words >= 0], by_words[by_words >= 0].astype(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, words_score, meta_score, score, kept`` of every row: calibrated probabilities of good quality.

    A row is kept if the combined probability is at least one half. Null and empty texts are scored as texts without
    words. Rows with null or repeated keys are scored each by itself. Without labels of both classes the scores are null and
    every row is kept. Columns other than the key, text, lang and source are ignored.
    """
    rows = cut(features(docs, key), "features")
    model = fit(rows, labels, key)
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select(key, none.alias("words_score"), none.alias("meta_score"), none.alias("score"), F.lit(True).alias("kept"))

    def score(batches):
        for batch in batches:
            if len(batch):
                a, b, s = (v.astype(np.float64) for v in model.scores(*_matrices(batch)))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(a), pa.array(b), pa.array(s), pa.array(s >= 0.5)], [key, "words_score", "meta_score", "score", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(score, f"{key} {kind}, words_score double, meta_score double, score double, kept boolean")


def good_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_scores`` keeps."""
    model = fit(cut(features(docs, key), "features"), labels, key)
    if model is None:
        return docs
    names = [("text", pa.string()), ("lang", pa.string()), ("source", pa.string())]

    def choose(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                own = [part.column(c) if c in part.schema.names else pa.nulls(len(part), kind) for c, kind in names]
                x, m = (v.astype(np.float16).astype(np.float32) for v in views(*own))
                yield part.filter(pa.array(model.scores(x, m)[2] >= 0.5))

    return docs.mapInArrow(choose, docs.schema)


def op10_cotraining(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
