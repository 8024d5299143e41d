import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings, strategies as st

import brute
from ripple.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(brute.ascii_lower(text))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def expected(docs, items, least=20, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s = Counter(bucket(f) for _, x in docs for f in features(x)[1])
    t = Counter(bucket(f) for x in items for f in features(x)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(10000)]
    rows = []
    for key, x in docs:
        w, f = features(x)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((i for i, r in enumerate(rows) if r[1] >= least), key=lambda i: (-rows[i][4], rows[i][0] is None, rows[i][0] or 0))
    rank = {i: n for n, i in enumerate(order[:percent * len(order) // 100], 1)}
    return sorted(((r[0], *r[2:], rank.get(i)) for i, r in enumerate(rows)), key=str)


def test_given_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = importance.op12_importance(spark, d)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(docs, items)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(importance, "CALL", 50)
    rows = [(1, None), (2, ""), (3, " \n\x00"), (4, "One"), (5, "ÄÖ x É y 日本 İ"), (None, "w " * 30), (None, "w " * 30), (7, "w " * 30), (7, "a b " * 30),
            (8, "long" * 30000), (9, "ab.c-d " * 20000), *((i, f"Word{i} and more " * 10) for i in range(20, 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1, "word21 and"), (2, None)], "item_id long, text string")
    got = importance.resampled(docs.selectExpr("*", "1 as score", "2 as rank", "3 as n", "4 as _key"), target).drop("n_words")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows, ["word21 and", None])
    none = importance.resampled(docs, target.where("false")).drop("n_words")
    assert sorted((tuple(r) for r in none.collect()), key=str) == expected(rows, [])
    assert importance.resampled(docs.where("false"), target).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aZ0 .\n\x00{é日😀ab"), max_size=40), max_size=5))
def test_windows(texts):
    low = [brute.ascii_lower(t) for t in texts]
    of, spans, crc = importance.windows(importance.Words(low), 3)
    got = sorted(zip(of.tolist(), spans.tolist(), crc.tolist()))
    want = []
    for i, t in enumerate(low):
        w = list(WORD.finditer(t))
        want += [(i, [w[a].start(), w[b - 1].end()], zlib.crc32(" ".join(x[0] for x in w[a:b]).encode())) for a in range(len(w)) for b in range(a + 1, min(len(w), a + 3) + 1)]
    assert got == sorted(want)


def test_crc_of_joined_strings():
    r = np.random.default_rng(5)
    a, b = ([r.bytes(int(n)) for n in r.integers(0, 5000, 50)] for _ in range(2))
    crc = lambda x: np.array([zlib.crc32(y) for y in x], dtype=np.uint32)
    assert importance.joined_crc(crc(a), crc(b), np.array([len(x) for x in b])).tolist() == crc([x + y for x, y in zip(a, b)]).tolist()
