import duckdb
import numpy as np
import pyarrow as pa

import brute
from ripple.llm.common import shingle_hashes, slices, words_of


def test_words_of_slices():
    texts = [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()] + [None, "", " A  b\x0b", "é\x85ü x"]
    batch = pa.RecordBatch.from_pydict({"text": texts})
    got = [words_of(part.column("text")) for part in slices(batch, "text", 100_000)]
    assert len(got) > 5
    lists = [flat.to_pylist()[a:b] for flat, at in got for a, b in zip(at[:-1], at[1:])]
    assert lists == [brute.WORD.findall(brute.ascii_lower(t)) for t in texts]


def test_shingles_count():
    texts = ["a b c d", "a b", "", None, "A b C d e", "b c d"]
    h, at = shingle_hashes(pa.array(texts), 3)
    assert np.diff(at).tolist() == [2, 1, 0, 0, 3, 1]
    assert set(h[at[0]:at[1]]) < set(h[at[4]:at[5]]) and h[at[5]] in h[at[0]:at[1]]
