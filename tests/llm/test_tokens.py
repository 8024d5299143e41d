"""Token counts and token files against the tokenizers library on whole texts."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from ripple.llm import pieces
from ripple.llm.token_counts import token_counts
from ripple.llm.token_store import EliasFano, TokenFile, read_tokens, write_tokens

TEXTS = [
    None, "", "  \n\t ", "Hello, World! It's 2024's best.", "x" * 5000, "don't can't we'll I'm they've she'd",
    "café CAFÉ café İstanbul ſtraße ŉ Αθήνα ΟΔΟΣ москва 東京 한국 😀 naïve space ½ ²   \x85 ­",
    "a <|endoftext|> b<|startoftext|>c <|EndOfText|> <|endoftext|>'s", "'S 'RE !'s ''ll 's's 't1 a1b2", "###\x00\x01 \x0b\x0c tail ",
    "Hello, World! It's 2024's best.", "the " * 3000, "﻿bom ​zero", "é' '́ ño",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, _key string")


def rows():
    out = [(i * 7 + 3, t, "clash", "clash") for i, t in enumerate(TEXTS)]
    return out + [(None, "no key", None, None), (3, "again", None, None), (3, "again", None, None)]


def test_counts(spark, library):
    got = token_counts(docs(spark, rows())).collect()
    want = sorted((str(k), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for k, t, *_ in rows())
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts(docs(spark, [])).collect() == []


def test_counts_when_nothing_is_frequent(spark, library, monkeypatch):
    import ripple.llm.token_counts as m
    monkeypatch.setattr(m, "HEAD", 3)
    got = token_counts(docs(spark, rows())).collect()
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows())
    assert sorted(r.n_tokens for r in got) == want


def test_files(spark, library, tmp_path):
    files = write_tokens(docs(spark, rows()), f"file://{tmp_path}", end_id=2)
    got = sorted(read_tokens(files).collect(), key=lambda r: (r.start, r.n_tokens))
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert [r.doc_id for r in got] == [r[0] for r in order]
    for r, (_, t, *_) in zip(got, order):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    f = TokenFile(files.orderBy("file").first().uri)
    assert f.ids(0).tolist() == library.encode(order[0][1] or "", add_special_tokens=False).ids + [2]
    assert read_tokens(write_tokens(docs(spark, []), f"file://{tmp_path}", end_id=2)).collect() == []


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-3, 0, 0, 9], list(range(1000)), [0] * 700 + [10**12], np.cumsum(np.arange(5000) % 97).tolist()])
def test_elias_fano(values):
    raw = EliasFano.dumps(np.array(values, dtype=np.int64))
    e = EliasFano.loads(raw)
    assert e.all().tolist() == values
    assert [e.select(i) for i in range(len(values))] == values
    if len(values) == 5000:
        assert len(raw) < 8 * len(values) / 4


def test_words_that_differ_in_case_or_a_final_mark_are_encoded_once(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, p, asked = Tokenizer.from_file(path), pieces.Pieces(path), []
    monkeypatch.setattr(p, "word_ids", lambda words, real=p.word_ids: (asked.extend(words), real(words))[1])
    pieces.encode_texts(p, pa.array(["Word word WORD, word. wOrd!", None, "wörd; WÖRD)"]))
    assert sorted(asked) == ["!", ")", ",", ".", ";", "word", "wörd"]
    odd = ["It's, IT'S. 's! a,, b., 7, x7. é, É) ª, ª. µ; Ÿ, ÿ. Ŀ, ŀ. ŉ? ſ! İ, ı. ×, ÷. Ø, a\u0301, \u00a0, word\u00a0, x\u0085, 東, Ω. <|x, a<|endoftext|>, <|endoftext|>. ,", "", " ", "a-b, a_b. A!B! (a) ñ)) ß, ẞ. ,a a,"]
    ids, offsets = pieces.encode_texts(p, pa.array(odd))
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == [x.ids for x in library.encode_batch(odd, add_special_tokens=False)]
    none, offsets = pieces.encode_texts(p, pa.array(["", None], pa.string()))
    assert len(none) == 0 and offsets.tolist() == [0, 0, 0]
