"""Pre-tokens of a word-level BPE file of the tokenizers library, and the ids of its words, counted once per word.

The library splits at white space before anything else, so a text's ids are those of its white-space-separated words
one after another. Words of plain Latin characters are split into pre-tokens by the file's own pattern; any other word
(special strings, other scripts, odd white space) is one pre-token that the library encodes as it stands.
"""

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ripple.llm.common import word_codes, words_of

#: Fixed value: the split pattern of the tokenizer file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words whose case folding and normal form change nothing but ASCII and Latin letters one by one.
PLAIN = regex.compile(r"[\x21-\x7E¡-įı-ſ]+")
#: Plain words of letters alone (``isalpha`` knows other categories than the pattern does).
LETTERS = regex.compile(r"[\p{L}]+")
#: Words remembered by a Python worker at most; others are counted again in their next batch.
MEMORY = 250_000
#: Pre-tokens that are encoded by one call.
CALL = 50
#: A plain word, for Arrow, and one whose last sign is a mark after a letter: the pattern cuts that mark off, whatever is before it.
PLAIN_WORD = r"\A[\x21-\x7E¡-įı-ſ]+\z"
MARKED = r"\pL[.,;:!?)]\z"


class Pieces:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(PATTERN)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.width = np.uint16 if len(self.ends) <= 1 << 16 else np.uint32
        self.ids_of: dict[str, bytes] = {}

    def pretokens(self, word: str) -> list[str]:
        """The pre-tokens of a word without white space; lower case, unless the library has to see it whole."""
        if "<|" in word or not PLAIN.fullmatch(word):
            return [word]
        return self.pattern.findall(word.lower())

    def encode(self, pretokens: list[str]) -> list[bytes]:
        """The ids of each pre-token, as little-endian integers of ``width``."""
        plain = ["<|" not in p and PLAIN.fullmatch(p) is not None for p in pretokens]
        known = iter(self.encode_plain([p for p, x in zip(pretokens, plain) if x]))
        rest = iter(self.encode_whole([p for p, x in zip(pretokens, plain) if not x]))
        return [next(known) if x else next(rest) for x in plain]

    def encode_plain(self, pretokens: list[str]) -> list[bytes]:
        """The ids of pre-tokens of plain words, many by one call; each ends with a piece that ends a word."""
        out: list[bytes] = []
        groups = [pretokens[i:i + CALL] for i in range(0, len(pretokens), CALL)]
        for g, line in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(line.ids, dtype=self.width)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(ends) != len(g):
                raise ValueError("a pre-token has no end")
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def encode_whole(self, words: list[str]) -> list[bytes]:
        return [np.array(line.ids, dtype=self.width).tobytes() for line in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word; of those in lower case, letters alone are one pre-token."""
        new = [w for w in words if w not in self.ids_of]
        found: dict[str, bytes] = {}
        if new:
            split, whole = {}, []
            for w in new:
                if w.isascii() and w.isalpha():
                    split[w] = (w.lower(),)
                elif "<|" in w or not PLAIN.fullmatch(w):
                    whole.append(w)
                elif w.isalpha() and LETTERS.fullmatch(w):
                    split[w] = (w.lower(),)
                else:
                    split[w] = self.pattern.findall(w.lower())
            distinct = list({p for x in split.values() for p in x})
            ids = dict(zip(distinct, self.encode_plain(distinct)))
            found = dict(zip(whole, self.encode_whole(whole)))
            found.update({w: ids[x[0]] if len(x) == 1 else b"".join([ids[p] for p in x]) for w, x in split.items()})
            room = MEMORY - len(self.ids_of)
            for w in new[:max(0, room)]:
                self.ids_of[w] = found[w]
        return [found[w] if w in found else self.ids_of[w] for w in words]


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def gather(values: np.ndarray, offsets: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[offsets[p]:offsets[p + 1]]`` of all picks in order, and the offsets of each."""
    sizes = np.diff(offsets)[picks]
    out_offsets = np.concatenate([[0], np.cumsum(sizes)])
    where = np.arange(out_offsets[-1]) + np.repeat(offsets[picks] - out_offsets[:-1], sizes)
    return values[where], out_offsets




def bare_words(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Plain words in lower case without the mark at their end, all others as they are; and where a mark was cut off."""
    plain = pc.and_(pc.match_substring_regex(words, PLAIN_WORD), pc.invert(pc.match_substring(words, "<|")))
    lower = pc.if_else(plain, pc.utf8_lower(words), words)
    marked = pc.and_(plain, pc.match_substring_regex(words, MARKED))
    return pc.if_else(marked, pc.utf8_slice_codeunits(lower, 0, -1), lower), np.asarray(marked)


def encode_texts(p: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a batch of whole texts, and the offsets of each text in them.

    Words that differ in case or in a mark at the end are encoded once.
    """
    flat, offsets = words_of(texts, lower=False)
    codes, distinct = word_codes(flat)
    bare, marked = bare_words(distinct)
    marks = pc.utf8_slice_codeunits(distinct.filter(pa.array(marked)), -1)
    # one part a word, and its mark after it
    own = np.arange(len(marked)) + np.cumsum(marked) - marked
    numbers, names = word_codes(pa.concat_arrays([bare, marks.cast(bare.type)]))
    parts = np.empty(len(numbers), dtype=np.int64)
    parts[own] = numbers[:len(own)]
    parts[own[marked] + 1] = numbers[len(own):]
    ids = p.word_ids(names.to_pylist())
    values = np.frombuffer(b"".join(ids), dtype=p.width)
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))]) // np.dtype(p.width).itemsize
    values, starts = gather(values, starts, parts)
    all_ids, word_offsets = gather(values, starts[np.append(own, len(parts))], codes)
    return all_ids, word_offsets[offsets]


def pretoken_frequencies(p: Pieces, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(text number, pre-token number, frequency) of a batch, and the distinct pre-tokens."""
    flat, offsets = words_of(texts, lower=False)
    codes, distinct = word_codes(flat)
    split = [p.pretokens(w) for w in distinct.to_pylist()]
    coded = pa.array([x for w in split for x in w], type=pa.string()).dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(np.fromiter(map(len, split), dtype=np.int64, count=len(split)))])
    tokens, token_offsets = gather(np.asarray(coded.indices, dtype=np.int64), starts, codes)
    names = coded.dictionary.to_pylist()
    text = np.repeat(np.arange(len(texts)), np.diff(token_offsets[offsets]))
    keys, n = np.unique(text * max(1, len(names)) + tokens, return_counts=True)
    return keys // max(1, len(names)), keys % max(1, len(names)), n, names
