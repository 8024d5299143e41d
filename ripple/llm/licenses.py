"""License scans: winnowed fingerprints pick candidate templates, banded alignment reports what matches where."""

import bisect
import functools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from ripple.llm.common import WORD, cut, mix, slices, table, word_codes, words_of, ODD

#: Words of a gram and grams of a winnowing window: a run of GRAM + WINDOW - 1 equal words shares a fingerprint.
GRAM, WINDOW = 3, 3
#: Most diagonals an alignment may leave its candidate's own by, the least share to report, and templates with fewer words must match in full.
BAND, COVERAGE, FEW = 12, 0.8, 10
#: Most templates and characters of templates whose index is sent to every task at a time; more templates take more passes.
BLOCK, BLOCK_CHARS = 2000, 4 << 20
PIECE = 8 << 20
#: Cells of an alignment table that are held at a time.
CELLS = 4 << 20
#: Bits of an alignment's state that hold its first word, and the cost, in quarters, of leaving out a word that tells licenses apart.
LOW, NEVER = 21, 1 << 22

#: Well-known license lines and notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
                      "You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                         "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
                         "See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                      "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
                      "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
                      "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
                      "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
                       "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
                       "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
                       "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be "
                       "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-2.0-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the "
                       "Free Software Foundation; either version 2 of the License, or (at your option) any later version. This library is distributed in the hope that it will be "
                       "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
                       "Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
                       "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-nd-4.0-line": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "cc0-1.0-notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. "
                      "This software is distributed without any warranty.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
                      "https://www.eclipse.org/legal/epl-2.0/",
    "epl-1.0-notice": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this "
                      "distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
                 "copyright notice and this permission notice appear in all copies.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
           "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
           "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
           "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
                 "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
                 "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
           "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
           "permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
           "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
           "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
           "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                    "other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
                    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
                    "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
                    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
                    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF "
                    "SUCH DAMAGE.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
                    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
                    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
                    "other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY "
                    "EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
                    "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
                    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
                    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
                    "POSSIBILITY OF SUCH DAMAGE.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this "
            "software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to "
            "the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software "
            "in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must "
            "not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
                 "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
                 "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
                 "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
                 "future rights to this software under copyright law.",
}
#: Words that tell licenses of the same wording apart; numbers of one or two digits, with or without a "v", do so too.
TELLING = ["affero", "lesser", "bync", "bynd", "bysa", "byncnd", "byncsa", "nc", "nd", "sa"]

_MARKS = re.compile(r"[\W_]+")


def _plain(word: str) -> str:
    """A word without punctuation, so that comment signs and full stops do not count."""
    return _MARKS.sub("", word.lower())


def _plain_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Plain words of a batch that are not empty, offsets of the texts in them, and each one's number among all words."""
    flat, offsets = words_of(texts)
    codes, distinct = word_codes(flat)
    plain = pa.array([_plain(w) for w in distinct.to_pylist()], pa.string())
    full = np.asarray(pa.compute.greater(pa.compute.binary_length(plain), 0))[codes] if len(codes) else np.zeros(0, bool)
    where = np.arange(len(codes)) - np.repeat(offsets[:-1], np.diff(offsets))
    return plain.take(pa.array(codes[full])), np.concatenate([[0], np.cumsum(full)])[offsets], where[full]


def _grams(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hash of the gram that starts at each word; 0 where it would leave its text."""
    n = len(hashes)
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        part = np.zeros(n, dtype=np.uint64)
        part[: max(0, n - k)] = hashes[k:]
        rolled = mix(rolled * ODD[0] + part)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    rolled[left < GRAM] = 0
    return rolled


def _winnowed(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the last smallest gram of each window of WINDOW grams of a text."""
    n = len(grams)
    chosen = np.zeros(n, dtype=bool)
    if not n:
        return np.flatnonzero(chosen)
    ends = np.repeat(offsets[1:], np.diff(offsets)) - (GRAM - 1)  # grams of the text end here
    top = np.uint64(2**64 - 1)
    padded = np.concatenate([grams, np.full(WINDOW, top, dtype=np.uint64)])
    place = np.arange(n)
    best, where = np.full(n, top, dtype=np.uint64), place.copy()
    for k in range(WINDOW):
        inside = place + k < ends
        value = np.where(inside, padded[k:k + n], top)
        better = inside & (value <= best)
        best, where = np.where(better, value, best), np.where(better, place + k, where)
    first = np.repeat(offsets[:-1], np.diff(offsets))
    starts = (place + WINDOW <= ends) | ((place == first) & (place < ends))  # a text with fewer grams has one window
    chosen[where[starts]] = True
    return np.flatnonzero(chosen)


def _hashes(words: pa.Array) -> np.ndarray:
    from ripple.llm.common import word_hashes

    return word_hashes(words) if len(words) else np.zeros(0, dtype=np.uint64)


def _telling() -> np.ndarray:
    """Hashes of the words that no alignment may leave out."""
    numbers = [f"{v}{n:0{w}d}" for v in ("", "v") for w in (1, 2) for n in range(10**w)]
    return np.unique(_hashes(pa.array(TELLING + numbers, pa.string())))


class TemplateIndex:
    """Inverted index: gram -> (template, place), of a block of templates."""

    def __init__(self, names: list[str], texts: list[str]):
        words, offsets, _ = _plain_words(pa.array(texts, pa.string()))
        self.names = names
        hashes = _hashes(words)
        self.words = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        size = np.diff(offsets)
        self.band = np.where(size < FEW, 0, np.minimum(BAND, size // 4))  # words that a place of COVERAGE may have too many or too few
        self.width = self.band // 2
        self.telling = _telling()
        grams = _grams(hashes, offsets)
        at = np.flatnonzero(grams)  # every gram of a template, so that any fingerprint of a text can meet it
        owner = np.searchsorted(offsets, at, side="right") - 1
        order = np.argsort(grams[at], kind="stable")
        self.keys, self.owner, self.place = grams[at][order], owner[order], (at - offsets[owner])[order]
        self.short = np.unique(self.keys[size[self.owner] < GRAM + WINDOW - 1])  # a window may pass these by

    def _hits(self, grams: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(template, word at which it would begin) of each place of a template gram among the words ``at``, with the index into ``at`` in front."""
        lo, hi = np.searchsorted(self.keys, grams[at]), np.searchsorted(self.keys, grams[at], side="right")
        n = hi - lo
        which = np.repeat(np.arange(len(at)), n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which]
        return which, self.owner[entry], at[which] - self.place[entry]

    def matches(self, texts: pa.Array) -> list[tuple]:
        """(text, template, score, matched, coverage, first and last word) of the best of overlapping places."""
        words, offsets, where = _plain_words(texts)
        hashes = _hashes(words)
        grams = _grams(hashes, offsets)
        chosen = np.isin(grams, self.short) & (grams != 0) if len(self.short) else np.zeros(len(grams), bool)
        chosen[_winnowed(grams, offsets)] = True
        at = np.flatnonzero(chosen)
        which, owner, start = self._hits(grams, at)
        if not len(owner):
            return []
        # Hits of one place lie on neighbouring diagonals: one candidate for each stretch of them.
        text = np.searchsorted(offsets, at, side="right")[which] - 1
        cand = np.unique(np.stack([text, owner, start // (self.width[owner] + 1)]), axis=1)
        text, owner = cand[0], cand[1]
        start = cand[2] * (self.width[owner] + 1)
        keep = self._enough_grams(grams, offsets, text, owner, start)
        text, owner, start = text[keep], owner[keep], start[keep]
        out = []
        for t in np.unique(owner).tolist():
            mine = np.flatnonzero(owner == t)
            band, m = int(self.band[t]), len(self.words[t])
            step = max(1, CELLS // (m + 3 * band + 1))
            for a in range(0, len(mine), step):
                part = mine[a:a + step]
                score, matched, first, last = banded_alignment(self.words[t], hashes, start[part], offsets[text[part]], offsets[text[part] + 1], band,
                                                               band + int(self.width[t]), self.telling)
                share = matched / (m + last - first + 1 - matched)
                good = (matched > 0) & (share >= (COVERAGE if m >= FEW else 1))
                out += zip(text[part][good].tolist(), [t] * int(good.sum()), score[good].tolist(), matched[good].tolist(), share[good].tolist(),
                           where[first[good]].tolist(), where[last[good]].tolist())
        return best_places(out, lambda x: (self.names[x[1]] is None, self.names[x[1]] or ""))

    def _enough_grams(self, grams, offsets, text, owner, start) -> np.ndarray:
        """Which candidates share as many grams with their template as a place of COVERAGE does at least.

        A word left out or changed takes three grams away and an added one two, so 0.4 of the words less two remain.
        """
        looked = np.zeros(len(grams), bool)
        for t in np.unique(text).tolist():
            looked[offsets[t]:offsets[t + 1]] = True
        at = np.flatnonzero(looked & (grams != 0))
        which, all_owner, all_start = self._hits(grams, at)
        n = len(grams) + 4 * BAND + max(map(len, self.words)) + 1  # room between two (text, template) on one line of numbers
        group = lambda t, o: (t * len(self.words) + o) * (2 * n) + n
        line = np.sort(group(np.searchsorted(offsets, at, side="right")[which] - 1, all_owner) + all_start)
        base = group(text, owner) + start
        found = np.searchsorted(line, base + self.width[owner] + self.band[owner], side="right") - np.searchsorted(line, base - self.band[owner])
        size = np.array([len(w) for w in self.words])[owner]
        return found >= np.where(size < FEW, size - GRAM + 1, np.ceil((1 - 3 * (1 - COVERAGE)) * size - GRAM + 1 - 1e-9))


def best_places(found: list[tuple], name) -> list[tuple]:
    """Of the places (text, template, score, ..., first, last) of each text the highest scores; ties go to shorter, earlier places, then names.

    A place is left out if it shares more than 1 - COVERAGE of the shorter one's words with a better place; an alignment may end a few words inside the next license.
    """
    kept: dict = {}
    for x in sorted(set(found), key=lambda x: (-x[2], x[-1] - x[-2], x[-2], name(x))):
        places = kept.setdefault(x[0], [])
        j = bisect.bisect_left(places, x[-1] + 1, key=lambda y: y[-2])  # the first place that begins after this one ends
        while j and places[j - 1][-1] >= x[-2]:  # kept places end in the order they begin
            y = places[j - 1]
            if min(x[-1], y[-1]) - max(x[-2], y[-2]) + 1 > (1 - COVERAGE) * (min(x[-1] - x[-2], y[-1] - y[-2]) + 1):
                break
            j -= 1
        else:
            places.insert(bisect.bisect_left(places, x[-2], key=lambda y: y[-2]), x)
    return [x for t in sorted(kept) for x in kept[t]]


def banded_alignment(template: np.ndarray, words: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, under: int, over: int, telling: np.ndarray):
    """(score, matched, first, last) of the best alignment of the whole template with words low..high - 1 for each start.

    All candidates advance together, a template word at a time. Template word i may meet words start + i - under .. start + i + over. A match gains 4, a word without a partner
    on either side costs 1 (words of the text before and after the place cost nothing), and a telling word without a partner excludes
    the alignment. Ties go to shorter places, then the earlier end; without any match all are 0.
    """
    m, n, d = len(template), len(start), under + over + 1
    unit = np.int64(1 << LOW)
    spot = start[:, None] - under + np.arange(m + d - 1)
    inside = (spot >= low[:, None]) & (spot < high[:, None])
    own = np.where(inside, words[np.clip(spot, 0, len(words) - 1)], np.uint64(0))
    skipped = np.cumsum(np.where(np.isin(own, telling) & inside, NEVER, 1), axis=1) * unit
    price = np.where(np.isin(template, telling), NEVER, 1).astype(np.int64)
    before = (np.cumsum(price) - price) * unit  # leaving out all template words so far
    after = (price.sum() - np.cumsum(price)) * unit
    none = np.int64(-(1 << 61))
    # A state is its score in the upper bits and its first word in the lower ones, so that the larger state is the better one.
    state, best, last = np.full((n, d + 1), none), np.full(n, none), np.zeros(n, dtype=np.int64)
    rows, places = np.arange(n), np.arange(d)
    for i in range(m):
        here = slice(i, i + d)
        match = np.where((own[:, here] == template[i]) & inside[:, here], np.maximum(state[:, :d], places + i - before[i]) + 4 * unit, none)
        end = match.argmax(axis=1)
        value = match[rows, end] - after[i]
        better = value > best
        best, last = np.where(better, value, best), np.where(better, end + i, last)
        state[:, :d] = np.maximum(match, np.maximum(state[:, 1:] - price[i] * unit, none))
        state[:, :d] = np.maximum(np.maximum.accumulate(state[:, :d] + skipped[:, here], axis=1) - skipped[:, here], none)
    first, score = best & (unit - 1), best >> LOW
    matched = (score + m + last - first + 1) // 6
    found = score > 0
    zero = np.zeros(n, dtype=np.int64)
    shift = start - under
    return tuple(np.where(found, x, zero) for x in (score, matched, first + shift, last + shift))


def _blocks(rows):
    """Cut the templates into blocks of at most BLOCK and about BLOCK_CHARS characters."""
    block, size = [], 0
    for r in rows:
        if block and (len(block) == BLOCK or size + len(r.text) > BLOCK_CHARS):
            yield block
            block, size = [], 0
        block.append(r)
        size += len(r.text)
    if block:
        yield block


def license_matches(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each place of a document that is a template (columns ``template, text``) with few changes.

    ``key, template, matched, coverage, first_word, last_word, first_char, last_char``: words are numbered from 0 as
    white-space-separated words, characters are those of the text, the last one exclusive. Punctuation, case and comment signs do
    not count. ``coverage`` is matched words by those of the template and those added within the place; at least COVERAGE is reported, 1
    for templates of fewer than FEW words. Words that tell licenses apart (TELLING, small numbers) may be neither missing nor added. Of places that overlap
    by more than 1 - COVERAGE of the shorter one the best is reported: four points a matched word less one a word without a partner, then shorter, earlier, smaller name.

    The templates, a stated set, are indexed in blocks of BLOCK templates or BLOCK_CHARS characters and sent to the tasks; each document is
    scanned whole, where it lies, and only places cross a shuffle, where there are several blocks. Places with five equal words in a row are found, and all of templates of
    three or four words; templates of one or two words are not looked for.

    Null and empty texts and templates match nothing; rows that repeat a key or have none are scanned each by itself; repeated
    templates count once. Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["template", "matched", "coverage", "first_word", "last_word", "first_char", "last_char"]
    shape = f"{key} {kind}, template string, matched long, coverage double, first_word long, last_word long, first_char long, last_char long"
    rows = templates.where("text is not null").select("template", "text").distinct().orderBy("template", "text").toLocalIterator()
    indices = [docs.sparkSession.sparkContext.broadcast(TemplateIndex([r.template for r in b], [r.text for r in b])) for b in _blocks(rows)]
    if not indices:
        return docs.sparkSession.createDataFrame([], shape)
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    if len(indices) > 1:
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "scanned")  # numbers must not change between the passes
    else:
        rows = rows.withColumn("_row", F.lit(0).cast("long"))

    def scan(shared):
        def run(batches):
            index = shared.value
            for batch in batches:
                for part in slices(batch, "_text", PIECE):
                    found = index.matches(part.column("_text"))
                    if not found:
                        continue
                    out, now, spans = [], -1, []
                    for text, t, score, matched, share, first, last in found:
                        if text != now:
                            now, spans = text, [m.span() for m in re.finditer(WORD, part.column("_text")[text].as_py())]
                        out.append((text, score, index.names[t], matched, share, first, last, spans[first][0], spans[last][1]))
                    at, *columns = zip(*out)
                    own = [part.column(c).take(pa.array(at)) for c in ("_row", "_key")]
                    yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns)], ["_row", key, "_score", *names])
        return rows.mapInArrow(run, f"_row long, {key} {kind}, _score long, " + shape.split(", ", 1)[1])

    if len(indices) == 1:
        return scan(indices[0]).drop("_row", "_score")
    places = cut(functools.reduce(DataFrame.unionByName, map(scan, indices)), "places")

    def best(frame):
        records = frame[["_row", "template", "_score", "first_word", "last_word"]].itertuples(index=True)
        kept = best_places([(r[1], r[2], r[3], r[0], r[4], r[5]) for r in records], lambda x: (x[1] is None, x[1] or ""))
        return frame.loc[[x[3] for x in kept], [key, *names]]

    return places.groupBy("_row").applyInPandas(best, shape)


def known_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template string, text string")


def op2_license_scan(spark, sf_dir):
    return license_matches(table(spark, sf_dir, "documents"), known_templates(spark))
