import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa

from ripple.llm import licenses


def test_given_documents(spark):
    """Every exact license line of the documents is found at its place, and nothing else is."""
    got = licenses.op2_license_scan(spark, "/root/testdata/sf0.1").collect()
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.1/documents.parquet'").fetchall()
    want = set()
    for i, t in rows:
        for name, line in licenses.TEMPLATES.items():
            want |= {(i, name, m.start(), m.end()) for m in re.finditer(re.escape(line), t or "")}
    exact = {(r.doc_id, r.template, r.first_char, r.last_char) for r in got if r.coverage == 1}
    assert want and want <= exact
    assert {x[0] for x in exact} == {x[0] for x in want}


def test_altered_copies_and_spans(spark):
    r = random.Random(2)
    long = licenses.TEMPLATES["apache-2.0-notice"]
    words = long.split()
    noise = lambda n: " ".join(f"q{r.randint(0, 999)}" for _ in range(n))
    changed = list(words)
    for k in (9, 30, 31, 60):
        changed[k] = "changed"
    inserted = words[:40] + ["really", "new", "words"] + words[40:]
    commented = "\n".join(" * " + " ".join(words[a:a + 7]) for a in range(0, len(words), 7))
    rows = [(1, noise(50) + " " + long + " " + noise(20)), (2, " ".join(changed)), (3, noise(3) + "\n" + " ".join(inserted)), (4, commented.upper()),
            (5, " ".join(words[:40])), (6, None), (7, ""), (8, noise(20000) + " " + long + " " + noise(9000) + " " + long), (9, "Licensed under CC"), (None, long), (9, long), (9, long)]
    docs = spark.createDataFrame([(*x, "clash") for x in rows], "doc_id long, text string, template string")
    got = licenses.license_matches(docs, spark.createDataFrame([("a", long), ("a", long), ("n", None), ("e", " ")], "template string, text string")).collect()
    by = {}
    for x in got:
        by.setdefault(x.doc_id, []).append(x)
    text = dict(rows)
    m = len([w for w in words if licenses._plain(w)])
    assert [len(by.get(k, [])) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9, None)] == [1, 1, 1, 1, 0, 0, 0, 2, 2, 1]
    assert text[1][by[1][0].first_char:by[1][0].last_char] == long and by[1][0].coverage == 1
    assert by[2][0].matched == m - 4 and by[3][0].matched == m and by[4][0].matched == m
    assert {text[8][x.first_char:x.last_char] for x in by[8]} == {long}
    assert licenses.license_matches(docs.limit(0), licenses.known_templates(spark)).collect() == []
    assert licenses.license_matches(docs, licenses.known_templates(spark).limit(0)).collect() == []


def full_alignment(a, b):
    """(score, length of the place) by the whole table: 4 a match, -1 a word without a partner, words of b around the place are free."""
    best, row = (0, 0), [None] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [None] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            options = [(row[j][0] - 1, row[j][1])] if row[j] else []
            if new[j - 1]:
                options.append((new[j - 1][0] - 1, new[j - 1][1]))
            if x == y:
                options.append(max([(-i + 4, j)] + ([(row[j - 1][0] + 4, row[j - 1][1])] if row[j - 1] else [])))
                best = max(best, (options[-1][0] - (len(a) - 1 - i), -(j - options[-1][1] + 1)))
            new[j] = max(options, default=None)
        row = new
    return best[0], -best[1]


def test_alignment_against_the_full_table():
    r = random.Random(3)
    code = lambda ws: licenses._hashes(pa.array(ws, pa.string()))
    for _ in range(200):
        a = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(r.randint(3, 40))]
        b = [w for w in a if r.random() > 0.1]
        for _ in range(r.randint(0, 2)):
            b.insert(r.randint(0, len(b)), r.choice(["x", *a]))
        pre = r.randint(0, 4)
        text = ["p"] * pre + b + ["q"] * 5
        score, matched, first, last = (x[0] for x in licenses.banded_alignment(code(a), code(text), np.array([pre]), np.array([0]), np.array([len(text)]), 45, 45, licenses._telling()))
        assert (score, last - first + 1) == full_alignment(a, text)
        assert 6 * matched == score + len(a) + last - first + 1


def test_scan_against_the_full_table(spark):
    """Places below full coverage: the scan reports the template and score of the whole table, and nothing below COVERAGE."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(60)]
    templates = {"one": base, "two": base[:30] + [word() for _ in range(30)], "three": [word() for _ in range(25)], "four": base[:45], "five": [word() for _ in range(12)]}
    rows, want = [], {}
    for i in range(120):
        own = list(r.choice(list(templates.values())))
        for _ in range(r.randint(0, len(own) // 4)):
            k = r.randrange(len(own))
            own[k:k + 1] = r.choice([[word()], [], [own[k], word()]])
        rows.append((i, " ".join([word() for _ in range(r.randint(0, 30))] + own + [word() for _ in range(r.randint(0, 30))])))
        found = []
        for name, t in templates.items():
            score, span = full_alignment(t, rows[-1][1].split())
            matched = (score + len(t) + span) / 6
            if score > 0 and matched >= licenses.COVERAGE * (len(t) + span - matched):
                found.append((score, -span, name))
        if found:
            want[i] = max(found)
    got = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(t)) for n, t in templates.items()], "template string, text string")).collect()
    have = {x.doc_id: (6 * x.matched - len(templates[x.template]) - (x.last_word - x.first_word + 1), -(x.last_word - x.first_word + 1), x.template) for x in got}
    assert len(have) == len(got) and set(have) <= set(want) and all(have[k] == want[k] for k in have)
    runs = lambda k: max(len(m) for m in re.findall("1+", "".join("1" if " ".join(templates[want[k][2]][j:j + 5]) in rows[k][1] else "0" for j in range(len(templates[want[k][2]]) - 4)) + "1"))
    assert len(want) > 60 and len(want) < 120
    assert all(k in have for k in want if runs(k) > 1 or want[k][0] == 4 * len(templates[want[k][2]]))


SIBLINGS = {
    "gpl-3.0-notice": ["gpl-2.0-notice", "lgpl-3.0-notice", "agpl-3.0-notice", "lgpl-2.1-notice", "lgpl-2.0-notice"],
    "apache-2.0-line": [], "cc-by-4.0-line": ["cc-by-nc-4.0-line", "cc-by-sa-4.0-line", "cc-by-nd-4.0-line", "cc-by-nc-sa-4.0-line", "cc-by-nc-nd-4.0-line"],
    "gpl-3.0-line": ["gpl-2.0-line", "lgpl-3.0-line", "lgpl-2.1-line", "agpl-3.0-line"], "mit": ["mit-grant"], "isc": ["isc-grant"],
    "bsd-2-clause": ["bsd-3-clause", "bsd-grant"], "epl-2.0-notice": ["epl-1.0-notice"],
}


def test_siblings_are_told_apart(spark):
    """Each license is named rightly, whole and with a word changed; one without a template of its own is not named as its neighbour."""
    names = sorted({*SIBLINGS, *(x for xs in SIBLINGS.values() for x in xs), "zlib", "unlicense", "cc0-1.0-notice", "mpl-2.0-notice"})
    rows = [(n, "Some words before. " + licenses.TEMPLATES[n] + " And some after.") for n in names]
    rows += [(n, licenses.TEMPLATES[n].replace("useful", "helpful").replace("IS\"", "WAS\"")) for n in names if n.endswith("notice")]
    none = ["Licensed under the Apache License, Version 1.1.", "Licensed under CC BY-NC 3.0.", "Licensed under CC BY 3.0.", "This work is licensed under the GNU General Public License, version 1.",
            licenses.TEMPLATES["gpl-3.0-notice"].replace("version 3", "version 4"), licenses.TEMPLATES["agpl-3.0-notice"].replace("version 3", "version 1"),
            licenses.TEMPLATES["apache-2.0-notice"].replace("Version 2.0", "Version 1.1"), "Licensed under the Affero License, Version 2.0."]
    docs = spark.createDataFrame([(f"{i} {n}", t) for i, (n, t) in enumerate(rows)] + [(f"- {i}", t) for i, t in enumerate(none)], "doc_id string, text string")
    got = {}
    for x in licenses.license_matches(docs, licenses.known_templates(spark)).collect():
        got.setdefault(x.doc_id, []).append(x.template)
    assert got == {f"{i} {n}": [n] for i, (n, _) in enumerate(rows)}


def test_blocks_give_the_same(spark, monkeypatch):
    t = licenses.TEMPLATES
    rows = [(1, t["mit"] + " x " + t["bsd-3-clause"]), (1, t["mit"] + " x " + t["bsd-3-clause"]), (None, t["agpl-3.0-notice"]), (2, None), (3, t["isc"] + t["lgpl-2.1-notice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one = sorted(map(str, licenses.license_matches(docs, licenses.known_templates(spark)).collect()))
    monkeypatch.setattr(licenses, "BLOCK", 4)
    assert sorted(map(str, licenses.license_matches(docs, licenses.known_templates(spark)).collect())) == one
    assert len(one) == 7


def test_a_gram_repeated_thousands_of_times():
    """Candidates are refused by their grams or aligned together; time does not grow by an alignment in Python for each."""
    index = licenses.TemplateIndex(list(licenses.TEMPLATES), list(licenses.TEMPLATES.values()))
    text = pa.array(["the GNU General Public License word " * 8000, "free software you can " * 8000, "subject to the following " * 8000])
    index.matches(text.slice(0, 1))
    start = time.time()
    assert index.matches(text) == []
    assert time.time() - start < 3


def test_copies_that_follow_each_other(spark):
    line = licenses.TEMPLATES["mit-line"]
    rows = [(1, " ".join([line] * 2)), (2, " ".join([line] * 5)), (3, line + " and " + line)]
    got = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_templates(spark).where("template = 'mit-line'")).collect()
    places = {k: sorted((x.first_word, x.last_word) for x in got if x.doc_id == k) for k, _ in rows}
    assert places == {1: [(0, 4), (5, 9)], 2: [(5 * k, 5 * k + 4) for k in range(5)], 3: [(0, 4), (6, 10)]}
