from collections import Counter, defaultdict
from fractions import Fraction

from pyspark.sql import functions as F

from ripple.llm import mixing


def fill(budget, siblings):
    """Exact water-filling: siblings are {name: (weight, cap)}."""
    out, left, live = {}, Fraction(budget), dict(siblings)
    while live:
        weights = sum(w for w, _ in live.values())
        full = [n for n, (w, c) in live.items() if weights and c <= left * w / weights]
        if not full:
            return out | {n: left * w / weights if weights else Fraction(0) for n, (w, _) in live.items()}
        taken = 0
        for n in full:
            out[n] = Fraction(live[n][1])
            taken += live.pop(n)[1]
        left -= taken
    return out


def rows():
    out = []
    for i in range(4000):
        source = f"src{0 if i % 3 == 0 else i % 17}"
        out.append((i, [None, "en", "de", "fr", "es"][(i // 7) % 5], None if i % 50 == 0 else source, (i * 37) % 101, "clash"))
    return out + [(None, "en", "src1", 5, "c"), (3, "en", "src1", 5, "c"), (3, "en", "src1", 5, "c"), (4, "xx", "rare", 3, "c"), (5, "xx", "none", 0, "c"), (6, "xx", "null", None, "c")]


def test_budgets_and_prefixes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 16)
    docs = spark.createDataFrame(rows(), "doc_id long, lang string, source string, words int, epoch string")
    plan = mixing.PLAN
    got = mixing.mixture(docs, F.col("words"), plan).collect()
    supply = Counter()
    for _, lang, source, n, _ in rows():
        supply[plan.domains.get(source, "other"), lang or "", source or ""] += n or 0
    total = sum(supply.values()) * plan.share[0] // plan.share[1]
    caps = lambda depth: {k: sum(v for x, v in supply.items() if x[:depth] == k) * plan.epochs for k in {x[:depth] for x in supply}}
    tables = (plan.domain_weights, plan.lang_weights, plan.source_weights)
    budgets = {(): Fraction(total)}
    for depth in (1, 2, 3):
        below = {}
        for parent, b in budgets.items():
            own = {k: (tables[depth - 1].get(k[-1], 1), c) for k, c in caps(depth).items() if k[:-1] == parent}
            below |= fill(b, own)
        budgets = below
    used, times = Counter(), defaultdict(list)
    for r in got:
        leaf = (r._domain, r._lang, r._source)
        used[leaf] += r["take"]
        times[leaf].append((r.epoch, r["take"], r._tokens, r._row.doc_id))
    assert sum(used.values()) == total
    for leaf, b in budgets.items():
        assert abs(used[leaf] - b) <= 3, leaf
        t = times[leaf]
        if t:
            assert sum(x[1] < x[2] for x in t) <= 1
            assert Counter(x[0] for x in t)[1] >= max(Counter(x[0] for x in t).values()) or max(x[0] for x in t) == 1
    again = mixing.mixture(docs.repartition(7), F.col("words"), plan).collect()
    assert Counter(map(str, got)) == Counter(map(str, again))


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a  b\nc d e f", "en", "src1", 11), (2, None, None, None, 0), (3, "", "en", "src1", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mixed_documents(docs, mixing.Plan({}, {}, {}, {}, share=(1, 2), epochs=1)).collect()
    assert [r.text for r in got if r.doc_id == 1] == ["a b c"] and [r.n_chars for r in got if r.doc_id == 1] == [5]
    assert mixing.mixed_documents(docs.limit(0), mixing.PLAN).collect() == []
    assert mixing.mixed_documents(docs, mixing.PLAN).columns == docs.columns
