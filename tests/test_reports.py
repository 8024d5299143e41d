import random

from helpers import rowset

from ripple.operators import reports, skew
from ripple.plans import registry

D = "/root/testdata/sf0.001"


def test_positions_and_totals(spark):
    """One group holds most rows and spans all pieces; ties are broken by the columns given."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.9 else f"k{rng.randrange(5)}", rng.randrange(300), i, rng.randrange(50)) for i in range(4000)]
    df = spark.createDataFrame(rows, "k string, a int, i int, n long").repartition(6)
    want, want_sum = {}, {}
    for key in {r[0] for r in rows}:
        total = 0
        for pos, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])), 1):
            want[r[2]], want_sum[r[2]] = pos, total
            total += r[3]
    ranked = skew.rank_within(df, ["k"], ["a", "i"])
    assert ranked.columns == ["k", "a", "i", "n", "position"]
    assert {r.i: r.position for r in ranked.collect()} == want
    assert {r.i: r.before for r in skew.running_total(df, ["k"], ["a", "i"], "n", "before").collect()} == want_sum
    assert skew.rank_within(df.limit(0), ["k"], ["a", "i"]).count() == 0


def test_chunks_of_a_huge_report(spark):
    """A hub's report is spread over many bounded chunks that give it back in order; a part longer than a chunk stays whole."""
    parts = spark.range(20000).selectExpr("'hub' AS root_id", "1 AS part", "id AS pos", "'' AS k1", "'' AS k2", "concat('<', id, 'é>') AS text")
    one = spark.createDataFrame([("hub", 0, 0, "", "", "x" * 5000), ("small", 0, 0, "", "", "y"), ("none", 0, 0, "", "", "")],
                                "root_id string, part int, pos long, k1 string, k2 string, text string")
    got = reports.chunks(parts.unionByName(one).repartition(5), 1000).collect()
    hub = sorted((r.chunk, r.text) for r in got if r.root_id == "hub")
    assert "".join(t for _, t in hub) == "x" * 5000 + "".join(f"<{i}é>" for i in range(20000))
    assert len(hub) > 150 and max(len(t.encode()) for c, t in hub if c) <= 1000 + len("<19999é>".encode())
    assert rowset(spark.createDataFrame([r for r in got if r.root_id != "hub"]), "root_id", "chunk", "text") == [("none", 0, ""), ("small", 0, "y")]


def test_chunks_are_the_prompt(spark):
    whole = {r.root_id: r.prompt for r in registry.QUERIES["prompt_rows"](spark, D).collect()}
    split = {}
    for r in sorted(registry.QUERIES["prompt_chunks"](spark, D).collect(), key=lambda r: (r.root_id, r.chunk)):
        split[r.root_id] = split.get(r.root_id, "") + r.text
    assert split == whole and any("must not appear again" in t for t in whole.values())
