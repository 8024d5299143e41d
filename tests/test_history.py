import random
import time

from helpers import rowset

from ripple.operators import history

LINKS = "repo_id string, sha string, parent_sha string"
PAIRS = "repo_id string, base_sha string, head_sha string"


def ask(spark, links, pairs):
    got = history.is_ancestor(spark.createDataFrame(links, LINKS), spark.createDataFrame(pairs, PAIRS)).collect()
    return {(r.repo_id, r.base_sha, r.head_sha): r.is_ancestor for r in got}


def reach(links, head):
    seen, todo = {head}, [head]
    while todo:
        x = todo.pop()
        for a, b in links:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_small_histories(spark):
    links = [("r", "d", "c"), ("r", "c", "b"), ("r", "b", "a"), ("r", "d", "x"), ("q", "b", "a"), ("r", "d", "c"), ("r", None, "a"), ("r", "a", None), (None, "a", "b")]
    pairs = {("r", "a", "d"): True, ("r", "x", "c"): False, ("r", "x", "d"): True, ("r", "d", "a"): False, ("r", "b", "b"): True, ("q", "c", "d"): False,
             ("r", "new", "new"): True, ("r", "new", "d"): False, ("r", "a", "new"): False, ("r", None, "d"): False, (None, "b", "a"): False}
    assert ask(spark, links, [*pairs, ("r", "a", "d")]) == pairs
    assert ask(spark, [], [("r", "a", "b"), ("r", "a", "a")]) == {("r", "a", "b"): False, ("r", "a", "a"): True}
    assert ask(spark, links, []) == {}


def test_rings_are_walked(spark):
    """No real history has a ring; its members still reach each other and what hangs from them."""
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("c", "y"), ("z", "z"), ("y2", "y")]
    nodes = sorted({n for e in links for n in e})
    want = {("r", b, h): b in reach(links, h) for h in nodes for b in nodes}
    assert ask(spark, [("r", *e) for e in links], list(want)) == want


def test_merges_against_a_plain_walk(spark):
    r = random.Random(5)
    links, pairs, want = [], [], {}
    for repo in ("one", "two", "three"):
        own = []
        for i in range(1, 160):  # branches, merges, octopus merges and second roots
            near = range(max(0, i - r.choice([2, 8, 60])), i)
            own += [(f"{i:03d}", f"{p:03d}") for p in r.sample(near, min(len(near), r.choice([0, 1, 1, 1, 2, 2, 3])))]
        links += [(repo, *e) for e in own]
        for h in r.sample(range(160), 40):
            seen = reach(own, f"{h:03d}")
            want |= {(repo, f"{b:03d}", f"{h:03d}"): f"{b:03d}" in seen for b in range(0, 160, 3)}
    assert ask(spark, links, list(want)) == want


def test_labels_are_chains(spark):
    r = random.Random(6)
    links = sorted({("g", f"{i:03d}", f"{max(0, i - r.choice([1, 1, 1, 2, 9])):03d}") for i in range(1, 200) for _ in (0, 1)})
    rows = history.chain_labels(spark.createDataFrame(links, "gv string, from_node string, to_node string")).collect()
    at = {(x.chain, x.position): x.node for x in rows}
    assert len(at) == len(rows) == 200
    for (chain, p), node in at.items():
        assert node == chain if p == 0 else ("g", node, at[chain, p - 1]) in links


def test_long_line_in_few_rounds(spark, monkeypatch):
    """A line of 10,000 commits with a branch every 50: rounds grow with its logarithm."""
    n, steps = 10_000, []
    rows = spark.range(1, n).selectExpr("'r' repo_id", "cast(id as string) sha", "cast(id - 1 as string) parent_sha")
    side = spark.range(0, n, 50).selectExpr("'r' repo_id", "'s' || id sha", "cast(id as string) parent_sha")
    merge = spark.range(0, n - 20, 100).selectExpr("'r' repo_id", "cast(id + 20 as string) sha", "'s' || id parent_sha")
    pairs = spark.createDataFrame([("r", "0", "9999"), ("r", "9999", "0"), ("r", "s100", "9000"), ("r", "s150", "9000"), ("r", "s8000", "8019"), ("r", "s8000", "8020"), ("r", "17", "s9950")], PAIRS)
    real = history.cut
    monkeypatch.setattr(history, "cut", lambda df, name: (steps.append(name), real(df, name))[1])
    start = time.time()
    got = history.is_ancestor(rows.unionByName(side).unionByName(merge), pairs)
    assert rowset(got, "base_sha", "head_sha", "is_ancestor") == sorted([
        ("0", "9999", True), ("9999", "0", False), ("s100", "9000", True), ("s150", "9000", False), ("s8000", "8019", False), ("s8000", "8020", True), ("17", "s9950", True)], key=str)
    assert steps.count("sizes") <= 16 and steps.count("chains") <= 16
    assert time.time() - start < 60


def test_pairs_do_not_visit_what_cannot_reach_their_base(spark, monkeypatch):
    """Commit k has the parents k div 2 and k div 3; most bases are no ancestors, and a whole closure holds dozens of commits."""
    n, kept = 3000, {}
    links = [("r", str(k), str(p)) for k in range(1, n) for p in {k // 2, k // 3}]
    heads = range(1, n, 7)
    reached = {}
    for k in range(n):
        reached[k] = {k}.union(*(reached[p] for p in ({k // 2, k // 3} if k else ())))
    want = {("r", str(b), str(k)): b in reached[k] for k in heads for b in {k // 5, k // 4}}
    real = history.Levels

    def levels(spark, name, number):
        kept[name] = real(spark, name, number)
        return kept[name]

    monkeypatch.setattr(history, "Levels", levels)
    assert ask(spark, links, list(want)) == want
    assert kept["ancestors"].all().count() < 5 * len(want)
