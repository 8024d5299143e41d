import random

import pytest
from helpers import edge, edges, fn, roots, rowset, surfaces

from ripple.operators import skew, walk

CHANGED, IMPL_A, IMPL_B, CALL1, CALL2 = (fn("changed"), fn("a", "ImplA"), fn("b", "ImplB"), fn("c1", "Caller1"), fn("c2", "Caller2"))
CHAIN = [fn(f"f{i}", "F") for i in range(7)]
CTRL, SVC, REPO_SAVE, REPO_FIND = fn("c", "Ctrl"), fn("s", "Svc"), fn("save", "Repo"), fn("findById", "Repo")


def ranking(gv="rank"):
    return [edge(IMPL_A, CHANGED, "implements", gv=gv), edge(IMPL_B, CHANGED, "implements", True, "ambiguous", gv=gv),
            edge(CALL1, IMPL_A, gv=gv), edge(CALL2, IMPL_B, gv=gv), edge(CHANGED, CHANGED, gv=gv)]


@pytest.fixture(scope="module")
def graph(spark):
    rows = ranking() + [edge(CHAIN[i + 1], CHAIN[i], gv="chain") for i in range(6)] + [edge("route:GET /util", CHAIN[6], "handles", True, gv="chain")]
    rows += [edge(CHAIN[i + 1], CHAIN[i], gv="within") for i in range(3)] + [edge("route:GET /x", CHAIN[3], "handles", gv="within"), edge("route:GET /ghost", CHAIN[1], "handles", gv="within")]
    rows += [edge(CTRL, SVC, gv="data"), edge(SVC, REPO_SAVE, gv="data"), edge(REPO_SAVE, "entity:E", "queries", True, "single_impl", gv="data"),
             edge("entity:E", "table:b", "maps_to", gv="data"), edge("entity:E", "table:e", "maps_to", gv="data"), edge(CTRL, "fn:x.Y#implOnly()", "implements", gv="data")]
    rows += [edge(REPO_SAVE, "entity:E", "queries", gv="plain")]
    rows += [edge(SVC, REPO_SAVE, gv="mixed"), edge(SVC, REPO_FIND, gv="mixed"), edge(REPO_SAVE, "entity:E", "queries", gv="mixed"),
             edge(REPO_FIND, "entity:E", "queries", True, "regex", gv="mixed")]
    return edges(spark, rows).persist()


@pytest.fixture(scope="module")
def starts(spark):
    return roots(spark, [("rank", "rank", CHANGED, False), ("chain", "chain", CHAIN[0], True), ("within", "within", CHAIN[0], True), ("data", "data", CTRL, True),
                         ("plain", "plain", REPO_SAVE, True), ("mixed", "mixed", SVC, True), ("lost", "rank", fn("added"), True)])


def test_callers(spark, graph, starts):
    callers = walk.all_callers(starts, graph).persist()
    ranked = walk.rank_callers(callers, starts, 15).filter("root_id = 'rank'").orderBy("position").collect()
    assert [r.key for r in ranked] == [IMPL_A, IMPL_B, CALL1, CALL2]
    last = ranked[3]
    assert (last.hops, last.confidence, last.inferred, last.usage, last.signature_compatible) == (2, "ambiguous", True, "calls this method", False)
    assert [r.key for r in walk.rank_callers(callers, starts, 2).filter("root_id = 'rank'").orderBy("position").collect()] == [IMPL_A, IMPL_B]
    totals = {r.root_id: r for r in walk.caller_totals(callers, 2).collect()}
    assert (totals["rank"].caller_total, totals["rank"].truncated, totals["rank"].ambiguous_callers) == (4, True, 2)
    assert totals["chain"].caller_total == 2 and not totals["chain"].truncated


def test_reverse_walk_and_entrypoints(spark, graph, starts):
    hops = walk.prepare_hops(graph, "reverse")
    visited = walk.level_walk(starts, hops).persist()
    assert visited.groupBy("root_id", "node").count().filter("count > 1").isEmpty()
    meta = {r.root_id: r for r in walk.walk_meta(visited, hops).collect()}
    assert (meta["chain"].nodes_visited, meta["chain"].depth_cap_hit) == (6, True)
    assert (meta["within"].nodes_visited, meta["within"].depth_cap_hit) == (4, False)
    assert (meta["lost"].nodes_visited, meta["lost"].max_depth) == (1, 5)
    known = surfaces(spark, [("chain", "route:GET /util", "http_route"), ("within", "route:GET /x", "http_route")])
    assert rowset(walk.entrypoints(visited, graph, known), "root_id", "key", "min_hops", "via_inferred_edge") == [("within", "route:GET /x", 4, False)]


def test_forward_walk_and_data(spark, graph, starts):
    visited = walk.level_walk(starts, graph, "forward").persist()
    assert visited.filter("node LIKE '%implOnly%'").isEmpty()
    got = rowset(walk.data_surfaces(visited, graph), "root_id", "key", "kind", "access", "via_inferred_edge", "confidence")
    assert got == [("data", "table:b", "table", "write", True, "single_impl"), ("mixed", "entity:E", "entity", "read_write", True, "regex"),
                   ("plain", "entity:E", "entity", "write", False, "exact")]


def test_now_depends_on(spark):
    base = edges(spark, [edge(SVC, REPO_FIND, gv="b")])
    head = edges(spark, [edge(SVC, REPO_FIND, gv="b:head"), edge(SVC, "unresolved:x#y", "unresolved", confidence="ambiguous", gv="b:head"), edge(CTRL, SVC, gv="b:head")])
    got = rowset(walk.now_depends_on(roots(spark, [("r", "b", SVC, True)]), head, base), "key", "is_new")
    assert got == [(REPO_FIND, False), ("unresolved:x#y", True)]


RANKS = ["exact", "single_impl", "regex", "ambiguous"]


def plain_walk(rows, start, types, cap=5):
    """Brute-force level walk; the path of a node is the best of its level."""
    seen, frontier = {start: (0, 0, False)}, [start]
    for depth in range(1, cap + 1):
        best = {}
        for node in frontier:
            for r in rows:
                if r[3] == node and r[2] not in seen and r[4] in types and r[2] != node:
                    cand = (max(seen[node][1], RANKS.index(r[6])), seen[node][2] or r[5])
                    best[r[2]] = min(best.get(r[2], (9, True)), cand)
        for n, (rank, inf) in best.items():
            seen[n] = (depth, rank, inf)
        frontier = list(best)
    return seen


@pytest.mark.parametrize("hub_degree", [2, 10 ** 6])
def test_random_graphs_match_brute_force(spark, hub_degree):
    rng = random.Random(7)
    rows = []
    for gv in ("g1", "g2"):
        nodes = [fn(f"n{i}") for i in range(30)]
        pairs = {(rng.choice(nodes), nodes[0] if rng.random() < 0.4 else rng.choice(nodes), rng.choice(["calls", "implements", "overrides", "queries"])) for _ in range(80)}
        rows += [edge(a, b, t, rng.random() < 0.3, rng.choice(RANKS), gv=gv) for a, b, t in sorted(pairs)]
    starts = [(f"{gv}|{n}", gv, n, True) for gv in ("g1", "g2") for n in (fn("n0"), fn("n5"), fn("n9"))]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    hops = walk.prepare_hops(edges(spark, shuffled).repartition(7), "reverse", hub_degree=hub_degree, bucketed=hub_degree == 2)
    assert (hops.hubs is not None) == (hub_degree == 2)
    got = {(r.root_id, r.node): (r.depth, r.rank, r.inferred) for r in walk.level_walk(roots(spark, starts), hops).collect()}
    want = {}
    for root, gv, node, _ in starts:
        mine = [r for r in rows if r[1] == gv]
        want.update({(root, n): v for n, v in plain_walk(mine, node, ["calls", "implements", "overrides"]).items()})
    assert got == want


def test_ancestor_closure_and_cycles(spark):
    up = spark.createDataFrame([("g", "A", "B"), ("g", "B", "C"), ("g", "A", "C"), ("g", "C", "A"), ("h", "A", "Z")], "gv string, fqcn string, supertype_fqcn string")
    assert rowset(walk.ancestor_closure(up), "gv", "fqcn", "ancestor_fqcn", "distance") == [
        ("g", "A", "B", 1), ("g", "A", "C", 1), ("g", "B", "A", 2), ("g", "B", "C", 1), ("g", "C", "A", 1), ("g", "C", "B", 2), ("h", "A", "Z", 1)]


def test_callers_of_a_hub_are_numbered_in_pieces(spark, monkeypatch):
    stored, cut = [], skew.cut
    monkeypatch.setattr(skew, "cut", lambda df, *a: stored.append(cut(df, *a)) or stored[-1])
    rows = [edge(fn(f"u{i:04}", "User"), CHANGED, gv="hub") for i in range(2000)]
    ranked, _ = walk.direct_callers(roots(spark, [("hub", "hub", CHANGED, True)]), edges(spark, rows))
    got = ranked.orderBy("position").collect()
    assert [(r.position, r.key) for r in got] == [(i + 1, fn(f"u{i:04}", "User")) for i in range(2000)]
    assert stored[0].select("_piece").distinct().count() > 1


def test_counts_of_callers_without_their_paths(spark):
    r = random.Random(11)
    names = [fn(f"n{i}") for i in range(30)]
    trust, kinds = ["exact", "single_impl", "regex", "ambiguous", "ambiguous", "odd", None], ["calls", "implements", "overrides", "queries"]
    graph = edges(spark, [edge(r.choice(names), r.choice(names), r.choice(kinds), r.random() < 0.5, r.choice(trust)) for _ in range(150)]).persist()
    # a root with several start nodes, one that nobody calls, and one of another version
    starts = roots(spark, [(f"r{i % 7}", "g", n, True) for i, n in enumerate(names[:12])] + [("none", "g", fn("alone"), True), ("other", "h", names[0], True)])
    want = walk.caller_totals(walk.all_callers(starts, graph))
    got = walk.count_callers(starts, graph)
    assert got.columns == want.columns and rowset(got, *got.columns) == rowset(want, *want.columns) and got.count() == 7
