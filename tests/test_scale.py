"""What grows with the tables is not shuffled or sorted more often than needed, and the results stay the same."""

from helpers import edge, edges, fn

from pyspark.sql import functions as F

from ripple.operators import collapse, skew, walk
from ripple.plans import index, registry
from ripple.session import cut
from ripple.sources import code_facts as cf, warehouse as wh, wire

SMALL = "/root/testdata/sf0.001"


def unordered(df):
    return sorted(map(str, df.collect()))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def emissions(spark, n=60):
    rows = spark.range(n).select(
        F.lit("r").alias("repo_id"), F.lit("g").alias("graph_version_id"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("src"),
        F.lit("d").alias("dst"), F.lit("calls").alias("type"), (F.col("id") % 2 == 0).alias("inferred"), F.lit("exact").alias("confidence"),
        F.col("id").cast("string").alias("reason"), F.when(F.col("id") % 5 > 0, F.struct(F.lit("f").alias("file_path"), F.col("id").cast("int").alias("line"))).alias("call_site"),
        F.struct(F.col("id").alias("o")).alias("ordinal"))
    again = rows.filter("ordinal.o % 3 = 0").withColumn("reason", F.lit("later")).withColumn("ordinal", F.struct((F.col("ordinal.o") + 1000).alias("o")))
    return cut(rows.unionByName(again), "emissions")


def test_edges_emitted_once_are_not_sorted(spark):
    raw = emissions(spark)
    assert unordered(collapse.collapse_edges(raw, few_repeats=True)) == unordered(collapse.collapse_edges(raw))
    once, others = collapse._apart(raw, collapse.EDGE)
    assert others.count() == 9 + 3 + 2 * 17  # null sources (with their copies) are one edge, 17 others come twice
    assert "Exchange hashpartitioning" not in plan_of(once) and "Sort " not in plan_of(once)


def test_surfaces_emitted_once(spark):
    raw = emissions(spark).select("repo_id", "graph_version_id", F.col("src").alias("key"), F.col("reason").alias("kind"),
                                  F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.col("src")).alias("attrs"), "ordinal")
    assert unordered(collapse.collapse_surfaces(raw, few_repeats=True)) == unordered(collapse.collapse_surfaces(raw))


def test_functions_of_touched_files_only(spark):
    fl, files = registry.fleet(spark, SMALL), registry.touched(spark, SMALL)
    mine = files.select(F.expr("substring(analysis_id, 3)").alias("repo_id"), "file_path")
    for version in ("base", "head"):
        whole = fl.function_versions(version)
        few = fl.function_versions(version, files)
        assert unordered(few) == unordered(whole.join(mine, ["repo_id", "file_path"], "left_semi").select(*few.columns)) and few.count() < whole.count()


def test_levels_do_not_shuffle_the_hops(spark):
    """The table of hops is laid out once; without hubs it has no salt to join on."""
    hops = walk.prepare_hops(edges(spark, [edge(fn(f"a{i}"), fn(f"a{i + 1}")) for i in range(9)]), "forward", bucketed=True)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = walk.expand(spark.createDataFrame([("r", "g", fn("a3"))], "root_id string, gv string, node string"), hops)
        assert plan_of(found).count("Exchange hashpartitioning") == 1
        assert [r.to_node for r in found.collect()] == [fn("a4")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_lines_are_shuffled_once_for_their_lead(spark):
    assert plan_of(wh.lines(spark, SMALL)).count("lineitem.parquet") == 1


def test_graph_surfaces_read_no_call_sites(spark, monkeypatch):
    """Routes, jobs, listeners and entities come from declarations; call sites are neither bound nor collapsed for them."""
    steps, real = [], index.cut
    monkeypatch.setattr(index, "cut", lambda df, name: (steps.append(name), real(df, name))[1])
    graph = index.build_graph(cf.all_facts(spark, SMALL))
    assert graph.surfaces.count() > 0
    assert sorted(steps) == ["declared", "functions", "types"]
    graph.edges
    assert sorted(steps) == ["classified", "declared", "functions", "literal", "types"]


def test_caller_totals_store_only_what_is_near(spark, monkeypatch):
    """Neither a ranking nor the edges of the whole base are stored for counts of callers."""
    registry.forget()
    steps, real = [], wh.cut
    noted = lambda df, name="step", *a: (steps.append(name), real(df, name, *a))[1]
    for module in (wh, walk, registry, collapse, skew):
        monkeypatch.setattr(module, "cut", noted)
    got = unordered(registry.direct_caller_totals(spark, SMALL))
    assert sorted(steps) == ["callers", "lines", "near_calls", "near_lines", "near_parts", "repeats", "roots", "touched"]
    fl = registry.fleet(spark, SMALL)
    _, totals = walk.direct_callers(registry.changed_roots(fl), fl.base_edges)
    assert got == unordered(totals.select("root_id", *registry.big("caller_total", "ambiguous_callers"), "truncated")) and got
    files = registry.touched(spark, SMALL)
    assert fl.near_calls("base", files).count() < fl.base_edges.filter("type IN ('calls', 'implements', 'overrides')").count()
    registry.forget()


def test_documents_are_read_in_one_pass(spark, tmp_path):
    """Functions, edges, errors and surfaces of a document are the joined tables of wire, without a join, a shuffle or a stored copy."""
    import json
    fn_ = lambda n: {"key": f"k{n}", "bodyHash": f"h{n}", "endLine": n}
    edge_ = lambda n: {"from": "a", "to": "b", "reason": f"why{n}", "callSites": [{"filePath": "f", "line": n}]}
    docs = [{"requestId": "many", "sha": "s", "functions": [fn_(1), fn_(2), None], "edges": [edge_(1), edge_(2)], "diagnostics": {"parseErrors": [{"message": "x"}, {"message": "y"}], "unresolvedRate": 0.5}},
            {"requestId": "clean", "functions": [fn_(3)], "edges": [edge_(3)], "surfaces": [{"key": "s", "kind": "table", "attrs": {"a": "b"}}]},
            {"requestId": "no edges", "functions": [fn_(4)], "edges": [], "diagnostics": {"parseErrors": [{"message": "z"}]}},
            {"requestId": "no functions", "edges": [edge_(5)]}, {"requestId": "only", "surfaces": [{"key": "t", "kind": "entity"}]}, {"sha": "no id", "functions": [fn_(6)], "edges": [edge_(6)]}]
    (tmp_path / "docs.json").write_text("\n".join(map(json.dumps, docs)) + "\n{\"requestId\": \"cut\", \"functions\": [{\n")
    r = wire.accepted(wire.read_parse_responses(spark, str(tmp_path), multi_line=False, stored=False))
    rows = wire.report_rows(r)
    assert "Exchange" not in plan_of(rows) and "Join" not in plan_of(rows) and "FileScan json" in plan_of(rows)
    f, e, p, s = wire.function_versions_of(r), wire.edges_of(r), wire.parse_errors_of(r), wire.snapshot_stats(r)
    key = "graph_version_id"
    want = f.select(key, "sha", "function_key").join(e.select(key, "reason", "call_sites"), key).join(s.select(key, "functions", "edges", "surfaces", "parse_errors", "unresolved_rate"), key).join(p.select(key, "message"), key)
    got = rows.filter("is_f").select(key, "sha", "f.key", "e.reason", wire.sites_of(F.col("e")), "n_functions", "n_edges", "n_surfaces", "n_parse_errors", "unresolved_rate", "p.message")
    plain = lambda df: sorted(str(tuple(x)) for x in df.collect())
    assert plain(got) == plain(want) and want.count() == 13
    assert plain(rows.filter("NOT is_f").select(key, "s.key", "s.kind", "s.attrs")) == plain(wire.surfaces_of(r).select(key, "key", "kind", "attrs"))
    assert rows.count() == 15


def test_ingest_stores_no_responses(spark, monkeypatch):
    steps, real = [], wire.cut
    monkeypatch.setattr(wire, "cut", lambda df, name: (steps.append(name), real(df, name))[1])
    found = registry.ingest_parse_responses(spark, SMALL)
    assert steps == [] and "Exchange" not in plan_of(found) and found.count() > 0


def few_lines(spark):
    """Lines of two repositories with parts without a number or a verb, repeats, and orders of every priority."""
    rows, n = [], 0
    for repo in ("r1", "r2", None):
        for order in range(12):
            for line, part in enumerate([order % 5 - 2, order % 4, None, 7]):
                n += 1
                rows.append((order // 2, part, order % 3, line, float(n % 7), float(n % 11), 0.01 * (n % 10), 0.08, "NRA"[n % 3], "OF"[n % 2], None, repo, None,
                             ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", None][order // 2], n % 4 != 0, n % 3 != 0, line == order % 4, [order % 5 - 2, None, 7][order % 3]))
    li = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                               "l_returnflag string, l_linestatus string, l_shipdate timestamp, repo_id string, o_orderdate timestamp, o_orderpriority string, in_base boolean, in_head boolean, "
                               "is_lead boolean, lead_part long")
    return cut(li, "few_lines")


def test_repeats_are_counted_by_numbers(spark):
    """What is counted instead of the texts of an identity is equal wherever they are."""
    li = few_lines(spark)
    raw = wh.line_edges(li, "base").unionByName(wh.order_edges(li, "base"))
    for rows, keys in ((raw, collapse.EDGE), (wh.counted_surfaces(spark, SMALL, li, "base")[0], collapse.SURFACE)):
        assert rows.groupBy(*keys).agg(F.countDistinct("identity").alias("n")).filter("n > 1").isEmpty()
        assert rows.select("identity").distinct().count() > 0.9 * rows.select(*keys).distinct().count()  # nulls are not hashed
        assert "part.P" not in plan_of(rows.select("identity"))
    assert unordered(collapse.collapse_edges(raw, few_repeats=True)) == unordered(collapse.collapse_edges(raw.drop("identity")))
    entry, stored = wh.raw_surfaces(spark, SMALL, li, "base")
    assert entry.columns == stored.columns


def test_contexts_make_only_edges_and_diffs_of_touched_files(spark, monkeypatch):
    li = few_lines(spark)
    fl = wh.Fleet(spark, SMALL)
    fl.__dict__["lines"] = li
    files = spark.createDataFrame([("a:r1", "src/main/java/com/acme/P2.java"), ("a:r2", "src/main/java/com/acme/P-2.java"), ("a:r2", "src/main/java/com/acme/P7.java")], "analysis_id string, file_path string")
    mine = wh.files_parts(files).select("repo_id", wh.part_key(F.col("l_partkey")).alias("src")).filter("src IS NOT NULL")
    raw = wh.line_edges(li, "head").unionByName(wh.order_edges(li, "head"))
    whole = collapse.collapse_edges(raw).join(mine, ["repo_id", "src"], "left_semi")
    found = fl.edges_from("head", files).filter("src IS NOT NULL")
    assert unordered(found.select(*whole.columns)) == unordered(whole) and whole.count() > 0
    assert unordered(fl.diff_texts_of(files)) == unordered(fl.diff_texts.join(files, ["analysis_id", "file_path"], "left_semi").select("analysis_id", "file_path", "text"))


def test_numbers_are_asked_for_without_symbols(spark, monkeypatch):
    registry.forget()
    steps, real = [], registry.cut
    monkeypatch.setattr(registry, "cut", lambda df, name="step", *a: (steps.append(name), real(df, name, *a))[1])
    assert registry.number_allowlist(spark, SMALL).count() > 0
    assert "numbers" in steps and "symbols" not in steps
    registry.forget()


def test_documents_are_looked_at_without_an_index_run(spark, monkeypatch):
    """Counts and broken documents come from the documents alone; no snapshot is written for them."""
    registry.forget()
    monkeypatch.setattr(index, "run_index", None)
    stats, broken = registry.index_stats(spark, SMALL), registry.quarantined_documents(spark, SMALL)
    assert stats.filter("functions > 0").count() > 0 and broken.filter("error = 'not valid JSON'").count() > 0
    registry.forget()
