"""What the call-site steps shuffle and repeat as tables grow."""

import pytest
from helpers import rowset
from pyspark.sql import functions as F

from ripple.operators import calls, declarations, walk
from ripple.plans import index

SITE = ("gv string, file_path string, line int, col int, target_kind string, is_bound boolean, resolved_file string, resolved_line int, resolved_col int, "
        "recomputed_key string, scope_type string, name string, arity int, failure_class string")
FN = ("gv string, file_path string, start_line int, start_col int, end_line int, end_col int, fqcn string, method_name string, function_key string, "
      "param_types array<string>, is_constructor boolean")


@pytest.fixture
def merge_joins(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def functions(spark):
    return spark.createDataFrame([
        ("g", "A.java", 1, 1, 100, 1, "a.A", "outer", "fn:a.A#outer()", [], False), ("g", "A.java", 40, 5, 60, 9, "a.A$1", "run", "fn:a.A$1#run()", [], False),
        ("g", "A.java", 200, 1, 200, 80, "a.A", "late", "fn:a.A#late()", [], False)], FN)


def site(line, col=5, bound=True, at=None, scope="a.A", name="late"):
    return ("g", "A.java", line, col, "method", bound, "A.java" if at else None, at, 1 if at else None, None, scope, name, 0, "UnsolvedSymbolException")


def test_sites_keep_their_rows_and_are_shuffled_once(spark, merge_joins):
    sites = spark.createDataFrame([site(50), site(50), site(63, at=200), site(39), site(40, 4), site(60, 10), site(150), site(200, 81)], SITE)
    got = declarations.with_enclosing(sites, functions(spark))
    assert [r[1:] for r in rowset(got, "line", "line", "col", "function_key")] == [
        (39, 5, "fn:a.A#outer()"), (40, 4, "fn:a.A#outer()"), (50, 5, "fn:a.A$1#run()"), (50, 5, "fn:a.A$1#run()"), (60, 10, "fn:a.A#outer()"), (63, 5, "fn:a.A#outer()")]
    assert plan(got).count("Exchange hashpartitioning") <= 2  # the points and the callables


def test_rules_of_paths_are_not_applied_to_every_site(spark):
    fns = functions(spark).withColumn("is_extracted", F.lit(True))
    sites = spark.createDataFrame([site(50, at=200), site(50, at=7), site(51, bound=False), site(52, bound=False, scope=None), site(53, bound=False, name="none")], SITE)
    inside = declarations.with_enclosing(sites, fns.filter("is_extracted"))
    assert "regexp" not in plan(inside).lower()
    got = calls.classify_calls(inside, fns, lambda path: path == "A.java")
    assert rowset(got, "line", "outcome", "dst", "index_miss") == [
        (50, "calls", "fn:a.A#late()", False), (50, "calls", None, True), (51, "calls", "fn:a.A#late()", False),
        (52, "unresolved", "unresolved:#late", False), (53, "unresolved", "unresolved:a.A#none", False)]


@pytest.mark.parametrize("few", [0, 50_000])
def test_small_and_large_levels_reach_the_same(spark, monkeypatch, few):
    monkeypatch.setattr(walk, "FEW", few)
    links = spark.createDataFrame([("g", a, b) for a, b in ["ab", "ab", "bc", "ca", "cd", "dd", "de", "ae", "xy"]], "gv string, from_node string, to_node string")
    roots = spark.createDataFrame([("1", "g", "a"), ("2", "g", "c"), ("2", "g", "x")], "root_id string, gv string, node string")
    assert rowset(walk.reachable(roots, links), "root_id", "node", "distance") == [
        ("1", "a", 0), ("1", "b", 1), ("1", "c", 2), ("1", "d", 3), ("1", "e", 1),
        ("2", "a", 1), ("2", "b", 2), ("2", "c", 0), ("2", "d", 1), ("2", "e", 2), ("2", "x", 0), ("2", "y", 1)]
