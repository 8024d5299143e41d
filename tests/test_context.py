import json

import pytest
from helpers import edge, edges, rowset, surfaces

from ripple.operators import explain, grounding
from ripple.plans import analyze

CONTROLLER, SERVICE = "fn:org.depot.edge.ParcelGate#fetch(java.lang.Long)", "fn:org.depot.floor.ParcelDesk#locate(java.lang.Long)"
REFRESHER, REPO = "fn:org.depot.clock.ParcelSweep#sweep()", "fn:org.depot.shelf.ParcelShelf#locate(java.lang.Long)"
CACHE, ROUTE, JOB = "fn:org.depot.drawer.ParcelDrawer#fetch(java.lang.Long)", "route:GET /v2/parcels/{code}", "job:org.depot.clock.DawnSweepJob#start()"
PATH = "src/main/java/org/depot/floor/ParcelDesk.java"


@pytest.fixture(scope="module")
def analysis(spark):
    base = edges(spark, [
        edge(CONTROLLER, SERVICE), edge(REFRESHER, SERVICE), edge(ROUTE, CONTROLLER, "handles", True), edge(JOB, REFRESHER, "triggers", True), edge(SERVICE, REPO),
        edge(REPO, "entity:org.depot.Parcel", "queries", True), edge("entity:org.depot.Parcel", "table:parcel_row", "maps_to", True)])
    head = edges(spark, [edge(SERVICE, REPO, gv="h"), edge(SERVICE, CACHE, gv="h")])
    surf = surfaces(spark, [("g", ROUTE, "http_route"), ("g", JOB, "scheduled_job")])
    fv = "graph_version_id string, function_key string, file_path string, start_line int, end_line int, body_hash string, return_type string, param_names array<string>, modifiers array<string>"
    facts = lambda gv, ret, body: spark.createDataFrame([(gv, SERVICE, PATH, 12, 19, body, ret, ["code"], ["public"])], fv)
    analyses = spark.createDataFrame([("a1", "r", "depot", "yard", 73, "g", "h")],
                                     "analysis_id string, repo_id string, owner string, name string, pr_number int, base_gv string, head_gv string")
    touched = spark.createDataFrame([("a1", PATH)], "analysis_id string, file_path string")
    changes = analyze.detect(analyses, facts("g", "org.depot.Parcel", "b1"), facts("h", "java.util.Optional", "b2"), touched)
    diffs = spark.createDataFrame([("a1", SERVICE, "@@ -12,6 +12,8 @@ …")], "analysis_id string, function_key string, source_diff string")
    rates = spark.createDataFrame([("g", 0.083)], "id string, unresolved_rate double")
    return analyze.Analysis(analyses, changes.persist(), base, head, surf, source_diffs=diffs, versions=rates)


def test_golden_context(analysis):
    row = analyze.build_context(analysis).first()
    caller = lambda i, key, name: {"position": i, "key": key, "display_name": name, "hops": 1, "file_path": "src/main/java/X.java", "line": 1, "usage": "calls this method",
                                   "signature_compatible": False, "confidence": "exact", "inferred": False}
    callee = lambda key, name, new: {"key": key, "type": "calls", "display_name": name, "is_new": new, "confidence": "exact", "inferred": False}
    assert row.context.asDict(recursive=True) == {
        "schema_version": 1, "repo": {"owner": "depot", "name": "yard", "pr_number": 73},
        "changed_method": {
            "key": SERVICE, "display_name": "ParcelDesk.locate(Long)", "change_kind": "signature_changed", "file_path": PATH, "source_diff": "@@ -12,6 +12,8 @@ …",
            "signature_diff": {"base": "public Parcel locate(Long code)", "head": "public Optional locate(Long code)", "return_type_changed": True, "params_changed": False,
                               "throws_added": [], "visibility_changed": False}},
        "affected_by": {
            "direct_callers": [caller(1, REFRESHER, "ParcelSweep.sweep()"), caller(2, CONTROLLER, "ParcelGate.fetch(Long)")],
            "direct_caller_total": 2, "direct_callers_truncated": False,
            "reachable_surfaces": {"entrypoints": [{"key": JOB, "kind": "scheduled_job", "min_hops": 2, "via_inferred_edge": True},
                                                   {"key": ROUTE, "kind": "http_route", "min_hops": 2, "via_inferred_edge": True}],
                                   "data": [{"key": "table:parcel_row", "kind": "table", "access": "read", "via_inferred_edge": True, "confidence": "exact"}]},
            "traversal": {"max_depth": 5, "depth_cap_hit": False, "nodes_visited": 3}},
        "now_depends_on": {"callees": [callee(CACHE, "ParcelDrawer.fetch(Long)", True), callee(REPO, "ParcelShelf.locate(Long)", False)]},
        "change_history": {"commits": [], "truncated_at_rename": False},
        "quality": {"unresolved_rate": 0.083, "ambiguous_edges_on_path": 0, "parse_errors_in_touched_files": 0}}


def test_digest_is_stable(analysis):
    first, again = (analyze.context_digest(analysis).collect() for _ in range(2))
    assert first == again and len(first) == 1 and len(first[0].context_hash) == 64


def test_template_is_clean_and_inventions_are_found(spark, analysis):
    template = explain.template_sections(analysis)
    s = template.first().sections
    assert s.what_changed == f"ParcelDesk.locate(Long) was changed with a signature change in {PATH}. Return type changed from `public Parcel locate(Long code)` to `public Optional locate(Long code)`."
    assert s.who_is_affected.startswith("2 direct caller(s) found. ParcelSweep.sweep() at src/main/java/X.java:1: calls this method — signature-incompatible.")
    assert s.what_to_check == "New dependencies introduced: ParcelDrawer.fetch(Long). A notable share of calls in the base graph are unresolved."
    symbols, numbers = grounding.symbol_allowlist(analysis), grounding.number_allowlist(analysis)
    check = lambda texts: grounding.violations(grounding.candidates(texts), symbols, numbers)
    assert check(explain.section_texts(template)).count() == 0
    root = template.first().root_id
    prose = ["org.depot.GhostDesk.vanish() moved.", "See org.depot.LostGate.", "It serves PUT /v2/crates.", "It writes lost_index.",
             "Touched src/main/java/org/depot/Elsewhere.java.", "Some 61 places call it.", f"Fine: GET /v2/parcels/{{code}}, ParcelDesk.locate, 2 callers, parcel_row, {PATH}, é12."]
    texts = spark.createDataFrame([(root, str(i), "what_changed", t) for i, t in enumerate(prose)], "root_id string, text_id string, section string, text string")
    got = sorted((r.text_id, r.kind, r.token) for r in check(texts).collect())
    assert got == [("0", "symbol", "org.depot.GhostDesk.vanish()"), ("1", "symbol", "org.depot.LostGate"), ("2", "symbol", "PUT /v2/crates"), ("3", "symbol", "lost_index"),
                   ("4", "symbol", "src/main/java/org/depot/Elsewhere.java"), ("5", "number", "61"), ("6", "number", "12")]


def test_attempts_cache_and_prompt(spark, analysis):
    sec = "root_id string, sections struct<what_changed:string,who_is_affected:string,what_to_check:string>, raw string"
    mk = lambda tag: spark.createDataFrame([(r, (tag, tag, tag), tag) for r in "abc"], sec)
    bad = spark.createDataFrame([("b", 1, 2), ("c", 1, 1), ("c", 2, 3)], "root_id string, attempt int, n int")
    got = {r.root_id: (r.sections.what_changed, r.raw, r.attempts, r.degraded, r.violations) for r in explain.resolve_attempts(mk("one"), mk("two"), bad, mk("tpl")).collect()}
    assert got == {"a": ("one", "one", 1, False, 0), "b": ("two", "two", 2, False, 0), "c": ("tpl", "", 2, True, 3)}
    rows = "id string, context_hash string, prompt_version string, model string, created_at int"
    old, new = spark.createDataFrame([("e1", "h", "v1", "m", 9)], rows), spark.createDataFrame([("e2", "h", "v1", "m", 1), ("e3", "k", "v1", "m", 2), ("e4", "k", "v1", "m", 3)], rows)
    assert sorted(r.id for r in explain.save_explanations(new, old).collect()) == ["e1", "e3"]
    assert [r.is_hit for r in explain.cache_probe(new.orderBy("id"), old).orderBy("id").collect()] == [True, False, False]
    raw = ['{"whatChanged":"a","whoIsAffected":"b","whatToCheck":"c"}', '{"whatChanged":"a","whoIsAffected":"b"}', "{oops", None, '{"whatChanged":1,"whoIsAffected":"b","whatToCheck":"c"}']
    good, rejected = explain.parse_generated(spark.createDataFrame([(i, r, None, 5) for i, r in enumerate(raw)], "n int, raw string, input_tokens long, output_tokens long"))
    assert [(r.n, r.input_tokens, r.output_tokens) for r in good.collect()] == [(0, 0, 5)]
    assert sorted((r.n, r.error) for r in rejected.collect()) == [(1, "missing section"), (2, "not valid JSON"), (3, "no text"), (4, "missing section")]
    ctx = analyze.build_context(analysis)
    token = spark.createDataFrame([(ctx.first().root_id, "x.y", "what_changed", "dotted", 1), (ctx.first().root_id, "x.y", "what_changed", "dotted", 0)],
                                  "root_id string, token string, section string, stage string, pos int")
    prompt = explain.prompt_rows(ctx, "v1", ["one", "two"], token).first().prompt
    assert prompt.startswith("one\n\ntwo\n\nThese terms") and "again: x.y\n\nprompt version: v1\n\nContext object:\n" in prompt
    assert json.loads(prompt.split("Context object:\n")[1])["schema_version"] == 1


def test_candidates_work_each_text_out_once(spark):
    """Each blanked text is made once, however many patterns look at it; texts without a mark of a pattern, null and empty ones included."""
    rows = spark.createDataFrame([(1, "see a/B.java then a.B.c(x) and GET /x_y/z, some_name 12 a_1.b 3x x3 _4 5_"), (2, "plain words"), (3, None), (4, "")], "id int, text string")
    got = grounding.candidates(rows)
    assert str(got._jdf.queryExecution().optimizedPlan()).count("regexp_replace") == 3
    assert rowset(got, "stage", "pos", "token") == sorted([("file", 0, "a/B.java"), ("call", 0, "a.B.c(x)"), ("route", 0, "GET /x_y/z"), ("dotted", 0, "a_1.b"), ("snake", 0, "some_name"),
                                                           ("snake", 1, "a_1"), ("number", 0, "12")], key=str)


def test_attempts_share_equal_sections(spark):
    texts = explain.attempt_texts(spark.sql("""SELECT 'r' AS root_id, named_struct('what_changed', 'a', 'who_is_affected', 'b', 'what_to_check', cast(null AS string)) AS s1,
        named_struct('what_changed', 'a', 'who_is_affected', 'c', 'what_to_check', cast(null AS string)) AS s2"""), ["s1", "s2"])
    assert rowset(texts, "text_id", "section", "text") == [("1", "who_is_affected", "b"), ("1,2", "what_changed", "a"), ("1,2", "what_to_check", None), ("2", "who_is_affected", "c")]
