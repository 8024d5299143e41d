import pytest
from helpers import rowset
from pyspark.sql import functions as F

from ripple.operators import calls, declarations, entry_rules, repository_rules
from ripple.plans import index

CALLABLE = ("gv string, file_path string, start_line int, start_col int, end_line int, end_col int, fqcn string, method_name string, "
            "params array<struct<text:string,resolved:string,is_varargs:boolean>>, param_names array<string>, return_type string, modifiers array<string>, "
            "annotations array<struct<name:string,values:map<string,string>>>, body_text string, has_body boolean, is_constructor boolean, is_interface boolean")
ROOT = "src/main/java/"


def method(fqcn, name, line, params=(), ann=(), iface=False, ctor=False, root=ROOT, end=None, col=5):
    return ("g", f"{root}{fqcn.split('.')[-1].split('$')[0]}.java", line, col, end or line + 4, 6, fqcn, name, [(t, r, False) for t, r in params], ["a"] * len(params), "void", ["public"],
            [(a, v) for a, v in ann], "body", not iface, ctor, iface)


@pytest.fixture(scope="module")
def graph(spark):
    long = [("Long", "java.lang.Long")]
    rows = [
        method("a.Carrier", "run", 1, iface=True), method("a.RoadCarrier", "run", 1), method("a.SeaCarrier", "run", 1),
        method("a.Dock", "go", 1, iface=True), method("a.H1", "go", 1), method("a.H2", "go", 1), method("a.Lone", "one", 1, iface=True), method("a.LoneImpl", "one", 1),
        method("a.Caller", "call", 1, end=30), method("a.Caller", "lambda", 5, end=9, col=9), method("a.Caller", "<init>", 40, ctor=True),
        method("a.Api", "parcel", 1, long, [("GetMapping", {"value": "/parcels/{no}"})], iface=True, root="target/generated-sources/src/main/java/"),
        method("a.ParcelDesk", "parcel", 1, long), method("a.ParcelDesk", "all", 10, ann=[("GetMapping", {"path": "all/"})]),
        method("a.ParcelDesk", "both", 20, ann=[("RequestMapping", {"value": "Api.SHARED", "method": "{RequestMethod.PUT, X}"})]),
        method("a.ParcelDesk", "odd", 30, ann=[("PostMapping", {"value": "BASE + \"/x\""})]),
        method("a.Api", "both", 20, ann=[("GetMapping", {"value": "/never"})], iface=True, root="target/generated-sources/src/main/java/"),
        method("a.Jobs", "tick", 1, ann=[("Scheduled", {"cron": "0 * * * * *"})], end=1), method("a.Jobs", "tock", 1, ann=[("Scheduled", {})], end=1, col=60),
        method("a.OnlyIface", "never", 1, ann=[("Scheduled", {})], iface=True),
        method("a.Jobs", "on", 20, ann=[("KafkaListener", {"topics": '{"parcels.in","parcels.out"}'}), ("EventListener", {})]),
        method("a.DomainRepo", "findAll", 1, iface=True), method("a.DomainRepo", "custom", 10, ann=[("Query", {"value": "q"})], iface=True),
        method("a.Over", "f", 1, long), method("a.Over", "f", 10, [("Integer", "java.lang.Integer")]), method("a.Over", "g", 20, [("List<String>", None)]),
    ]
    callables = spark.createDataFrame(rows, CALLABLE)
    t = lambda n, iface=False, ann=(), root=ROOT: ("g", f"a.{n}", n, iface, f"{root}{n}.java", [(a, v) for a, v in ann])
    types = spark.createDataFrame([
        t("Carrier", True), t("RoadCarrier", ann=[("Primary", {})]), t("SeaCarrier"), t("Dock", True), t("H1"), t("H2"), t("Lone", True), t("LoneImpl"), t("Caller"), t("Jobs"), t("Over"),
        t("Api", True, root="target/generated-sources/src/main/java/"), t("ParcelDesk", ann=[("RequestMapping", {"value": "/depot/"})]), t("OnlyIface", True), t("DomainRepo", True),
        t("MarkerRepo", True), t("FakeRepo", True), t("Crate", ann=[("Table", {"name": "crates"})])],
        "gv string, fqcn string, simple_name string, is_interface boolean, file_path string, annotations array<struct<name:string,values:map<string,string>>>")
    up = spark.createDataFrame([("g", f"a.{x}", f"a.{y}") for x, y in [
        ("RoadCarrier", "Carrier"), ("SeaCarrier", "Carrier"), ("H1", "Dock"), ("H2", "Dock"), ("LoneImpl", "Lone"), ("ParcelDesk", "Api"), ("MarkerRepo", "DomainRepo"),
        ("MarkerRepo", "Unknown")]], "gv string, fqcn string, supertype_fqcn string")
    imports = spark.createDataFrame([("g", ROOT + "Over.java", "java.util.List", False, False, 1), ("g", ROOT + "Over.java", "x.*", True, False, 0)],
                                    "gv string, file_path string, imported_name string, is_asterisk boolean, is_static boolean, ordinal int")
    consts = spark.createDataFrame([("g", "a.ParcelDesk", "SHARED", "/both")], "gv string, fqcn string, field_name string, literal string")
    site = lambda line, col, kind, bound, target, scope, name, arity, fail="UnsolvedSymbolException": (
        "g", ROOT + "Caller.java", line, col, kind, bound, f"{ROOT}{target[0]}.java" if target else None, target[1] if target else None, 5 if target else None, None, scope, name, arity, fail)
    sites = spark.createDataFrame([
        site(2, 9, "method", True, ("Carrier", 1), "a.Carrier", "run", 0), site(3, 9, "method", True, ("Carrier", 1), "a.Carrier", "run", 0),
        site(4, 9, "method", True, ("Dock", 1), "a.Dock", "go", 0), site(6, 12, "method", True, ("Lone", 1), "a.Lone", "one", 0),
        site(10, 1, "method", True, None, "java.util.List", "add", 1), site(11, 1, "method", False, None, "a.Over", "f", 1, "MethodAmbiguityException"),
        site(12, 1, "method", False, None, "a.Over", "g", 1), site(13, 1, "method", False, None, "org.Third", "x", 0), site(14, 1, "constructor", False, None, "Third", "Third", 0),
        site(15, 1, "method", False, None, None, "bare", 0)],
        "gv string, file_path string, line int, col int, target_kind string, is_bound boolean, resolved_file string, resolved_line int, resolved_col int, recomputed_key string, "
        "scope_type string, name string, arity int, failure_class string")
    tp = lambda fq, ext, imp, arg: ("g", f"a.{fq}", f"{ROOT}{fq}.java", ext, imp, arg, 0)
    params = spark.createDataFrame([tp("MarkerRepo", "JpaRepository", "org.springframework.data.jpa.repository.JpaRepository", "a.Crate"),
                                    tp("MarkerRepo", "CrudRepository", "org.springframework.data.repository.CrudRepository", "a.Crate"),
                                    tp("FakeRepo", "Repository", "com.other.Repository", "a.OrderLine"), tp("DomainRepo", "Repository", None, "a.OrderLine")],
                                   "gv string, fqcn string, file_path string, extended_simple_name string, imported_from string, first_type_arg string, ordinal int")
    return index.build_graph({"callables": callables, "types": types, "supertypes": up, "imports": imports, "constants": consts, "call_sites": sites, "type_params": params})


def test_edges(graph):
    rows = {(r.src, r.dst, r.type): r for r in graph.edges.collect()}
    pick = lambda s, d, t="calls": rows.get((s, d, t)) and (rows[s, d, t].inferred, rows[s, d, t].confidence, len(rows[s, d, t].call_sites))
    call, lam = "fn:a.Caller#call()", "fn:a.Caller#lambda()"
    assert pick(call, "fn:a.Carrier#run()") == (False, "exact", 2)
    assert pick(call, "fn:a.RoadCarrier#run()") == (True, "single_impl", 2) and pick(call, "fn:a.SeaCarrier#run()") is None
    assert pick(call, "fn:a.H1#go()") == pick(call, "fn:a.H2#go()") == (True, "ambiguous", 1)
    assert pick(lam, "fn:a.Lone#one()") == (False, "exact", 1) and pick(lam, "fn:a.LoneImpl#one()") == (True, "single_impl", 1)
    assert pick(call, "fn:a.Over#g(java.util.List)") == (False, "single_impl", 1)
    lost = {d: (r.confidence, r.reason) for (s, d, t), r in rows.items() if t == "unresolved"}
    assert lost == {"unresolved:a.Over#f": ("ambiguous", "ambiguous_overload"), "unresolved:org.Third#x": ("ambiguous", "external_type"),
                    "unresolved:Third#<init>": ("ambiguous", "external_type"), "unresolved:#bare": ("ambiguous", "external_type")}
    assert {(s, d) for s, d, t in rows if t == "implements"} == {(f"fn:a.{a}#{m}()", f"fn:a.{b}#{m}()") for a, b, m in [
        ("RoadCarrier", "Carrier", "run"), ("SeaCarrier", "Carrier", "run"), ("H1", "Dock", "go"), ("H2", "Dock", "go"), ("LoneImpl", "Lone", "one")]}
    assert {(s, d, r.confidence) for (s, d, t), r in rows.items() if t == "queries"} == {
        ("fn:a.DomainRepo#findAll()", "entity:a.Crate", "exact"), ("fn:a.DomainRepo#custom()", "entity:a.Crate", "regex")}
    assert pick("entity:a.Crate", "table:crates", "maps_to") == (True, "exact", 1)


def test_candidates(graph):
    r = graph.classified.filter("reason = 'ambiguous_overload'").first()
    assert r.candidates == ["a.Over.f(java.lang.Integer)", "a.Over.f(java.lang.Long)"]
    assert graph.classified.filter("outcome = 'external'").count() == 1


def test_entry_points(graph):
    # A written path without a leading slash is no proven literal, so its route is ambiguous.
    assert {(r.key, r.function_key, r.confidence, r.inherited) for r in graph.routes.collect()} == {
        ('route:POST /depot/BASE + "/x"', "fn:a.ParcelDesk#odd()", "ambiguous", False), ("route:GET /depot/all", "fn:a.ParcelDesk#all()", "ambiguous", False),
        ("route:GET /depot/parcels/{no}", "fn:a.ParcelDesk#parcel(java.lang.Long)", "exact", True), ("route:PUT /depot/both", "fn:a.ParcelDesk#both()", "exact", False)}
    assert rowset(graph.jobs, "key") == [("job:a.Jobs#tick()",), ("job:a.Jobs#tock()",)]
    assert rowset(graph.listeners, "key") == [("listener:event:a.Jobs#on()",), ("listener:kafka:parcels.in",)]
    assert sorted(r.key for r in graph.surfaces.collect() if r.kind in ("entity", "table")) == ["entity:a.Crate", "table:crates"]


def test_functions_and_selectors(graph):
    f = {r.function_key: r for r in graph.all_functions.collect()}
    assert f["fn:a.Over#g(java.util.List)"].unresolved_params == 1 and f["fn:a.Caller#<init>()"].return_type == "void"
    assert f["fn:a.Carrier#run()"].is_abstract and not f["fn:a.H1#go()"].is_abstract
    assert rowset(graph.selectors, "function_key", "is_primary") == [("fn:a.RoadCarrier#run()", True)]


def test_anonymous_numbers_span_pieces(spark):
    rows = [("g", "F.java", "a.F", i, 1, True) for i in range(1, 60)] + [("g", "F.java", "a.F", 3, 2, False), ("g", "G.java", "a.G", 1, 1, True)]
    df = spark.createDataFrame(rows, "gv string, file_path string, top_level_fqcn string, line int, col int, has_anonymous_body boolean").repartition(5)
    got = {(r.file_path, r.line): r.fqcn for r in declarations.number_anonymous(df).collect()}
    assert len(got) == 60 and got["F.java", 59] == "a.F$59" and got["F.java", 7] == "a.F$7" and got["G.java", 1] == "a.G$1"


def test_local_types(spark):
    spans = spark.createDataFrame([("g", "F", 1, 1, 100, 1, "a.Outer", "Outer"), ("g", "F", 10, 1, 50, 1, None, "L1"), ("g", "F", 20, 1, 40, 1, None, "L2"), ("g", "F", 60, 1, 70, 1, "a.Outer.In", "In")],
                                  "gv string, file_path string, start_line int, start_col int, end_line int, end_col int, fqcn string, simple_name string")
    points = spark.createDataFrame([("g", "F", n, 2) for n in (5, 15, 30, 65)], "gv string, file_path string, line int, col int")
    assert rowset(declarations.declaring_type(points, spans), "line", "fqcn") == [(15, "a.Outer$L1"), (30, "a.Outer$L1$L2"), (5, "a.Outer"), (65, "a.Outer.In")]
