from pyspark.sql import functions as F

from ripple.functions import canonical, keys, text, trust
from ripple.operators import grounding


def ev(spark, values, *cols, schema="x string"):
    df = spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)
    return [tuple(r) for r in df.select(*cols).collect()]


def test_kinds_and_parse(spark):
    x = F.col("x")
    got = ev(spark, ["fn:a.b.C#m(int,java.lang.String[])", "listener:kafka:parcels.in", "http://x", ":fn", "fn:C#m(,)", "fn:C#m", "fn:#m()", "fn:C#m()", None],
             keys.node_kind(x), keys.is_function_key(x), keys.parse_function_key(x)["class_name"], keys.display_name(x))
    assert got == [("fn", True, "C", "C.m(int, String[])"), ("listener", False, None, "listener:kafka:parcels.in"), (None, False, None, "http://x"),
                   (None, False, None, ":fn"), ("fn", True, None, "fn:C#m(,)"), ("fn", True, None, "fn:C#m"), ("fn", True, None, "fn:#m()"),
                   ("fn", True, "C", "C.m()"), (None, False, None, None)]


def test_paths(spark):
    got = ev(spark, [("/depot/", "/all"), ("/depot", "all"), ("", ""), (None, "a//b/")], text.join_paths("x", "y"), schema="x string, y string")
    assert [g[0] for g in got] == ["/depot/all", "/depot/all", "/", "/a/b"]


def test_elements_and_names(spark):
    x = F.col("x")
    assert [g[0] for g in ev(spark, ['{"parcels.in", "b"}', "plain", "{A.B}"], text.first_element(x))] == ["parcels.in", "plain", "A.B"]
    assert [g[0] for g in ev(spark, ["HTMLPage", "OrderLine", "x"], text.camel_to_underscores(x))] == ["h_t_m_l_page", "order_line", "x"]
    assert [g[0] for g in ev(spark, ["Map<String, List<Integer>>[]", "T...", "? extends Foo", "Outer<A>.Inner<B>"], text.erase_type_text(x))] == [
        "Map[]", "T[]", "java.lang.Object", "Outer.Inner"]


def test_access_rules(spark):
    x = F.col("x")
    assert [g[0] for g in ev(spark, ["fn:R#saveAll()", "fn:R#SaveAll()", "fn:R#odd()", "bad"], text.access_of(x))] == ["write", "read", "read", "read"]
    assert [g[0] for g in ev(spark, ["SaveAll", "removeX", "Search", "odd"], text.access_of_method(x))] == ["write", "write", "read", "unknown"]


def test_signature(spark):
    got = ev(spark, [("fn:a.S#find(java.lang.Long,int)", "a.Foo", ["id"], ["static", "public"]), ("fn:a.S#f()", "void", [], [])],
             text.render_signature("k", F.col("r"), "n", "m"), schema="k string, r string, n array<string>, m array<string>")
    assert [g[0] for g in got] == ["public static Foo find(Long id, int arg1)", "void f()"]


def test_trust_and_ids(spark):
    assert ev(spark, [("exact", "regex"), ("ambiguous", "regex")], trust.weaker("x", "y"), schema="x string, y string") == [("regex",), ("ambiguous",)]
    (n, s), = ev(spark, [("acme", "acme/billing/x")], keys.synthetic_repo_id("x", "y"), keys.split_full_name("y")["name"], schema="x string, y string")
    assert -(2 ** 31) < n <= 0 and s == "billing/x"


def test_canonical_json_ignores_field_order(spark):
    a = spark.sql("select named_struct('b', 1, 'a', named_struct('z', null, 'y', array(2, 1))) s")
    b = spark.sql("select named_struct('a', named_struct('y', array(2, 1), 'z', null), 'b', 1) s")
    texts = [d.select(canonical.canonical_json("s", d.schema["s"].dataType)).first()[0] for d in (a, b)]
    assert texts[0] == texts[1] == '{"a":{"y":[2,1],"z":null},"b":1}'


def test_deep_paths_and_generics(spark):
    """No depth is special: twenty levels of '..' and of type parameters."""
    from ripple.functions.text import erase_type_text
    from ripple.sources.files import normalise_path

    deep = "/".join(f"d{i}" for i in range(20)) + "/" + "../" * 20 + "src/main/java/A.java"
    nested = "In<" * 20 + "X" + ">" * 20
    rows = [(deep, f"Outer<{nested}>.Inner<{nested}>"), ("../../a/./b//../C.java", "Map<String, List<int[]>>..."), ("a\\b\\C.java", "? extends T"), ("/x/../y.java", "int")]
    df = spark.createDataFrame(rows, "path string, t string")
    got = [tuple(r) for r in df.select(normalise_path(F.col("path")), erase_type_text(F.col("t"))).collect()]
    assert got == [("src/main/java/A.java", "Outer.Inner"), ("../../a/C.java", "Map[]"), ("a/b/C.java", "java.lang.Object"), ("/y.java", "int")]


def test_keys_are_parsed_once(spark):
    """Names of a key come from one parse, however many there are."""
    df = spark.range(1).selectExpr("concat('fn:a.B#m(x.Y[],', id, ')') AS key").select(grounding.key_symbols(F.col("key")).alias("s"))
    assert str(df._jdf.queryExecution().optimizedPlan()).count("regexp_extract(") <= 3
    assert df.first().s == ["a.B", "B", "m", "B.m(Y[], 0)", "x.Y[]", "0", "Y[]", "0"]
