"""Adapter: the part and line-item tables read as code facts (callables, types, call sites, ...).

Eight consecutive parts form a type, types form a shallow tree inside four graph versions, and every line
item is a call site of its part. Attributes come from the columns; every row takes part.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ripple.session import spread
from ripple.sources.warehouse import table

ANN = "array<struct<name:string,values:map<string,string>>>"
NO_ANN = f"cast(array() as {ANN})"


def _ann(name, *kv):
    values = f"map({', '.join(kv)})" if kv else "cast(map() as map<string,string>)"
    return f"array(named_struct('name', '{name}', 'values', {values}))"


def _parts(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    return p.selectExpr("*", "p_partkey div 8 AS k", "cast(p_partkey % 8 AS int) AS slot").selectExpr(
        "*", "concat('g', k % 4) AS gv", "concat('com.acme.T', k) AS fqcn", f"{file_expr('k')} AS file_path",
        "slot * 20 + 1 AS start_line", "if(slot % 2 = 0, 'Long', 'Integer') AS first_type")


def file_expr(k):
    return (f"concat(if({k} % 5 = 4, 'target/generated-sources/', ''), 'src/main/java/com/acme/T', {k}, '.java')")


def callables(spark, d) -> DataFrame:
    p = _parts(spark, d)
    param = lambda text, resolved, var: f"named_struct('text', {text}, 'resolved', {resolved}, 'is_varargs', {var})"
    one = param("first_type", "concat('java.lang.', first_type)", "false")
    two = param("'List<String>'", "cast(null AS string)", "p_size > 25")
    topics = """concat('{"t.', p_name, '", "other"}')"""
    listener = _ann("KafkaListener", "'topics'", topics)
    annotations = f"""CASE p_type
        WHEN 'ECONOMY' THEN {_ann('GetMapping', "'value'", "if(p_size > 40, concat('/$', '{base}/x'), concat('/', replace(p_name, ' ', '/'), '/'))")}
        WHEN 'STANDARD' THEN {_ann('RequestMapping', "'path'", "concat('Api.PATH_', upper(replace(p_name, ' ', '_')))", "'method'", "'{RequestMethod.PUT, RequestMethod.GET}'")}
        WHEN 'SMALL' THEN {_ann('Scheduled', "'cron'", "concat('0 ', p_size, ' * * * *')")}
        WHEN 'MEDIUM' THEN if(p_size > 25, {_ann('KafkaListener')}, {listener})
        WHEN 'PROMO' THEN {_ann('Query', "'value'", "p_name")}
        ELSE {NO_ANN} END"""
    common = ["gv", "file_path"]
    outer = p.selectExpr(
        *common, "start_line", "5 AS start_col", "start_line + 14 AS end_line", "6 AS end_col", "fqcn",
        "concat('op', slot div 2) AS method_name", f"if(p_size % 2 = 1, array({one}, {two}), array({one})) AS params",
        "array('a', 'b') AS param_names", "concat('com.acme.', p_type) AS return_type",
        "if(p_type = 'PROMO', array('public', 'abstract'), array('public')) AS modifiers", f"{annotations} AS annotations",
        "p_name AS body_text", "p_type <> 'PROMO' AS has_body", "p_size = 50 AS is_constructor", "k % 3 = 0 AS is_interface")
    none = "cast(array() AS array<struct<text:string,resolved:string,is_varargs:boolean>>)"
    inner = p.filter("p_type = 'LARGE'").selectExpr(
        *common, "start_line + 3 AS start_line", "9 AS start_col", "start_line + 6 AS end_line", "10 AS end_col",
        "concat(fqcn, '$', slot) AS fqcn", "'run' AS method_name", f"{none} AS params", "cast(array() AS array<string>) AS param_names",
        "'void' AS return_type", "array('public') AS modifiers", f"{NO_ANN} AS annotations", "p_name AS body_text",
        "true AS has_body", "false AS is_constructor", "false AS is_interface")
    return outer.unionByName(inner)


def types(spark, d) -> DataFrame:
    t = _parts(spark, d).groupBy("k", "gv", "fqcn", "file_path").agg(F.count("*").alias("n"))
    annotations = (f"concat(if(k % 2 = 1, {_ann('RequestMapping', quoted('value'), 'concat(chr(47), chr(116), k, chr(47))')}, {NO_ANN}), "
                   f"if(k % 7 = 0, {_ann('Primary')}, {NO_ANN}), if(k % 7 = 1, {_ann('Qualifier')}, {NO_ANN}), "
                   f"if(k % 11 = 0, {_ann('Table', quoted('name'), 'concat(chr(116), k)')}, {NO_ANN}), {_ann('Entity', quoted('name'), quoted(' '))})")
    return t.selectExpr("gv", "fqcn", "concat('T', k) AS simple_name", "k % 3 = 0 AS is_interface", "file_path",
                        f"{annotations} AS annotations", "k", "1 AS start_line", "1 AS start_col", "400 AS end_line", "1 AS end_col")


def quoted(s):
    return f"'{s}'"


def supertypes(spark, d) -> DataFrame:
    return types(spark, d).filter("k >= 4").selectExpr(
        "gv", "fqcn", "concat('com.acme.T', (k div 8) * 4 + k % 4) AS supertype_fqcn", "0 AS ordinal")


def imports(spark, d) -> DataFrame:
    t = types(spark, d)
    row = lambda cond, name, star, n: t.filter(cond).selectExpr(
        "gv", "file_path", f"'{name}' AS imported_name", f"{star} AS is_asterisk", "false AS is_static", f"{n} AS ordinal")
    return reduce(DataFrame.unionByName, [row("k % 2 = 0", "java.util.List", "false", 1), row("k % 2 = 0", "com.other.List", "false", 2),
                                          row("true", "org.springframework.data.repository", "true", 3)])


def constants(spark, d) -> DataFrame:
    return _parts(spark, d).groupBy("gv", "fqcn", F.expr("concat('PATH_', upper(replace(p_name, ' ', '_')))").alias("field_name")).agg(
        F.min(F.expr("if(p_size > 35, null, concat('/c/', replace(p_name, ' ', '-')))")).alias("literal"))


def type_params(spark, d) -> DataFrame:
    return types(spark, d).filter("is_interface").selectExpr(
        "gv", "fqcn", "file_path", "'CrudRepository' AS extended_simple_name",
        "if(k % 6 = 0, 'org.springframework.data.repository.CrudRepository', 'com.other.CrudRepository') AS imported_from",
        "if(k % 12 = 0, concat('com.acme.OrderLine', k), concat('com.acme.T', k + 4)) AS first_type_arg", "0 AS ordinal")


def call_sites(spark, d) -> DataFrame:
    """Every line item is a call from its part to a method of the supertype of its type; the supplier picks which."""
    li = spread(table(spark, d, "lineitem")).selectExpr(
        "l_partkey AS p", "((l_partkey div 64) * 4 + (l_partkey div 8) % 4) * 8 + l_suppkey % 8 AS t", "l_suppkey AS s", "l_linenumber AS ln",
        "cast(l_quantity AS int) AS q", "month(l_shipdate) AS m")
    bound, jdk = "m <> 1", "m = 2"
    at = lambda x: f"if({bound} AND NOT {jdk}, {x}, null)"
    return li.selectExpr(
        "concat('g', (p div 8) % 4) AS gv", f"{file_expr('(p div 8)')} AS file_path", "cast((p % 8) * 20 + 1 + ln AS int) AS line",
        "q AS col", "CASE ln WHEN 7 THEN 'constructor' WHEN 6 THEN 'method_ref' ELSE 'method' END AS target_kind",
        f"{bound} AS is_bound", at(file_expr('(t div 8)')) + " AS resolved_file",f"{at('cast((t % 8) * 20 + 1 AS int)')} AS resolved_line",
        f"{at('if(q = 50, 4, 5)')} AS resolved_col", f"{at(quoted('fn:com.acme.Missing#lost()'))} AS recomputed_key",
        "if(ln = 1, null, concat('com.acme.T', t div 8)) AS scope_type", "concat('op', cast(t % 8 AS int) div 2) AS name",
        "cast(1 + s % 2 AS int) AS arity", "if(s % 3 = 0, 'MethodAmbiguityException', 'UnsolvedSymbolException') AS failure_class")


def creations(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "concat('g', (l_partkey div 8) % 4) AS gv", f"{file_expr('(l_partkey div 8)')} AS file_path",
        "concat('com.acme.T', l_partkey div 8) AS top_level_fqcn", "cast((l_partkey % 8) * 20 + 1 + l_linenumber AS int) AS line",
        "cast(l_quantity AS int) AS col", "l_returnflag = 'R' AS has_anonymous_body")


def all_facts(spark, d) -> dict:
    return {"callables": callables(spark, d), "types": types(spark, d), "supertypes": supertypes(spark, d),
            "imports": imports(spark, d), "constants": constants(spark, d), "call_sites": call_sites(spark, d),
            "type_params": type_params(spark, d)}
