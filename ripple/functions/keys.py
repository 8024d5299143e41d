"""Node keys: building, parsing and display (no Python UDF anywhere)."""

from pyspark.sql import Column, functions as F

from ripple.schema import NODE_KINDS

# fqcn up to the first '#', method up to the first '(', parameters up to the final ')'.
FUNCTION_KEY = r"(?s)^fn:([^#]+)#([^(]+)\((.*)\)\z"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` refers to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def node_kind(key) -> Column:
    """Kind before the first colon; NULL when absent or not a known kind."""
    prefix = F.substring_index(_c(key), ":", 1)
    return F.when((F.instr(_c(key), ":") > 1) & prefix.isin(NODE_KINDS), prefix)


def is_node_key(key) -> Column:
    return node_kind(key).isNotNull()


def is_function_key(key) -> Column:
    return F.coalesce(node_kind(key) == "fn", F.lit(False))


def format_function_key(fqcn, method, params) -> Column:
    return F.concat(F.lit("fn:"), _c(fqcn), F.lit("#"), _c(method), F.lit("("), F.array_join(_c(params), ","),
                    F.lit(")"))


def _params(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ",", -1))


def parse_function_key(key) -> Column:
    """struct(fqcn, class_name, method_name, param_types), or NULL when the key is not well formed."""
    k = _c(key)

    def parsed(found):
        fqcn, method, params = found["fqcn"], found["method"], found["params"]
        return F.when(F.coalesce(~F.array_contains(params, ""), F.lit(False)), F.struct(
            fqcn.alias("fqcn"), F.substring_index(fqcn, ".", -1).alias("class_name"), method.alias("method_name"), params.alias("param_types")))

    fqcn, method, text = (F.regexp_extract(k, FUNCTION_KEY, i) for i in (1, 2, 3))
    found = F.struct(fqcn.alias("fqcn"), method.alias("method"), bound(text, _params).alias("params"))
    return F.when(F.coalesce(k.rlike(FUNCTION_KEY), F.lit(False)), bound(found, parsed))


def simple_type_name(t) -> Column:
    """Last dotted segment of the part before any '[', with the suffix kept."""
    return F.regexp_replace(_c(t), r"^[^\[]*\.(?=[^.\[]*(?:\[|\z))", "")


def shown_name(p: Column) -> Column:
    """Text of a parsed function key, NULL for NULL."""
    return F.concat(p["class_name"], F.lit("."), p["method_name"], F.lit("("),
                    F.array_join(F.transform(p["param_types"], simple_type_name), ", "), F.lit(")"))


def display_name(key) -> Column:
    return F.coalesce(bound(parse_function_key(key), shown_name), _c(key))


def job_key(function_key) -> Column:
    return F.concat(F.lit("job:"), F.expr("substring(`{}`, 4)".format(function_key))
                    if isinstance(function_key, str) else F.regexp_replace(function_key, "^fn:", ""))


def route_key(verb, path) -> Column:
    return F.concat(F.lit("route:"), _c(verb), F.lit(" "), _c(path))


def listener_key(broker, topic) -> Column:
    return F.concat(F.lit("listener:"), _c(broker), F.lit(":"), _c(topic))


def entity_key(fqcn) -> Column:
    return F.concat(F.lit("entity:"), _c(fqcn))


def table_key(name) -> Column:
    return F.concat(F.lit("table:"), _c(name))


def unresolved_key(target) -> Column:
    return F.concat(F.lit("unresolved:"), _c(target))


def index_unit_id(repo, sha) -> Column:
    return F.concat_ws(":", F.lit("index"), _c(repo), _c(sha))


def analyze_unit_id(repo, pr_number, head_sha) -> Column:
    """``pr_number`` NULL means the unit came from a push."""
    which = F.coalesce(_c(pr_number).cast("string"), F.lit("push"))
    return F.concat_ws(":", F.lit("analyze"), _c(repo), F.concat(which, F.lit("-"), _c(head_sha)))


def synthetic_repo_id(owner, name) -> Column:
    """Negative, stable id for a repository that has no platform id."""
    digest = F.sha2(F.concat(_c(owner), F.lit("/"), _c(name)), 256)
    return -F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def split_full_name(s) -> Column:
    """struct(owner, name) at the first slash; NULL when there is none (send those rows to a reject table)."""
    x = _c(s)
    at = F.instr(x, "/")
    return F.when(at > 0, F.struct(F.substring_index(x, "/", 1).alias("owner"),
                                   x.substr(at + 1, F.length(x)).alias("name")))
