"""String helpers used by the graph rules."""

from pyspark.sql import Column, functions as F

from ripple.functions.keys import _c, parse_function_key, simple_type_name

# Verb prefixes of the two access rules.
WALK_WRITE_VERBS = ["save", "delete", "persist"]
STORE_WRITE_VERBS = ["save", "delete", "remove", "persist", "insert", "update"]
STORE_READ_VERBS = ["find", "get", "read", "query", "exists", "count", "stream", "search"]
VISIBILITIES = ["public", "protected", "private"]
# The phrase shown for each edge type.
USAGE = {"calls": "calls this method", "implements": "implements this interface method",
         "overrides": "overrides this method"}


def _strip_slashes(x: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"^/+|/+\z", "")


def join_paths(class_path, method_path) -> Column:
    """One leading slash, no trailing slash, no double slashes."""
    joined = F.concat(_strip_slashes(_c(class_path)), F.lit("/"), _strip_slashes(_c(method_path)))
    return F.concat(F.lit("/"), _strip_slashes(F.regexp_replace(joined, "/+", "/")))


def first_element(raw) -> Column:
    """First entry of a brace list, unquoted; any other text unchanged."""
    x = _c(raw)
    inner = F.trim(F.substring_index(F.regexp_replace(x, r"^\{|\}\z", ""), ",", 1))
    return F.when(x.startswith("{"), F.regexp_replace(inner, r'^"(.*)"\z', "$1")).otherwise(x)


def annotation_path(values) -> Column:
    v = _c(values)
    raw = F.coalesce(F.try_element_at(v, F.lit("value")), F.try_element_at(v, F.lit("path")))
    return F.when(F.trim(raw) != "", first_element(raw))


def http_verb(values) -> Column:
    declared = F.try_element_at(_c(values), F.lit("method"))
    first = F.trim(F.substring_index(F.trim(F.regexp_replace(declared, "[{}]", "")), ",", 1))
    return F.coalesce(F.upper(F.substring_index(first, ".", -1)), F.lit("ANY"))


def camel_to_underscores(name) -> Column:
    return F.lower(F.regexp_replace(_c(name), r"(?<!^)(\p{Lu})", "_$1"))


def access_of(key) -> Column:
    """Case-sensitive verb rule of the walk: anything that is not a write verb reads."""
    method = parse_function_key(key)["method_name"]
    write = F.coalesce(method.rlike("^(" + "|".join(WALK_WRITE_VERBS) + ")"), F.lit(False))
    return F.when(write, "write").otherwise("read")


def access_of_method(name) -> Column:
    """Case-insensitive verb rule for repository methods; unknown stays unknown."""
    low = F.lower(_c(name))
    return (F.when(low.rlike("^(" + "|".join(STORE_WRITE_VERBS) + ")"), "write")
            .when(low.rlike("^(" + "|".join(STORE_READ_VERBS) + ")"), "read").otherwise("unknown"))


def visibility(modifiers) -> Column:
    found = F.filter(_c(modifiers), lambda m: m.isin(VISIBILITIES))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))


def render_signature(key, return_type, param_names, modifiers) -> Column:
    p = parse_function_key(key)
    names, mods = _c(param_names), _c(modifiers)
    vis = visibility(mods)
    params = F.transform(p["param_types"], lambda t, i: F.concat(
        simple_type_name(t), F.lit(" "),
        F.coalesce(F.get(names, i), F.concat(F.lit("arg"), i.cast("string")))))
    words = F.filter(F.concat(F.array(vis), F.filter(mods, lambda m: m != vis)), lambda w: w != "")
    text = F.concat(F.array_join(words, " "), F.lit(" "), simple_type_name(return_type), F.lit(" "),
                    p["method_name"], F.lit("("), F.array_join(params, ", "), F.lit(")"))
    return F.coalesce(F.trim(text), _c(key))


def usage_of(edge_type) -> Column:
    t = _c(edge_type)
    out = F.concat(F.lit('reaches this method via a "'), t, F.lit('" edge'))
    for value, phrase in USAGE.items():
        out = F.when(t == value, F.lit(phrase)).otherwise(out)
    return out


def content_fingerprint(text) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(_c(text), F.lit("")), 256))


def erase_type_text(t) -> Column:
    """Source-text erasure: generics dropped at any depth, varargs to ``[]``, wildcard to Object.

    A text whose '<' is never closed is cut there.
    """
    x = F.regexp_replace(F.trim(_c(t)), r"\s+", " ")
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("kept"))
    step = lambda a, ch: F.struct(
        F.greatest(a["depth"] + F.when(ch == "<", 1).when(ch == ">", -1).otherwise(0), F.lit(0)).alias("depth"),
        F.concat(a["kept"], F.when((a["depth"] > 0) | ch.isin("<", ">"), "").otherwise(ch)).alias("kept"))
    x = F.aggregate(F.split(x, ""), start, step, lambda a: a["kept"])
    x = F.regexp_replace(F.regexp_replace(x, r"\s*\.\.\.\s*\z", "[]"), r"\s+", "")
    return F.when(F.trim(_c(t)).startswith("?"), "java.lang.Object").otherwise(x)


def relative_path(root, path) -> Column:
    """Workspace-relative path with forward slashes."""
    p = F.translate(_c(path), "\\", "/")
    r = F.concat(F.regexp_replace(F.translate(_c(root), "\\", "/"), r"/+\z", ""), F.lit("/"))
    return F.when(F.startswith(p, r), p.substr(F.length(r) + 1, F.length(p))).otherwise(p)


def annotation(annotations, name: str) -> Column:
    """First annotation with that simple name, or NULL."""
    return F.get(F.filter(_c(annotations), lambda a: F.substring_index(a["name"], ".", -1) == name), F.lit(0))


def has_annotation(annotations, name: str) -> Column:
    return F.coalesce(F.exists(_c(annotations), lambda a: F.substring_index(a["name"], ".", -1) == name),
                      F.lit(False))


def member(annotation_col, name: str) -> Column:
    return F.try_element_at(_c(annotation_col)["values"], F.lit(name))
