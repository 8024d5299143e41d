"""Declarations: enclosing callables and types, anonymous names, type qualification, function rows, inheritance."""

from pyspark.sql import DataFrame, functions as F

from ripple.functions.keys import format_function_key
from ripple.functions.text import content_fingerprint, erase_type_text, has_annotation
from ripple.operators.skew import group_hashed, rank_within

LINE_BUCKET = 64
# Callables are short; few of them overlap so many lines.
CALL_BUCKET = 16


def _within(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Points (gv, file_path, line, col, ...) joined with the spans of their file that contain them.

    Spans are exploded into line buckets, so the join is an equi join even in very long files.
    """
    s = spans.withColumn("bucket", F.explode(F.sequence(
        F.floor(F.col("start_line") / LINE_BUCKET), F.floor(F.col("end_line") / LINE_BUCKET))))
    p = points.withColumn("bucket", F.floor(F.col("line") / LINE_BUCKET))
    after = (F.col("line") > F.col("start_line")) | ((F.col("line") == F.col("start_line")) & (F.col("col") >= F.col("start_col")))
    before = (F.col("line") < F.col("end_line")) | ((F.col("line") == F.col("end_line")) & (F.col("col") <= F.col("end_col")))
    return p.join(s, ["gv", "file_path", "bucket"]).filter(after & before).drop("bucket")


# Innermost first: fewer lines, then the later start.
INNERMOST = ["span", "minus_start_line", "minus_start_col"]


def _span():
    return F.struct((F.col("end_line") - F.col("start_line")).alias("span"), (-F.col("start_line")).alias("minus_start_line"),
                    (-F.col("start_col")).alias("minus_start_col"))


def _spans(callables: DataFrame) -> DataFrame:
    """One row per (gv, file_path, bucket): its callables, innermost first. Bounded by what overlaps CALL_BUCKET lines."""
    s = callables.select("gv", "file_path", F.explode(F.sequence(
        F.floor(F.col("start_line") / CALL_BUCKET), F.floor(F.col("end_line") / CALL_BUCKET))).alias("bucket"), F.struct(
            _span().alias("at"), "start_line", "start_col", "end_line", "end_col", "function_key").alias("s"))
    return group_hashed(s, "gv", "file_path", "bucket").agg(F.array_sort(F.collect_list("s")).alias("spans"))


def with_enclosing(points: DataFrame, callables: DataFrame) -> DataFrame:
    """The points (gv, file_path, line, col, ...) that lie in a callable, with the innermost one's ``function_key``.

    The points are shuffled once; what they meet is one row per file and line bucket.
    """
    def around(s):
        after = (s["start_line"] < F.col("line")) | ((s["start_line"] == F.col("line")) & (s["start_col"] <= F.col("col")))
        before = (s["end_line"] > F.col("line")) | ((s["end_line"] == F.col("line")) & (s["end_col"] >= F.col("col")))
        return after & before

    keys = ["gv", "file_path", "bucket"]
    placed = points.withColumn("bucket", F.floor(F.col("line") / CALL_BUCKET)).withColumn("_h", F.xxhash64(*keys))
    return (placed.join(_spans(callables), ["_h", *keys])
            .withColumn("function_key", F.explode(F.transform(F.slice(F.filter("spans", around), 1, 1), lambda s: s["function_key"])))
            .drop("_h", "bucket", "spans"))


def enclosing_callable(points: DataFrame, callables: DataFrame) -> DataFrame:
    """(gv, file_path, line, col) -> innermost enclosing callable's ``function_key`` (inner join)."""
    return with_enclosing(points.select("gv", "file_path", "line", "col").distinct(), callables).select(
        "gv", "file_path", "line", "col", "function_key")


def number_anonymous(creations: DataFrame) -> DataFrame:
    """Names anonymous bodies Outer$1, Outer$2, ... in source order within their top-level type."""
    bodies = creations.filter("has_anonymous_body").select("gv", "file_path", "top_level_fqcn", "line", "col").distinct()
    numbered = rank_within(bodies, ["gv", "file_path", "top_level_fqcn"], ["line", "col"])
    return numbered.withColumn("fqcn", F.concat("top_level_fqcn", F.lit("$"), F.col("position").cast("string")))


def declaring_type(points: DataFrame, types: DataFrame) -> DataFrame:
    """(gv, file_path, line, col) -> fqcn of the nearest type; a local type (NULL fqcn) is Enclosing$Local.

    ``types``: gv, file_path, start/end positions, fqcn (NULL for local types), simple_name.
    """
    spans = types.select("gv", "file_path", "start_line", "start_col", "end_line", "end_col", "fqcn", "simple_name")
    hit = _within(points.select("gv", "file_path", "line", "col").distinct(), spans)
    named = F.min_by(F.when(F.col("fqcn").isNotNull(), F.struct(_span().alias("at"), "fqcn")),
                     F.when(F.col("fqcn").isNotNull(), _span()))
    # The chain is bounded by nesting depth.
    chain = F.array_sort(F.collect_list(F.struct(_span().alias("at"), "fqcn", "simple_name")))
    g = hit.groupBy("gv", "file_path", "line", "col").agg(named.alias("named"), chain.alias("chain"))
    local = F.filter("chain", lambda t: F.col("named").isNull() | (t["at"] < F.col("named.at")))
    names = F.reverse(F.transform(local, lambda t: t["simple_name"]))
    return g.select("gv", "file_path", "line", "col", F.array_join(F.array_compact(F.concat(
        F.array("named.fqcn"), names)), "$").alias("fqcn"))


def qualify_types(params: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds ``type_name`` and ``is_resolved`` to (gv, file_path, ..., type_text, resolved_name, is_varargs).

    A resolved name is kept; otherwise a simple name is qualified by the first explicit import that ends
    with it; otherwise it stays as written and counts as unresolved.
    """
    explicit = imports.filter("NOT is_asterisk AND NOT is_static").groupBy(
        "gv", "file_path", F.substring_index("imported_name", ".", -1).alias("simple")).agg(
        F.min_by("imported_name", "ordinal").alias("imported_name"))
    erased = erase_type_text("type_text")
    base = F.regexp_replace(erased, r"(\[\])+\z", "")
    suffix = F.regexp_extract(erased, r"((?:\[\])*)\z", 1)
    rows = params.withColumn("_base", base).withColumn("_suffix", suffix).withColumn(
        "simple", F.when(F.col("resolved_name").isNull() & ~F.contains("_base", F.lit(".")), F.col("_base")))
    joined = rows.join(explicit, ["gv", "file_path", "simple"], "left")
    name = F.coalesce("resolved_name", F.concat(F.coalesce("imported_name", "_base"), F.col("_suffix")))
    name = F.when(F.col("is_varargs") & ~F.endswith(name, F.lit("[]")), F.concat(name, F.lit("[]"))).otherwise(name)
    return joined.withColumn("type_name", name).withColumn("is_resolved", F.col("resolved_name").isNotNull()).drop(
        "_base", "_suffix", "simple", "imported_name")


def build_functions(callables: DataFrame, imports: DataFrame) -> DataFrame:
    """Function rows from callable facts; positions are kept so calls can be bound to them."""
    position = ["gv", "file_path", "start_line", "start_col"]
    params = callables.select(*position, F.posexplode("params").alias("pos", "p")).select(
        *position, "pos", F.col("p.text").alias("type_text"), F.col("p.resolved").alias("resolved_name"),
        F.col("p.is_varargs").alias("is_varargs"))
    # Parameters of one callable: a bounded list.
    named = qualify_types(params, imports).groupBy(*position).agg(
        F.array_sort(F.collect_list(F.struct("pos", "type_name", "is_resolved"))).alias("ps"))
    names = F.transform("ps", lambda x: x["type_name"])
    joined = callables.join(named, position, "left").withColumn("param_types", F.coalesce(
        names, F.array().cast("array<string>"))).withColumn("param_resolved", F.coalesce(
            F.transform("ps", lambda x: x["is_resolved"]), F.array().cast("array<boolean>")))
    method = F.when(F.col("is_constructor"), "<init>").otherwise(F.col("method_name"))
    return joined.select(
        *position, "end_line", "end_col", "fqcn", F.substring_index("fqcn", ".", -1).alias("class_name"),
        method.alias("method_name"), format_function_key("fqcn", method, "param_types").alias("function_key"),
        "param_types", "param_resolved", "param_names",
        F.when(F.col("is_constructor"), "void").otherwise(F.col("return_type")).alias("return_type"),
        content_fingerprint("body_text").alias("body_hash"), "modifiers", "annotations",
        (~F.col("is_constructor") & (F.array_contains("modifiers", "abstract") | (F.col("is_interface") & ~F.col("has_body"))))
        .alias("is_abstract"), F.col("is_interface").alias("is_interface_method"), "is_constructor",
        F.size(F.filter("param_resolved", lambda r: ~r)).alias("unresolved_params"))


def inheritance_edges(functions: DataFrame, ancestors: DataFrame, types: DataFrame) -> DataFrame:
    """Raw implements / overrides edges to same-name, same-arity, same-parameter methods of in-scope ancestors.

    Parameters are compared up to the first ancestor parameter that did not resolve; from there on the
    pair counts as a match. ``types``: gv, fqcn, is_interface, in_extraction_set.
    """
    own = functions.filter("NOT is_constructor").select(
        "gv", "fqcn", F.col("function_key").alias("src"), "method_name", F.size("param_types").alias("arity"),
        "param_types", "file_path", "start_line")
    above = functions.filter("NOT is_constructor").select(
        "gv", F.col("fqcn").alias("ancestor_fqcn"), F.col("function_key").alias("dst"), "method_name",
        F.size("param_types").alias("arity"), F.col("param_types").alias("up_types"), F.col("param_resolved").alias("up_resolved"))
    scope = types.filter("in_extraction_set").select("gv", F.col("fqcn").alias("ancestor_fqcn"), "is_interface")
    known = F.array_position("up_resolved", False).cast("int")
    n = F.when(known == 0, F.col("arity")).otherwise(known - 1)
    match = F.slice("param_types", F.lit(1), n) == F.slice("up_types", F.lit(1), n)
    pairs = (own.join(ancestors, ["gv", "fqcn"]).join(scope, ["gv", "ancestor_fqcn"])
             .join(above, ["gv", "ancestor_fqcn", "method_name", "arity"]).filter(match))
    return pairs.select("gv", "src", "dst", F.when(F.col("is_interface"), "implements").otherwise("overrides").alias("type"),
                        F.lit(False).alias("inferred"), F.lit("exact").alias("confidence"),
                        F.struct("file_path", F.col("start_line").alias("line")).alias("call_site"))


def selector_keys(functions: DataFrame, types: DataFrame) -> DataFrame:
    """(gv, function_key, is_primary, is_qualified) for methods whose class carries either selector."""
    marked = types.select("gv", "fqcn", has_annotation("annotations", "Primary").alias("is_primary"),
                          has_annotation("annotations", "Qualifier").alias("is_qualified")).filter(
        "is_primary OR is_qualified")
    return functions.join(marked, ["gv", "fqcn"]).select("gv", "function_key", "is_primary", "is_qualified")
