"""The analysis plan: two snapshots per analysis -> affected callers, surfaces, dependencies, context rows."""

from pyspark.sql import DataFrame, functions as F

from ripple.functions.keys import display_name
from ripple.functions.canonical import canonical_json
from ripple.operators import diff, walk
from ripple.schema import CONTEXT_SCHEMA_VERSION, DEPTH_CAP
from ripple.session import cut


def root_id():
    return F.concat_ws("|", "analysis_id", "function_key")


def detect(analyses: DataFrame, base_fv: DataFrame, head_fv: DataFrame, touched: DataFrame) -> DataFrame:
    """Changed functions of every analysis with their signature diff and version ids.

    ``analyses``: analysis_id, repo_id, base_gv, head_gv, ... . A snapshot serves any number of analyses. The
    head side is the overlay: the head facts of the touched files, single use, never published.
    """
    return diff.signature_diff(_changed(analyses, base_fv, head_fv, touched)).withColumn("root_id", root_id())


def _changed(analyses, base_fv, head_fv, touched, facts=diff.FACTS):
    # The touched files meet their analyses first, so only touched rows of a version are ever multiplied.
    side = lambda fv, gv: fv.join(
        analyses.select("analysis_id", F.col(gv).alias("graph_version_id")).join(touched, "analysis_id"), ["graph_version_id", "file_path"])
    changes = diff.changed_functions(side(base_fv, "base_gv"), side(head_fv, "head_gv"), None, facts)
    return changes.join(analyses.select("analysis_id", "base_gv", "head_gv"), "analysis_id")


def start_nodes(analyses: DataFrame, base_fv: DataFrame, head_fv: DataFrame, touched: DataFrame) -> DataFrame:
    """root_id, gv, node of the rows of ``detect``, for walks that ask for nothing else: no facts or signatures are moved."""
    changes = _changed(analyses, base_fv, head_fv, touched, ["return_type", "body_hash"])
    return changes.select(root_id().alias("root_id"), F.col("base_gv").alias("gv"), F.col("function_key").alias("node"))


def roots_of(changes: DataFrame) -> DataFrame:
    return changes.select("root_id", F.col("base_gv").alias("gv"), "head_gv", F.col("function_key").alias("node"),
                          "signature_compatible")


def touched_parse_errors(errors: DataFrame, analyses: DataFrame, touched: DataFrame) -> DataFrame:
    """(analysis_id, parse_errors): what the extractor could not read in the touched files of each analysis's head version.

    ``errors``: graph_version_id, file_path, message (rows without a file stand for a version without errors); an analysis without any has no row.
    """
    per_file = errors.filter("file_path IS NOT NULL").groupBy("graph_version_id", "file_path").agg(F.count("*").alias("n"))
    head = touched.join(analyses.select("analysis_id", F.col("head_gv").alias("graph_version_id")), "analysis_id")
    return head.join(per_file, ["graph_version_id", "file_path"]).groupBy("analysis_id").agg(F.sum("n").alias("parse_errors"))


class Analysis:
    """Holds the flat parts of a context; every part is keyed by root_id. The base graph is the walked one.

    ``changes`` and ``base_edges`` are read several times, so they should be stored tables.
    """

    def __init__(self, analyses, changes, base_edges, head_edges, surfaces, source_diffs=None, versions=None,
                 parse_errors=None, depth_cap=DEPTH_CAP, caller_cap=None):
        self.analyses, self.depth_cap = analyses, depth_cap
        self.changes = changes
        self.roots = roots_of(self.changes)
        self.source_diffs, self.versions, self.parse_errors = source_diffs, versions, parse_errors
        self.callers, self.totals = walk.direct_callers(self.roots, base_edges, caller_cap)
        back = walk.prepare_hops(base_edges, "reverse", bucketed=True)
        visited = walk.level_walk(self.roots, back, depth_cap=depth_cap)
        self.meta = walk.walk_meta(visited, back, depth_cap)
        self.entry = cut(walk.entrypoints(visited, base_edges, surfaces), "entry")
        ahead = walk.level_walk(self.roots, base_edges, "forward", depth_cap)
        self.data = cut(walk.data_surfaces(ahead, base_edges), "data")
        self.callees = cut(walk.now_depends_on(self.roots, head_edges, base_edges), "callees")
        self.ambiguous = walk.ambiguous_on_path(self.totals, self.data, self.roots)

    def header(self) -> DataFrame:
        """One flat row per changed function: everything in a context that is not a list."""
        facts = F.coalesce("head.file_path", "base.file_path", F.lit(""))
        rows = self.changes.join(self.analyses.select(
            "analysis_id", "repo_id", "owner", "name", F.col("pr_number").cast("long").alias("pr_number")), "analysis_id")
        by_key = ["analysis_id", "function_key"]
        if self.source_diffs is not None:
            rows = rows.join(self.source_diffs.select(*by_key, "source_diff"), by_key, "left")
        else:
            rows = rows.withColumn("source_diff", F.lit(None).cast("string"))
        if self.versions is not None:
            rates = self.versions.select(F.col("id").alias("base_gv"), F.col("unresolved_rate"))
            rows = rows.join(rates, "base_gv", "left")
        else:
            rows = rows.withColumn("unresolved_rate", F.lit(None).cast("double"))
        if self.parse_errors is not None:
            rows = rows.join(self.parse_errors.select("analysis_id", "parse_errors"), "analysis_id", "left")
        else:
            rows = rows.withColumn("parse_errors", F.lit(None).cast("long"))
        for part in (self.totals, self.meta, self.ambiguous):
            rows = rows.join(part.drop("gv"), "root_id", "left")
        return rows.select(
            "root_id", "analysis_id", "repo_id", "owner", "name", "pr_number", "function_key",
            display_name("function_key").alias("display_name"), "change_kind", facts.alias("file_path"),
            "base_signature", "head_signature", "return_type_changed", "params_changed", "throws_added",
            "visibility_changed", F.coalesce("source_diff", F.lit("")).alias("source_diff"),
            F.coalesce("caller_total", F.lit(0).cast("long")).alias("caller_total"),
            F.coalesce("truncated", F.lit(False)).alias("truncated"), "max_depth", "depth_cap_hit", "nodes_visited",
            F.coalesce("unresolved_rate", F.lit(0.0)).alias("unresolved_rate"), "ambiguous_edges_on_path",
            F.coalesce("parse_errors", F.lit(0).cast("long")).alias("parse_errors"))


def list_parts(a: Analysis):
    """The four lists of a context as (name, frame, order columns, element columns)."""
    return [
        ("callers", a.callers, ["position"],
         ["position", "key", "display_name", "hops", "file_path", "line", "usage", "signature_compatible", "confidence",
          "inferred"]),
        ("entrypoints", a.entry, ["key"], ["key", "kind", "min_hops", "via_inferred_edge"]),
        ("data", a.data, ["key"], ["key", "kind", "access", "via_inferred_edge", "confidence"]),
        ("callees", a.callees, ["key", "type"], ["key", "type", "display_name", "is_new", "confidence", "inferred"]),
    ]


def build_context(a: Analysis) -> DataFrame:
    """One nested row per changed function. The row of a function is as large as its own report."""
    rows = a.header()
    for name, frame, _, cols in list_parts(a):
        grouped = frame.groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        rows = rows.join(grouped, "root_id", "left")
        rows = rows.withColumn(name, F.coalesce(name, F.filter(F.array(F.struct(*[
            F.lit(None).cast(frame.schema[c].dataType).alias(c) for c in cols])), lambda _: F.lit(False))))
    head = F.struct(
        F.lit(CONTEXT_SCHEMA_VERSION).alias("schema_version"), F.struct("owner", "name", "pr_number").alias("repo"),
        F.struct(F.col("function_key").alias("key"), "display_name", "change_kind", "file_path", F.struct(
            F.col("base_signature").alias("base"), F.col("head_signature").alias("head"), "return_type_changed",
            "params_changed", "throws_added", "visibility_changed").alias("signature_diff"),
            "source_diff").alias("changed_method"),
        F.struct(
            F.col("callers").alias("direct_callers"), F.col("caller_total").alias("direct_caller_total"),
            F.col("truncated").alias("direct_callers_truncated"),
            F.struct("entrypoints", "data").alias("reachable_surfaces"),
            F.struct("max_depth", "depth_cap_hit", "nodes_visited").alias("traversal")).alias("affected_by"),
        F.struct("callees").alias("now_depends_on"),
        F.struct(F.array().cast("array<string>").alias("commits"),
                 F.lit(False).alias("truncated_at_rename")).alias("change_history"),
        F.struct("unresolved_rate", "ambiguous_edges_on_path",
                 F.col("parse_errors").alias("parse_errors_in_touched_files")).alias("quality"))
    out = rows.select("root_id", "analysis_id", "function_key", "change_kind", head.alias("context"))
    canon = canonical_json("context", out.schema["context"].dataType)
    return out.withColumn("context_hash", F.sha2(canon, 256))


def fingerprint(json):
    """Two 60-bit halves of a SHA-256, as decimals: their sums are an order-free digest of a row set."""
    h = F.sha2(json, 256)
    half = lambda at: F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")
    return half(1), half(16)


def context_digest(a: Analysis) -> DataFrame:
    """(root_id, context_hash) without ever gathering the lists of a function in one place.

    Each list row is hashed on its own and the hashes are summed, so the aggregation combines map-side.
    """
    head = a.header()
    parts = [head.select("root_id", F.lit("header").alias("part"),
                         F.to_json(F.struct(*sorted(c for c in head.columns if c != "root_id")),
                                   {"ignoreNullFields": "false"}).alias("json"))]
    for name, frame, _, cols in list_parts(a):
        parts.append(frame.select("root_id", F.lit(name).alias("part"),
                                  F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}).alias("json")))
    x, y = fingerprint(F.concat_ws(":", "part", "json"))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sums = (rows.select("root_id", x.alias("x"), y.alias("y")).groupBy("root_id")
            .agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")))
    return sums.select("root_id", F.sha2(F.concat_ws(":", "n", "x", "y"), 256).alias("context_hash"))


def changed_function_rows(contexts: DataFrame, explanations: DataFrame) -> DataFrame:
    """Per analysis: key, change kind, context hash and the explanation it is linked to (NULL when none)."""
    known = explanations.select("context_hash", F.col("id").alias("explanation_id"))
    return contexts.select("analysis_id", "function_key", "change_kind", "context_hash").join(
        known, "context_hash", "left")
