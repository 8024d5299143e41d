"""Graph health: diagnostics per version, profile, and data-quality reports."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def graph_diagnostics(edges: DataFrame, classified: DataFrame, functions: DataFrame) -> DataFrame:
    """Per version: unresolved rates, external calls, unresolved parameters, index misses. Empty graph -> 0.0.

    Each input is reduced to one row per version before anything is joined.
    """
    e = edges.groupBy("gv").agg(
        F.count("*").alias("total_edges"), F.count_if(F.col("type") == "unresolved").alias("unresolved_edges"),
        F.count_if((F.col("type") == "unresolved") & (F.col("reason") != "external_type")).alias("non_external_unresolved"))
    c = classified.groupBy("gv").agg(
        F.count_if(F.col("outcome") == "external").alias("external_calls"), F.count_if("index_miss").alias("index_misses"),
        F.count_if(F.col("reason") == "ambiguous_overload").alias("ambiguous_overloads"))
    f = functions.groupBy("gv").agg(F.sum("unresolved_params").alias("unresolved_params"),
                                    F.sum(F.size("param_types")).alias("params"))
    t = (classified.filter("reason = 'ambiguous_overload'").select("gv", "dst").distinct()
         .groupBy("gv").agg(F.count("*").alias("ambiguous_targets")))
    rows = reduce(lambda a, b: a.join(b, "gv", "full_outer"), [e, c, f, t])
    n = lambda x: F.coalesce(x, F.lit(0))
    rate = lambda a, b: F.coalesce(F.try_divide(n(a), n(b)), F.lit(0.0)).cast("double")
    counts = ["total_edges", "unresolved_edges", "external_calls", "index_misses", "ambiguous_overloads",
              "unresolved_params", "ambiguous_targets"]
    return rows.select("gv", *[n(c).cast("long").alias(c) for c in counts],
                       rate("unresolved_edges", "total_edges").alias("unresolved_rate"),
                       rate("non_external_unresolved", "total_edges").alias("non_external_unresolved_rate"),
                       rate("unresolved_params", "params").alias("unresolved_param_rate"))


def ambiguous_overload_targets(classified: DataFrame) -> DataFrame:
    return classified.filter("reason = 'ambiguous_overload'").select("gv", "dst").distinct()


def graph_profile(edges: DataFrame, surfaces: DataFrame, sample: int = 6) -> DataFrame:
    """(section, name, n): edge types, surface kinds, unresolved reasons, and the first routes by key."""
    part = lambda df, section, col: df.groupBy(F.col(col).alias("name")).agg(F.count("*").alias("n")).select(
        F.lit(section).alias("section"), "name", "n")
    routes = (surfaces.filter("kind = 'http_route'").select("key").distinct().orderBy("key").limit(sample)
              .select(F.lit("sample_route").alias("section"), F.col("key").alias("name"), F.lit(1).cast("long").alias("n")))
    return reduce(DataFrame.unionByName, [
        part(edges, "edge_type", "type"), part(surfaces, "surface_kind", "kind"),
        part(edges.filter("type = 'unresolved'"), "unresolved_reason", "reason"), routes])


# Unique keys of the stored tables.
UNIQUE_KEYS = {
    "functions": ["repo_id", "key"], "function_versions": ["graph_version_id", "function_key"],
    "surfaces": ["graph_version_id", "key"], "edges": ["graph_version_id", "src", "dst", "type"],
    "graph_versions": ["repo_id", "sha", "kind"], "repos": ["provider", "github_repo_id"],
    "installations": ["github_installation_id"], "analyses": ["repo_id", "base_sha", "head_sha"],
    "explanations": ["context_hash", "prompt_version", "model"], "deliveries": ["id"]}


def unique_key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, key, n): every violated unique key."""
    def check(name, df):
        keys = UNIQUE_KEYS[name]
        return (df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
                .select(F.lit(name).alias("table_name"), F.concat_ws("|", *keys).alias("key"), "n"))
    return reduce(DataFrame.unionByName, [check(n, t) for n, t in tables.items()])


def dangling_edges(edges: DataFrame, functions: DataFrame, surfaces: DataFrame) -> DataFrame:
    """(graph_version_id, side, key, n): endpoints that are no node of their version; unresolved targets are exempt."""
    nodes = functions.select("graph_version_id", F.col("function_key").alias("key")).unionByName(
        surfaces.select("graph_version_id", "key"))
    ends = edges.select("graph_version_id", F.explode(F.array(
        F.struct(F.lit("src").alias("side"), F.col("src").alias("key")),
        F.struct(F.lit("dst").alias("side"), F.col("dst").alias("key")))).alias("e")).select("graph_version_id", "e.*")
    # Count per endpoint first: a hub endpoint becomes one row before the join.
    counted = ends.filter(~F.startswith("key", F.lit("unresolved:"))).groupBy("graph_version_id", "side", "key").agg(
        F.count("*").alias("n"))
    return counted.join(nodes, ["graph_version_id", "key"], "left_anti")
