"""Read queries over stored analyses; each answers for all requested keys at once."""

from pyspark.sql import DataFrame, functions as F


def analysis_detail(analyses: DataFrame, ids: DataFrame, explanations: DataFrame) -> DataFrame:
    """One row per (analysis, changed function) in stored order with its explanation (NULL when missing).

    An analysis without changed functions keeps one row with position NULL.
    """
    a = analyses.join(ids.select("analysis_id").distinct(), "analysis_id", "left_semi")
    rows = a.select(*[c for c in a.columns if c != "changed_functions"], F.posexplode_outer("changed_functions").alias("position", "f"))
    known = explanations.select(F.col("id").alias("explanation_id"), "sections", "degraded")
    return (rows.select("*", "f.function_key", "f.change_kind", "f.context_hash", "f.explanation_id").drop("f")
            .join(known, "explanation_id", "left"))


def latest_for_pull(analyses: DataFrame) -> DataFrame:
    """Newest analysis per (repo, pull request) that is not superseded."""
    live = analyses.filter("pr_number IS NOT NULL AND status <> 'superseded'")
    cols = [c for c in analyses.columns if c not in ("repo_id", "pr_number")]
    return live.groupBy("repo_id", "pr_number").agg(
        F.max_by(F.struct(*cols), F.struct("created_at", "analysis_id")).alias("l")).select("repo_id", "pr_number", "l.*")


def function_by_key(functions: DataFrame, keys: DataFrame) -> DataFrame:
    return functions.join(keys.select("graph_version_id", "function_key").distinct(), ["graph_version_id", "function_key"])


def surface_by_key(surfaces: DataFrame, keys: DataFrame) -> DataFrame:
    return surfaces.join(keys.select("graph_version_id", "key").distinct(), ["graph_version_id", "key"])
