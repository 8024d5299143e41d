"""Edge and surface collapse: one row per identity, first emission wins."""

from pyspark.sql import DataFrame, functions as F

from ripple.operators.skew import group_hashed
from ripple.session import cut

EDGE = ["repo_id", "graph_version_id", "src", "dst", "type"]
SURFACE = ["repo_id", "graph_version_id", "key"]


def _apart(raw: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose identity occurs once, and all others (among them rows that only share a hash).

    Only hashes are shuffled to find that out. ``raw`` is read three times, so it should come from stored tables. It may bring
    ``identity``, a long that is equal wherever the keys are and needs none of their texts; otherwise the texts are hashed.
    """
    h = (F.col("identity") if "identity" in raw.columns else F.xxhash64(*keys)).alias("_h")
    often = cut(raw.select(h).groupBy("_h").count().filter("count > 1").select("_h"), "repeats")
    tagged = raw.select("*", h)
    return tagged.join(often, "_h", "left_anti").drop("_h"), tagged.join(often, "_h", "left_semi").drop("_h")


def collapse_edges(raw: DataFrame, few_repeats: bool = False) -> DataFrame:
    """``raw`` carries one ``call_site`` struct (or NULL) and a totally ordered ``ordinal`` per emission.

    With ``few_repeats`` edges that were emitted once are neither shuffled nor sorted; the result is the same whatever repeats.
    """
    if few_repeats:
        once, raw = _apart(raw, EDGE)
        single = once.select(*EDGE, "inferred", "confidence", F.array_compact(F.array("call_site")).alias("call_sites"), "reason")
        return single.unionByName(collapse_edges(raw))
    attrs = F.struct("inferred", "confidence", "reason")
    grouped = group_hashed(raw, *EDGE).agg(
        F.min_by(attrs, "ordinal").alias("first"),
        F.array_sort(F.collect_set("call_site")).alias("call_sites"))
    return grouped.select("repo_id", "graph_version_id", "src", "dst", "type", "first.inferred",
                          "first.confidence", "call_sites", "first.reason")


def collapse_surfaces(raw: DataFrame, few_repeats: bool = False) -> DataFrame:
    """``few_repeats`` as in ``collapse_edges``."""
    if few_repeats:
        once, raw = _apart(raw, SURFACE)
        single = once.select(*SURFACE, "kind", F.map_from_entries(F.array_sort(F.map_entries("attrs"))).alias("attrs"))
        return single.unionByName(collapse_surfaces(raw))
    grouped = group_hashed(raw, *SURFACE).agg(
        F.min_by(F.struct("kind", "attrs"), "ordinal").alias("first"))
    return grouped.select("repo_id", "graph_version_id", "key", "first.kind",
                          F.map_from_entries(F.array_sort(F.map_entries("first.attrs"))).alias("attrs"))
