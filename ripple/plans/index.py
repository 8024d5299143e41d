"""The indexing plan: code facts of many snapshots -> functions, surfaces and edges."""

from functools import cached_property, reduce

from pyspark.sql import DataFrame, functions as F

from ripple.operators import calls, declarations, entry_rules, repository_rules as repos
from ripple.operators.skew import group_hashed
from ripple.operators.walk import ancestor_closure
from ripple.session import cut
from ripple.sources import wire
from ripple.sources.files import is_solver_only, root_of
from ripple.sources.store import Store, retention_plan


def extracted(path):
    """True for a file that lies under an extraction root."""
    root = root_of(path)
    return root.isNotNull() & ~is_solver_only(root)


def stored_functions(callables: DataFrame, imports: DataFrame) -> DataFrame:
    """Function rows, stored with ``is_extracted``: a filter by a stored flag is not repeated on the call sites that are joined with them."""
    return cut(declarations.build_functions(callables, imports).withColumn("is_extracted", F.coalesce(extracted(F.col("file_path")), F.lit(False))), "functions")


def stamp(raw: DataFrame, stage: int) -> DataFrame:
    """Emission order: rule stage first, then position, so literal edges win over inferred ones."""
    reason = F.col("reason") if "reason" in raw.columns else F.lit(None).cast("string")
    extra = F.col("col") if "col" in raw.columns else F.lit(0)
    via = F.col("via") if "via" in raw.columns else F.lit("")
    return raw.select("gv", "src", "dst", "type", "inferred", "confidence", reason.alias("reason"),
                      F.struct(F.col("call_site.file_path"), F.col("call_site.line").cast("int").alias("line")).alias("call_site"),
                      F.struct(F.lit(stage).alias("stage"), F.col("call_site.file_path"), F.col("call_site.line").cast("int"),
                               extra.cast("int").alias("col"), via.alias("via"), F.col("confidence"),
                               F.coalesce(reason, F.lit("")).alias("reason")).alias("ordinal"))


def collapse(raw: DataFrame) -> DataFrame:
    g = group_hashed(raw, "gv", "src", "dst", "type").agg(
        F.min_by(F.struct("inferred", "confidence", "reason"), "ordinal").alias("f"),
        F.array_sort(F.collect_set("call_site")).alias("call_sites"), F.min("ordinal").alias("ordinal"))
    return g.select("gv", "src", "dst", "type", "f.*", "call_sites", "ordinal")


class Graph:
    """Lazily composed result of the construction rules; what is not asked for is not made (surfaces need no call sites)."""

    def __init__(self, facts):
        """``facts``: callables, types, supertypes, imports, constants, call_sites, type_params DataFrames."""
        self.facts = facts

    @cached_property
    def types(self):
        return cut(self.facts["types"].withColumn("in_extraction_set", extracted(F.col("file_path"))), "types")

    @cached_property
    def all_functions(self):
        return stored_functions(self.facts["callables"], self.facts["imports"])

    @property
    def functions(self):
        return self.all_functions.filter("is_extracted")

    @cached_property
    def ancestors(self):
        return ancestor_closure(self.facts["supertypes"])

    @cached_property
    def classified(self):
        sites = declarations.with_enclosing(self.facts["call_sites"], self.functions)
        return cut(calls.classify_calls(sites, self.all_functions, extracted), "classified")

    @cached_property
    def declared(self):
        return cut(entry_rules.declared(self.all_functions, self.ancestors), "declared").filter(extracted(F.col("file_path")))

    @cached_property
    def routes(self):
        return entry_rules.routes(self.declared, self.types, self.facts["constants"])

    @property
    def jobs(self):
        return entry_rules.scheduled_jobs(self.declared)

    @property
    def listeners(self):
        return entry_rules.message_listeners(self.declared)

    @property
    def markers(self):
        return repos.repository_markers(self.facts["type_params"])

    @property
    def queries(self):
        return repos.query_edges(self.markers, self.ancestors, self.functions)

    @property
    def tables(self):
        return repos.entity_tables(self.markers, self.types)

    @cached_property
    def entry(self):
        """(surfaces, raw edges) of routes, jobs and listeners."""
        return entry_rules.entry_rows(self.routes, self.jobs, self.listeners)

    @cached_property
    def entities(self):
        """(surfaces, raw edges) of entities and their tables."""
        return repos.entity_rows(self.tables)

    @property
    def stages(self):
        return [calls.call_edges(self.classified), declarations.inheritance_edges(self.functions, self.ancestors, self.types),
                self.entry[1], self.queries, self.entities[1]]

    @cached_property
    def literal(self):
        return cut(collapse(reduce(DataFrame.unionByName, [stamp(x, i) for i, x in enumerate(self.stages)])), "literal")

    @property
    def selectors(self):
        return declarations.selector_keys(self.functions, self.types)

    @cached_property
    def dispatch(self):
        return calls.dispatch_edges(self.literal, self.selectors)

    @cached_property
    def edges(self):
        # Dispatch emits calls only: every other edge is as it was, and a call that no interface hides is not taken apart again.
        more = collapse(stamp(self.dispatch, len(self.stages)))
        key = ["gv", "src", "dst", "type"]
        both = group_hashed(self.literal.filter("type = 'calls'").unionByName(more), *key).agg(
            F.min_by(F.struct("inferred", "confidence", "reason"), "ordinal").alias("f"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("call_sites")))).alias("call_sites"))
        return (self.literal.filter("type <> 'calls'").drop("ordinal")
                .unionByName(both.select(*key, "f.*", "call_sites")))

    @cached_property
    def surfaces(self):
        raw = self.entry[0].unionByName(self.entities[0])
        return (raw.groupBy("gv", "key").agg(F.min_by(F.struct("kind", "attrs"), "function_key").alias("f"))
                .select("gv", "key", "f.kind", F.map_from_entries(F.array_sort(F.map_entries("f.attrs"))).alias("attrs")))


def build_graph(facts) -> Graph:
    return Graph(facts)


# --- from documents to the published graph ---------------------------------------------------------------------


def version_stats(responses: DataFrame) -> DataFrame:
    """Counts and rates of each version, over all documents it came in; rates are weighted by their document's edges."""
    s = wire.snapshot_stats(responses)
    rate = lambda c: (F.sum(F.col(c) * F.col("edges")) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("edges"))), F.lit(0))).alias(c)
    counts = [F.sum(c).alias(c) for c in ("functions", "edges", "surfaces", "external_calls", "parse_errors")]
    return s.groupBy("graph_version_id").agg(*counts, rate("unresolved_rate"), rate("non_external_unresolved_rate"))


def usable(responses: DataFrame, versions: DataFrame) -> DataFrame:
    """The documents that can be used and belong to one of the versions, with the repository of their version."""
    named = versions.select("graph_version_id", F.col("repo_id").alias("_repo"))
    # Always true; asking for it makes documents that are read straight from text be refused for a wrong value here too.
    whole = F.coalesce(F.size("sourceRoots"), F.lit(0)) >= -1
    return wire.accepted(responses).filter(whole).join(named, "graph_version_id").drop("repo_id").withColumnRenamed("_repo", "repo_id")


def run_index(target: Store, responses: DataFrame, versions: DataFrame, pins: DataFrame | None = None, waiting: DataFrame | None = None) -> DataFrame:
    """Index many versions in one job: documents -> rows -> write -> publish -> retention. Returns the stats of the published versions.

    ``responses`` comes from ``read_parse_responses`` with a ``graph_version_id`` for each document (null where it cannot be read);
    ``versions``: graph_version_id, repo_id, sha, kind, position. A version without a single usable document fails and its repository keeps its
    graph. The others are published in one commit, which replaces earlier attempts at the same commit of a repository, and then
    retention is applied to the repositories that got a new version; pinned versions and bases that units wait for are spared.
    """
    spark = versions.sparkSession
    good = usable(responses, versions)
    stats = cut(version_stats(good), "stats")
    found = cut(versions.join(stats.select("graph_version_id"), "graph_version_id", "left_semi"), "found")
    lost = cut(versions.join(stats.select("graph_version_id"), "graph_version_id", "left_anti"), "lost")
    target.log_status(versions, "building")
    written = [target.write_snapshot("function_versions", wire.function_versions_of(good)), target.write_snapshot("surfaces", wire.surfaces_of(good)),
               *target.write_edges(wire.edges_of(good))]
    if not lost.isEmpty():
        target.fail_snapshot(lost, "no readable document")
    if not found.isEmpty():
        target.publish(found, written)
        none = spark.createDataFrame([], "graph_version_id string, pins long")
        old = target.versions().filter("status NOT IN ('deleted', 'replaced')").join(versions.select("graph_version_id"), "graph_version_id", "left_anti")
        plan = retention_plan(old, pins if pins is not None else none, target.current(), waiting)
        target.apply_retention(plan.join(found.select("repo_id").distinct(), "repo_id", "left_semi"))
    return stats
