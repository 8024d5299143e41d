"""The frontier engine: every root of every graph version walks in the same job.

``roots``: root_id, gv, node (one root_id may have several start nodes).
``edges``: graph_version_id, src, dst, type, inferred, confidence, ... (see ``ripple.schema.EDGES``).
Each level is one join of the frontier with the hop table, one map-side-combined aggregation and one
anti join with what was already visited; each level is written to the shared scratch folder.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, Window as W

from ripple.functions.keys import display_name
from ripple.functions.text import access_of, usage_of
from ripple.functions.trust import conf_name, conf_rank
from ripple.operators.skew import group_hashed, rank_within
from ripple.schema import DEPTH_CAP, ENTRY_TYPES, FORWARD_TYPES, REVERSE_TYPES
from ripple.session import Levels, cut

# A node with more edges than this on the walked side is a hub: its edges are spread over salt buckets.
HUB_DEGREE = 200_000
# A level of an unbounded walk with no more rows than this is sent to every task.
FEW = 50_000


def outgoing(edges: DataFrame, keys: DataFrame, types=None) -> DataFrame:
    """Edges leaving the given (graph_version_id, node) keys."""
    return _adjacent(edges, keys, "src", types)


def incoming(edges: DataFrame, keys: DataFrame, types=None) -> DataFrame:
    return _adjacent(edges, keys, "dst", types)


def _adjacent(edges, keys, side, types):
    if types is not None:
        edges = edges.filter(F.col("type").isin(list(types)))
    wanted = keys.select("graph_version_id", F.col("node").alias(side)).distinct()
    return edges.join(wanted, ["graph_version_id", side], "left_semi")


@dataclass
class Hops:
    """A prepared hop table: gv, from_node, to_node, rank, inferred and its hubs (None if there are none, else with salt)."""
    table: DataFrame
    hubs: DataFrame | None


def prepare_hops(edges: DataFrame, direction: str, types=None, hub_degree: int = HUB_DEGREE,
                 bucketed: bool = False) -> Hops:
    near, far = ("dst", "src") if direction == "reverse" else ("src", "dst")
    types = types if types is not None else (REVERSE_TYPES if direction == "reverse" else FORWARD_TYPES)
    narrow = edges.filter(F.col("type").isin(list(types)) & (F.col("src") != F.col("dst"))).select(
        F.col("graph_version_id").alias("gv"), F.col(near).alias("from_node"), F.col(far).alias("to_node"),
        conf_rank("confidence").alias("rank"), "inferred")
    return salt_hops(narrow, hub_degree, bucketed)


def salt_hops(narrow: DataFrame, hub_degree: int = HUB_DEGREE, bucketed: bool = False) -> Hops:
    """Spread the edges of hub nodes over as many buckets as their degree needs, then copy the table.

    With ``bucketed``, which a fleet's edges should have, the copy is laid out once and every level reads it without another
    shuffle of the edges. ``narrow`` is read twice, so it should come from a stored table.
    """
    hubs = (narrow.groupBy("gv", "from_node").agg(F.count("*").alias("degree")).filter(F.col("degree") > hub_degree)
            .select("gv", "from_node", F.ceil(F.col("degree") / hub_degree).cast("int").alias("salts")))
    # A salt that is the same for all would not count as a join key, and the layout would be of no use.
    if hubs.isEmpty():
        return Hops(cut(narrow, "hops", ["gv", "from_node"] if bucketed else None), None)
    hubs = cut(hubs, "hubs")
    spread = (narrow.join(hubs, ["gv", "from_node"], "left")
              .withColumn("salt", F.coalesce(F.pmod(F.hash("to_node"), F.col("salts")), F.lit(0))).drop("salts"))
    return Hops(cut(spread, "hops", ["gv", "from_node", "salt"] if bucketed else None), hubs)


def expand(frontier: DataFrame, hops: Hops) -> DataFrame:
    """Join frontier rows (gv, node, ...) with their hops; adds to_node, hop_rank, hop_inferred."""
    keys, probe = ["gv", "node"], frontier
    if hops.hubs is not None:
        keys = [*keys, "salt"]
        sized = frontier.join(hops.hubs.withColumnRenamed("from_node", "node"), ["gv", "node"], "left")
        probe = sized.withColumn("salt", F.explode(F.sequence(
            F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))).drop("salts")
    table = hops.table.select(*[F.col("from_node").alias(k) if k == "node" else k for k in keys], "to_node",
                              *[F.col(c).alias("hop_" + c) for c in ("rank", "inferred") if c in hops.table.columns])
    return probe.join(table, keys).drop("salt")


def level_walk(roots: DataFrame, edges, direction: str = "reverse", depth_cap: int = DEPTH_CAP,
               types=None) -> DataFrame:
    """visited(root_id, gv, node, depth, rank, inferred): each node at its first level, best path of that level.

    Among the parents of a level the path is the minimum of (rank, inferred), which is all that survives of
    the documented total order. ``edges`` may be a prepared ``Hops``.
    """
    hops = edges if isinstance(edges, Hops) else prepare_hops(edges, direction, types, bucketed=True)
    state = ["root_id", "gv", "node"]
    weight = (F.greatest("rank", "hop_rank") * 2
              + F.when(F.col("inferred") | F.col("hop_inferred"), 1).otherwise(0))
    seen = Levels(roots.sparkSession, "walk", "depth")
    level = seen.append(roots.select(*state).distinct().select(*state, F.lit(0).alias("rank"), F.lit(False).alias("inferred")))
    for _ in range(depth_cap):
        best = (expand(level, hops).select("root_id", "gv", F.col("to_node").alias("node"), weight.alias("w"))
                .groupBy(*state).agg(F.min("w").alias("w")))
        fresh = best.join(seen.all().select(*state), state, "left_anti")
        level = seen.append(fresh.select(*state, F.shiftright("w", 1).alias("rank"), (F.col("w") % 2 == 1).alias("inferred")))
        if level.isEmpty():
            break
    return seen.all().select(*state, "depth", "rank", "inferred")


def walk_meta(visited: DataFrame, hops: Hops, depth_cap: int = DEPTH_CAP) -> DataFrame:
    """root_id, gv, max_depth, nodes_visited, depth_cap_hit."""
    counts = visited.groupBy("root_id", "gv").agg(F.count("*").alias("nodes_visited"))
    edge_of = visited.filter(F.col("depth") == depth_cap).select("root_id", "gv", "node")
    beyond = expand(edge_of, hops).select("root_id", "gv", F.col("to_node").alias("node"))
    hit = (beyond.join(visited.select("root_id", "gv", "node"), ["root_id", "gv", "node"], "left_anti")
           .select("root_id", "gv").distinct().withColumn("hit", F.lit(True)))
    return counts.join(hit, ["root_id", "gv"], "left").select(
        "root_id", "gv", F.lit(depth_cap).alias("max_depth"), "nodes_visited",
        F.coalesce("hit", F.lit(False)).alias("depth_cap_hit"))


def entrypoints(visited: DataFrame, edges: DataFrame, surfaces: DataFrame) -> DataFrame:
    """root_id, gv, key, kind, min_hops, via_inferred_edge; an edge without a surface row is skipped."""
    hooks = edges.filter(F.col("type").isin(ENTRY_TYPES)).select(
        F.col("graph_version_id").alias("gv"), F.col("dst").alias("node"), F.col("src").alias("key"),
        F.col("inferred").alias("hook_inferred"))
    packed = ((F.col("depth") + 1) * 2 + F.when(F.col("inferred") | F.col("hook_inferred"), 1).otherwise(0))
    best = (visited.join(hooks, ["gv", "node"]).select("root_id", "gv", "key", packed.alias("p"))
            .groupBy("root_id", "gv", "key").agg(F.min("p").alias("p")))
    known = surfaces.select(F.col("graph_version_id").alias("gv"), "key", "kind")
    return best.join(known, ["gv", "key"]).select(
        "root_id", "gv", "key", "kind", F.floor(F.col("p") / 2).cast("int").alias("min_hops"),
        (F.col("p") % 2 == 1).alias("via_inferred_edge"))


def data_surfaces(visited: DataFrame, edges: DataFrame) -> DataFrame:
    """root_id, gv, key, kind, access, via_inferred_edge, confidence over the forward walk."""
    queries = edges.filter("type = 'queries'").select(
        F.col("graph_version_id").alias("gv"), F.col("src").alias("node"), F.col("dst").alias("entity"),
        F.col("inferred").alias("q_inferred"), conf_rank("confidence").alias("q_rank"))
    tables = edges.filter("type = 'maps_to'").groupBy(
        F.col("graph_version_id").alias("gv"), F.col("src").alias("entity")).agg(
        F.min_by(F.struct("dst", "inferred", conf_rank("confidence").alias("rank")), "dst").alias("t"))
    has = F.col("t").isNotNull()
    flag = lambda b: F.when(b, 1).otherwise(0)
    # Reduce to one row per (root, entity) before the entity meets its table.
    by_entity = (visited.join(queries, ["gv", "node"])
                 .groupBy("root_id", "gv", "entity").agg(
                     F.max(flag(access_of("node") == "write")).alias("writes"),
                     F.max(flag(access_of("node") == "read")).alias("reads"),
                     F.max(flag(F.col("inferred") | F.col("q_inferred"))).alias("via"),
                     F.max(F.greatest("rank", "q_rank")).alias("rank")))
    terminal = by_entity.join(tables, ["gv", "entity"], "left").select(
        "root_id", "gv", F.when(has, F.col("t.dst")).otherwise(F.col("entity")).alias("key"),
        F.when(has, "table").otherwise("entity").alias("kind"), "writes", "reads",
        F.greatest("via", flag(has & F.col("t.inferred"))).alias("via"),
        F.greatest("rank", F.coalesce("t.rank", F.lit(0))).alias("rank"))
    merged = terminal.groupBy("root_id", "gv", "key", "kind").agg(
        F.max("writes").alias("writes"), F.max("reads").alias("reads"), F.max("via").alias("via"),
        F.max("rank").alias("rank"))
    access = (F.when((F.col("writes") == 1) & (F.col("reads") == 1), "read_write")
              .when(F.col("writes") == 1, "write").otherwise("read"))
    return merged.select("root_id", "gv", "key", "kind", access.alias("access"),
                         (F.col("via") == 1).alias("via_inferred_edge"), conf_name("rank").alias("confidence"))


def all_callers(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Every caller within two reverse hops, one row per (root, caller) on its best path.

    Best path = minimum of (hops, rank, inferred, edge type, via node); the call site is that of the edge
    nearest the caller.
    """
    site = F.get("call_sites", F.lit(0))
    back = edges.filter(F.col("type").isin(REVERSE_TYPES)).select(
        F.col("graph_version_id").alias("gv"), F.col("dst").alias("via"), F.col("src").alias("caller"), "type",
        "inferred", conf_rank("confidence").alias("rank"),
        F.coalesce(site["file_path"], F.lit("")).alias("site_file"),
        F.coalesce(site["line"], F.lit(0)).alias("site_line"))
    start = roots.select("root_id", "gv", F.col("node").alias("root_node")).distinct()
    cols = ["root_id", "gv", "root_node", "caller", "hops", "rank", "inferred", "type", "via", "site_file",
            "site_line"]
    hop1 = cut(start.withColumnRenamed("root_node", "via").join(back, ["gv", "via"])
               .filter("caller <> via").withColumn("root_node", F.col("via")).withColumn("hops", F.lit(1))
               .select(*cols), "callers")
    base = hop1.select("root_id", "gv", "root_node", F.col("caller").alias("via"), F.col("rank").alias("r1"),
                       F.col("inferred").alias("i1")).distinct()
    hop2 = (base.join(back, ["gv", "via"]).filter("caller <> root_node AND caller <> via")
            .withColumn("rank", F.greatest("rank", "r1")).withColumn("inferred", F.col("inferred") | F.col("i1"))
            .withColumn("hops", F.lit(2)).select(*cols))
    order = F.struct("hops", "rank", "inferred", "type", "via", "site_file", "site_line")
    best = group_hashed(hop1.unionByName(hop2), "root_id", "gv", "caller").agg(F.min(order).alias("b"))
    return best.select("root_id", "gv", "caller", "b.hops", "b.rank", "b.inferred", "b.type", "b.site_file",
                       "b.site_line")


def caller_totals(callers: DataFrame, cap: int | None = None) -> DataFrame:
    """root_id, gv, total, truncated, ambiguous over all callers, capped list or not."""
    return callers.groupBy("root_id", "gv").agg(
        F.count("*").alias("caller_total"), F.count_if(F.col("rank") == 3).alias("ambiguous_callers")).select(
        "root_id", "gv", "caller_total", (F.lit(False) if cap is None else F.col("caller_total") > cap).alias("truncated"), "ambiguous_callers")


def count_callers(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``caller_totals`` of ``all_callers``, without their paths.

    Of the best path only (hops, rank) is kept, packed as 8 * hops + rank + 1 (an unknown or null confidence is
    before all others, rank -1), so no call site is moved and no struct is sorted.
    ``edges`` is read twice, so it should be a stored table.
    """
    back = edges.filter(F.col("type").isin(REVERSE_TYPES) & (F.col("src") != F.col("dst"))).select(
        F.col("graph_version_id").alias("gv"), F.col("dst").alias("via"), F.col("src").alias("caller"),
        F.coalesce(conf_rank("confidence"), F.lit(-1)).alias("rank"))
    start = roots.select("root_id", "gv", F.col("node").alias("root_node")).distinct()
    hop1 = cut(start.join(back.withColumnRenamed("via", "root_node"), ["gv", "root_node"])
               .groupBy("root_id", "gv", "root_node", "caller").agg(F.min("rank").alias("rank")), "callers")
    near = hop1.select("root_id", "gv", "root_node", F.col("caller").alias("via"), F.col("rank").alias("r1"))
    hop2 = near.join(back, ["gv", "via"]).filter("caller <> root_node").withColumn("rank", F.greatest("rank", "r1"))
    packed = lambda df, hops: df.select("root_id", "gv", "caller", (F.lit(8 * hops + 1) + F.col("rank")).alias("p"))
    best = packed(hop1, 1).unionByName(packed(hop2, 2)).groupBy("root_id", "gv", "caller").agg(F.min("p").alias("p"))
    return caller_totals(best.select("root_id", "gv", (F.col("p") % 8 - 1).alias("rank")))


def rank_callers(callers: DataFrame, roots: DataFrame, cap: int | None = None) -> DataFrame:
    """All callers (with ``cap``, the first ones) per root, by position: incompatible first, then hops, then trust, then key."""
    compatible = roots.select("root_id", "gv", "signature_compatible").distinct()
    keys, order = ["root_id", "gv"], ["signature_compatible", "hops", "rank", "caller"]
    ranked = callers.join(compatible, keys)
    if cap is None:
        ranked = rank_within(ranked, keys, order)
    else:
        ranked = ranked.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("position") <= cap)
    return ranked.select(
        "root_id", "gv", "position", F.col("caller").alias("key"), display_name("caller").alias("display_name"), "hops",
        F.col("site_file").alias("file_path"), F.col("site_line").alias("line"), usage_of("type").alias("usage"),
        "signature_compatible", conf_name("rank").alias("confidence"), "inferred")


def direct_callers(roots: DataFrame, edges: DataFrame, cap: int | None = None):
    """(ranked callers, totals); ``roots`` carries signature_compatible."""
    callers = cut(all_callers(roots, edges), "all-callers")
    return rank_callers(callers, roots, cap), caller_totals(callers, cap)


def now_depends_on(roots: DataFrame, head_edges: DataFrame, base_edges: DataFrame) -> DataFrame:
    """One row per outgoing head edge of each root; is_new = target absent from its base targets.

    ``roots``: root_id, node, gv (base version), head_gv.
    """
    start = roots.select("root_id", "gv", "head_gv", "node").distinct()
    head = head_edges.select(F.col("graph_version_id").alias("head_gv"), F.col("src").alias("node"),
                             F.col("dst").alias("key"), "type", "confidence", "inferred")
    from_roots = start.select(F.col("gv").alias("graph_version_id"), F.col("node").alias("src")).distinct()
    known = base_edges.join(from_roots, ["graph_version_id", "src"], "left_semi").select(F.col("graph_version_id").alias("gv"), F.col("src").alias("node"),
                              F.col("dst").alias("key")).distinct().withColumn("known", F.lit(True))
    return (start.join(head, ["head_gv", "node"]).join(known, ["gv", "node", "key"], "left")
            .select("root_id", "gv", "key", display_name("key").alias("display_name"), "type",
                    F.col("known").isNull().alias("is_new"), "confidence", "inferred"))


def ambiguous_on_path(totals: DataFrame, data: DataFrame, roots: DataFrame) -> DataFrame:
    """Ambiguous callers (uncapped) plus ambiguous data surfaces per root; zero rows count as zero."""
    keys = ["root_id", "gv"]
    parts = (totals.select(*keys, F.col("ambiguous_callers").alias("n"))
             .unionByName(data.filter("confidence = 'ambiguous'").select(*keys, F.lit(1).cast("long").alias("n")))
             .unionByName(roots.select(*keys).distinct().withColumn("n", F.lit(0).cast("long"))))
    return parts.groupBy(*keys).agg(F.sum("n").alias("ambiguous_edges_on_path"))


def reachable(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Unbounded closure over links(gv, from_node, to_node): root_id, gv, node, distance.

    Runs until no new node appears, one round per unit of distance (ancestor tests on long histories: ``ripple.operators.history``).
    """
    # A link that repeats leads nowhere else, so links are laid out as they come.
    hops = salt_hops(links.select("gv", "from_node", "to_node").filter("from_node <> to_node"), bucketed=True)
    state = ["root_id", "gv", "node"]
    seen = Levels(roots.sparkSession, "reach", "distance")
    level = seen.append(roots.select(*state).distinct())
    while not level.isEmpty():
        grown = expand(level, hops).select("root_id", "gv", F.col("to_node").alias("node")).distinct()
        again = seen.all().select(*state)
        if level.count() <= FEW:
            # What was seen before is scanned, and only what is met again is kept: a small level does not shuffle it.
            grown = cut(grown, "grown")
            if grown.count() <= FEW:
                again = again.join(F.broadcast(grown), state, "left_semi")
        level = seen.append(grown.join(again, state, "left_anti"))
    return seen.all()


def reverse_reachable(roots: DataFrame, edges: DataFrame, types=None) -> DataFrame:
    """Everything that can reach the roots over any edge type, with its distance."""
    if types is not None:
        edges = edges.filter(F.col("type").isin(list(types)))
    return reachable(roots, edges.select(F.col("graph_version_id").alias("gv"), F.col("dst").alias("from_node"),
                                         F.col("src").alias("to_node")))


def ancestor_closure(type_supertypes: DataFrame) -> DataFrame:
    """(gv, fqcn, supertype_fqcn) -> (gv, fqcn, ancestor_fqcn, distance), nearest distance only.

    A supertype with no row of its own is kept as an ancestor and simply leads nowhere.
    """
    roots = type_supertypes.select("gv", F.col("fqcn").alias("node")).distinct().withColumn("root_id", F.col("node"))
    links = type_supertypes.select("gv", F.col("fqcn").alias("from_node"), F.col("supertype_fqcn").alias("to_node"))
    return reachable(roots, links).filter("distance > 0").select(
        "gv", F.col("root_id").alias("fqcn"), F.col("node").alias("ancestor_fqcn"), "distance")
