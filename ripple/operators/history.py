"""Ancestor tests on commit histories by chain labels instead of a walk from commit to commit.

Every commit belongs to one chain of first parents and has a position on it, so "everything this commit reaches on that chain" is one number. Labels come from
pointer doubling: the rounds grow with the logarithm of the history's length.
"""

from pyspark.sql import DataFrame, functions as F

from ripple.session import Levels, cut

#: Positions of a chain whose outgoing links share a join key.
BLOCK = 1024
#: Peeling goes on while a round leaves at most this share of the links.
SHRINK = 0.75


def _first_parents(links: DataFrame) -> DataFrame:
    """(gv, node, up) of every commit that has a parent: the parent of the smallest ``ordinal``, if there is one, then the smallest name."""
    order = F.struct("ordinal", "to_node") if "ordinal" in links.columns else F.col("to_node")
    return links.groupBy("gv", F.col("from_node").alias("node")).agg(F.min_by("to_node", order).alias("up"))


def _subtree_sizes(nodes: DataFrame, first: DataFrame) -> DataFrame:
    """(gv, node, size): commits below each commit in the forest of first parents, itself included.

    After round k, ``up`` is the 2^k-th ancestor and ``size`` counts the descendants nearer than 2^k. Members of a cycle, which no real
    history has, get some size; sizes only choose chains.
    """
    keys = ["gv", "node"]
    rows = cut(nodes.join(first, keys, "left").withColumn("size", F.lit(1).cast("double")), "sizes")
    left, before = rows.filter("up is not null").count(), None
    while left and left != before:
        climbing = rows.filter("up is not null")
        above = rows.select("gv", F.col("node").alias("up"), F.col("up").alias("next"))
        moved = climbing.join(above, ["gv", "up"]).select("gv", "node", F.col("next").alias("up"), "size")
        gained = climbing.groupBy("gv", F.col("up").alias("node")).agg(F.sum("size").alias("size"))
        rows = cut(moved.unionByName(rows.filter("up is null"))
                   .unionByName(gained.withColumn("up", F.lit(None).cast("string"))).groupBy(*keys).agg(F.max("up").alias("up"), F.sum("size").alias("size")), "sizes")
        before, left = left, rows.filter("up is not null").count()
    return rows.select(*keys, "size")


def chain_labels(links: DataFrame) -> DataFrame:
    """links(gv, from_node, to_node [, ordinal]) -> (gv, node, chain, position): each node on exactly one chain.

    ``chain`` is the node at position 0; the node at position p links directly to the one at p - 1. A node is continued by the child with
    the largest subtree among those whose first parent it is, so a path of first parents changes its chain a logarithmic number of
    times. Members of a ring of first parents are chains of their own. Null nodes must have been removed.
    """
    nodes = links.select("gv", F.col("from_node").alias("node")).unionByName(links.select("gv", F.col("to_node").alias("node"))).distinct()
    first = cut(_first_parents(links), "first-parents")
    sizes = _subtree_sizes(nodes, first)
    chosen = (first.join(sizes, ["gv", "node"]).groupBy("gv", "up").agg(F.max_by("node", F.struct("size", "node")).alias("node"))
              .select("gv", "node", F.col("up").alias("top")))
    rows = cut(sizes.select("gv", "node").join(chosen, ["gv", "node"], "left").select(
        "gv", "node", F.coalesce("top", "node").alias("top"), F.when(F.col("top").isNull(), 0).otherwise(1).cast("long").alias("position"), F.col("top").isNotNull().alias("open")), "chains")
    left, before = rows.filter("open").count(), None
    while left and left != before:
        above = rows.select("gv", F.col("node").alias("top"), F.col("top").alias("next"), F.col("position").alias("further"), F.col("open").alias("still"))
        moved = rows.filter("open").join(above, ["gv", "top"]).select(
            "gv", "node", F.col("next").alias("top"), (F.col("position") + F.col("further")).alias("position"), F.col("still").alias("open"))
        rows = cut(moved.unionByName(rows.filter("not open")), "chains")
        before, left = left, rows.filter("open").count()
    return rows.select("gv", "node", F.when(F.col("open"), F.col("node")).otherwise(F.col("top")).alias("chain"),
                       F.when(F.col("open"), F.lit(0).cast("long")).otherwise(F.col("position")).alias("position"))


def peel(links: DataFrame) -> tuple[DataFrame, int]:
    """links(gv, from_node, to_node) -> (gv, node, top) of every commit with a child, and the last round.

    A round takes away the commits without children; ``top`` is the round that a commit was still there after (0: it has no row), which is its longest
    distance from any head. So what a commit reaches has a larger top, or that of the last round. Rounds end when they no longer take much away (long lines,
    rings), so that all of them together cost a few times the first.
    """
    seen, last = Levels(links.sparkSession, "peel", "top"), 0
    rest, left = links.select("gv", "from_node", "to_node"), links.count()
    while True:
        there = seen.append(rest.select("gv", F.col("to_node").alias("node")).distinct())
        rest = cut(rest.join(there.withColumnRenamed("node", "from_node"), ["gv", "from_node"], "left_semi"), "peeled")
        before, left = left, rest.count()
        if left == 0 or left > SHRINK * before:
            break
        last += 1
    return seen.all().groupBy("gv", "node").agg((F.max("top") + 1).alias("top")), last + 1


def is_ancestor(commit_parents: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds ``is_ancestor`` to the distinct (repo_id, base_sha, head_sha): base reachable from head over parent links, or equal to it.

    commit_parents(repo_id, sha, parent_sha [, ordinal]). A pair holds the highest position it reaches on each chain; a round takes all links that
    leave the newly reached stretches, so its number is that of chains on the way, not of commits. A pair ends once its base is covered, and does not follow
    what cannot reach its base by the rounds of ``peel``.
    Commits without a row are known to nobody and reach nothing; null shas link with nothing; repeated rows count once.
    """
    keys = ["repo_id", "base_sha", "head_sha"]
    wanted = cut(pairs.select(*keys).distinct().withColumn("pair", F.monotonically_increasing_id()), "pairs")
    order = [c for c in ["ordinal"] if c in commit_parents.columns]
    links = cut(commit_parents.join(wanted.select("repo_id").distinct(), "repo_id", "left_semi").filter("sha <> parent_sha")
                .select(F.col("repo_id").alias("gv"), F.col("sha").alias("from_node"), F.col("parent_sha").alias("to_node"), *order).distinct(), "links")
    tops, last = peel(links)
    labels = cut(chain_labels(links).join(tops, ["gv", "node"], "left").fillna(0, "top"), "labels")

    def end(side):
        return labels.select("gv", F.col("node").alias(f"{side}_node"), F.col("chain").alias(f"{side}_chain"), F.col("position").alias(f"{side}_position"),
                             F.col("top").alias(f"{side}_top"))

    # Links down the same chain are what positions say already.
    cross = (links.select("gv", "from_node", "to_node").join(end("from"), ["gv", "from_node"]).join(end("to"), ["gv", "to_node"])
             .filter("from_chain <> to_chain or to_position > from_position"))
    # Along a chain the top falls with the position, so the smallest belongs to the highest.
    cross = cut(cross.groupBy("gv", F.col("from_chain").alias("chain"), "from_position", "to_chain").agg(F.max("to_position").alias("to_position"), F.min("to_top").alias("to_top"))
                .withColumn("block", F.floor(F.col("from_position") / BLOCK)), "cross")
    goal, state = ["base_chain", "base_position", "base_top"], ["pair", "gv", "chain"]

    def may_reach(chain, position, top):
        return f"base_top >= least({top} + 1, {last}) or ({chain} = base_chain and {position} >= base_position)"

    starts = (wanted.filter("base_sha <> head_sha").select("pair", F.col("repo_id").alias("gv"), F.col("base_sha").alias("base_node"), F.col("head_sha").alias("from_node"))
              .join(end("base"), ["gv", "base_node"]).join(end("from"), ["gv", "from_node"]).filter(may_reach("from_chain", "from_position", "from_top"))
              .select("pair", "gv", F.col("from_chain").alias("chain"), F.col("from_position").alias("position"), *goal, F.lit(-1).cast("long").alias("low")))
    met = "chain = base_chain and position >= base_position"
    seen = Levels(wanted.sparkSession, "ancestors", "round")
    level = seen.append(starts)
    while not level.isEmpty():
        # Every row of a level comes from a pair that was open before, so only the level itself can have closed it.
        open_rows = level.join(level.filter(met).select("pair").distinct(), "pair", "left_anti")
        probe = open_rows.withColumn("block", F.explode(F.sequence(F.floor(F.greatest("low", F.lit(0)) / BLOCK), F.floor(F.col("position") / BLOCK))))
        grown = (probe.join(cross, ["gv", "chain", "block"]).filter("from_position > low and from_position <= position").filter(may_reach("to_chain", "to_position", "to_top"))
                 .groupBy("pair", "gv", F.col("to_chain").alias("chain")).agg(F.max("to_position").alias("position"), *[F.first(c).alias(c) for c in goal]))
        known = seen.all().groupBy(*state).agg(F.max("position").alias("known"))
        level = seen.append(grown.join(known, state, "left").filter("known is null or position > known")
                            .select("pair", "gv", "chain", "position", *goal, F.coalesce("known", F.lit(-1).cast("long")).alias("low")))
    hit = seen.all().filter(met).select("pair").distinct().withColumn("hit", F.lit(True))
    return wanted.join(hit, "pair", "left").select(*keys, F.coalesce("hit", F.col("base_sha") == F.col("head_sha"), F.lit(False)).alias("is_ancestor"))
