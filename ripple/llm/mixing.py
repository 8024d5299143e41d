"""Mixing sources to target weights: token budgets down a domain-language-source tree, and a token prefix of each leaf."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ripple.llm.common import cut, md5_bits, table
from ripple.llm.components import send

LEVELS = ("_domain", "_lang", "_source")
#: Documents of a leaf in a bucket of its order, on average.
BUCKET = 8192


@dataclass
class Plan:
    """What a mixture asks for. Domains, and the weights at each level, are given by name; ``other`` holds the rest."""

    domains: dict[str, str]  # source -> domain
    domain_weights: dict[str, int]
    lang_weights: dict[str, int]
    source_weights: dict[str, int]
    default_weight: int = 1
    share: tuple[int, int] = (3, 5)  # budget: so much of all tokens
    epochs: int = 3  # a leaf gives its tokens so many times at most
    seed: int = 7


#: Parameters of the registered query.
PLAN = Plan(
    domains={**{f"src{i}": "web" for i in range(8)}, **{f"src{i}": "reference" for i in range(8, 14)}},
    domain_weights={"web": 5, "reference": 4, "other": 1}, lang_weights={"en": 6, "de": 2, "fr": 2, "es": 1}, source_weights={"src0": 3, "src9": 2})


def _named(values: dict, column: Column, default) -> Column:
    if not values:
        return F.lit(default)
    pairs = reduce(lambda a, kv: a + [F.lit(kv[0]), F.lit(kv[1])], values.items(), [])
    return F.coalesce(F.try_element_at(F.create_map(*pairs), column), F.lit(default))


def _share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide the parent's ``budget`` among siblings by ``weight``; none gets more than its ``cap``.

    Siblings are taken by ascending cap per weight: as long as the cap is at most the proportional part of what is left,
    a sibling is full and its shortage stays with the siblings after it. A shortage leaves the family only if all siblings are
    full, and it then has been kept from the parent already, whose cap is the sum of theirs. The rest is cut into integers
    at the rounded cumulative weights, so that nothing is lost.
    """
    big = lambda c: F.col(c).cast("decimal(20,0)")
    order = Window.partitionBy(*parent).orderBy((F.col("cap") / F.col("weight")).asc_nulls_last(), name)
    upto, before, after = (order.rowsBetween(*r) for r in ((Window.unboundedPreceding, 0), (Window.unboundedPreceding, -1), (0, Window.unboundedFollowing)))
    every = Window.partitionBy(*parent)
    x = nodes.withColumn("_left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_weights", F.sum("weight").over(after))
    fits = (F.col("_left") >= 0) & (big("cap") * big("_weights") <= big("_left") * big("weight"))
    x = x.withColumn("_full", F.min(fits.cast("int")).over(upto))
    open_weight = F.when(F.col("_full") == 1, F.lit(0)).otherwise(F.col("weight"))
    x = x.withColumns({"_rest": F.col("budget") - F.sum(F.when(F.col("_full") == 1, F.col("cap")).otherwise(F.lit(0))).over(every),
                       "_open": F.sum(open_weight).over(every), "_cum": F.sum(open_weight).over(upto), "_own": open_weight})
    cut_at = lambda c: F.expr(f"(cast(_rest as decimal(20,0)) * cast({c} as decimal(18,0))) div cast(_open as decimal(18,0))")
    part = F.when(F.col("_open") > 0, F.least(cut_at("_cum") - cut_at("_cum - _own"), F.col("cap"))).otherwise(F.lit(0))
    x = x.withColumn("own", F.when(F.col("_full") == 1, F.col("cap")).otherwise(part).cast("long"))
    return x.drop("_left", "_weights", "_full", "_rest", "_open", "_cum", "_own", "budget").withColumnRenamed("own", "budget")


def leaf_budgets(rows: DataFrame, plan: Plan) -> DataFrame:
    """``_domain, _lang, _source, tokens, docs, budget`` of each leaf: a stored table of one row a leaf."""
    leaves = cut(rows.groupBy(*LEVELS).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), "leaves")
    leaves = leaves.withColumn("cap", F.col("tokens") * plan.epochs)
    weights = (plan.domain_weights, plan.lang_weights, plan.source_weights)
    nodes = leaves.groupBy("_domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("_t")).withColumn("_all", F.lit(0))
    nodes = nodes.withColumn("budget", F.expr(f"(sum(_t) over (partition by _all)) * {plan.share[0]} div {plan.share[1]}")).drop("_t")
    parent = ["_all"]
    for depth, name in enumerate(LEVELS):
        nodes = nodes.withColumn("weight", _named(weights[depth], F.col(name), plan.default_weight).cast("long"))
        nodes = _share_out(nodes, parent, name)
        path = list(LEVELS[: depth + 1])
        if depth < 2:
            budgets = nodes.select(*path, "budget")
            nodes = leaves.groupBy(*LEVELS[: depth + 2]).agg(F.sum("cap").alias("cap")).join(budgets, path)
            parent = path
    return cut(leaves.drop("cap").join(nodes.select(*LEVELS, "budget"), list(LEVELS)), "budgets")


def _prepared(docs: DataFrame, tokens: Column, plan: Plan, key: str, lang: str, source: str) -> DataFrame:
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(tokens, F.lit(0)).cast("long").alias("_tokens"),
                       F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_key"), F.coalesce(F.col(lang), F.lit("")).alias("_lang"), F.coalesce(F.col(source), F.lit("")).alias("_source"))
    return rows.withColumn("_domain", _named(plan.domains, F.col("_source"), "other"))


def mixture(docs: DataFrame, tokens: Column, plan: Plan, key: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that fill the budgets: ``_row`` (all columns), ``_domain, _lang, _source, _tokens, epoch, take``.

    A leaf with budget b and t tokens gives all its rows in b div t epochs, and in the next one the rows at the front of an
    order by a hash of seed, epoch and key, until the budget is used; ``take`` is the number of tokens to use of a row, less
    than all of them in the last row of a leaf only. Rows are summed by ranges of that hash first and the running sum goes
    over the ranges; only the rows of the one range in which a leaf's budget ends are sorted.

    Null languages and sources count as leaves of their own, sources without a domain belong to ``other``, null or
    negative token counts are 0. Rows that repeat a key are taken each for itself (equal ones in any order). A table without
    tokens or rows gives no rows.
    """
    rows = _prepared(docs, F.greatest(tokens, F.lit(0)), plan, key, lang, source)
    leaves = leaf_budgets(rows, plan).where("tokens > 0 and budget > 0")
    leaves = leaves.withColumns({"_whole": F.expr("budget div tokens"), "_rest": F.expr("budget % tokens"), "_ranges": F.ceil(F.col("docs") / BUCKET)})
    joined = rows.join(send(leaves, 128), list(LEVELS))
    keep = ["_row", *LEVELS, "_tokens"]
    whole = joined.where("_whole > 0").select(*keep, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_whole"))).alias("epoch"), F.col("_tokens").alias("take"))
    last = joined.where("_rest > 0").withColumn("epoch", F.col("_whole") + 1)
    last = last.withColumn("_at", md5_bits(F.concat_ws(":", F.lit(str(plan.seed)), F.col("epoch").cast("string"), F.col("_key"))))
    last = last.withColumn("_range", F.expr("shiftright(shiftright(_at, 30) * _ranges, 30)"))
    ranges = last.groupBy(*LEVELS, "_range").agg(F.sum("_tokens").alias("_sum"), F.first("_rest").alias("_goal"))
    running = Window.partitionBy(*LEVELS).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # ranges, not rows
    ranges = cut(ranges.withColumn("_before", F.coalesce(F.sum("_sum").over(running), F.lit(0))).where("_before < _goal"), "ranges")
    last = last.join(send(ranges, 128), [*LEVELS, "_range"])
    inside = last.where("_before + _sum < _rest").select(*keep, "epoch", F.col("_tokens").alias("take"))
    edge = last.where("_before + _sum >= _rest")
    order = Window.partitionBy(*LEVELS).orderBy("_at", "_key", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_used", F.col("_before") + F.coalesce(F.sum("_tokens").over(order), F.lit(0))).where("_used < _rest")
    edge = edge.select(*keep, "epoch", F.least(F.col("_tokens"), F.col("_rest") - F.col("_used")).alias("take"))
    return whole.unionByName(inside).unionByName(edge)


def word_count(text: str = "text") -> Column:
    """White-space-separated words, the token measure of the query and the stage."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))


def mixed_documents(docs: DataFrame, plan: Plan, text: str = "text") -> DataFrame:
    """The rows of the mixture with the columns of ``docs``; a row that is used in part has that part as its text."""
    got = mixture(docs, word_count(text), plan)
    columns = {c: F.col(f"_row.`{c}`") for c in docs.columns}
    part = F.concat_ws(" ", F.slice(F.filter(F.split(columns[text], r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), F.col("take").cast("int")))
    columns[text] = F.when(F.col("take") < F.col("_tokens"), part).otherwise(columns[text])
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("take") < F.col("_tokens"), F.length(columns[text])).otherwise(columns["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return got.select(*[v.alias(c) for c, v in columns.items()])


def op1_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", word_count().alias("words"))
    got = mixture(cut(docs, "word_counts"), F.col("words"), PLAN)
    return got.select("_row.doc_id", F.col("_domain").alias("domain"), F.col("_lang").alias("lang"), F.col("_source").alias("source"),
                      "epoch", F.col("_tokens").alias("n_tokens"), F.col("take").alias("take_tokens"))


def _case(values: dict, column: str, default) -> str:
    show = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN {show(k)} THEN {show(v)}" for k, v in values.items()) + f" ELSE {show(default)} END"


def _level_sql(nodes: str, parent: str, name: str) -> str:
    """Budgets of the nodes in the CTE ``nodes`` (parent's budget, weight, cap)."""
    by = f"PARTITION BY {parent} ORDER BY cap::DOUBLE / weight, {name}"
    return f"""
    (SELECT * EXCLUDE (budget, _l, _w, _f, _own, _r, _o, _c), CASE WHEN _f = 1 THEN cap WHEN _o > 0 THEN least((_r * _c) // _o - (_r * (_c - _own)) // _o, cap) ELSE 0 END::BIGINT AS budget
     FROM (SELECT *, budget - sum(CASE WHEN _f = 1 THEN cap ELSE 0 END) OVER (PARTITION BY {parent}) AS _r, sum(_own) OVER (PARTITION BY {parent}) AS _o,
                  sum(_own) OVER ({by} ROWS UNBOUNDED PRECEDING) AS _c
           FROM (SELECT *, CASE WHEN _f = 1 THEN 0 ELSE weight END AS _own
                 FROM (SELECT *, min((_l >= 0 AND cap::HUGEINT * _w <= _l * weight)::INT) OVER ({by} ROWS UNBOUNDED PRECEDING) AS _f
                       FROM (SELECT *, budget - coalesce(sum(cap) OVER ({by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _l,
                                    sum(weight) OVER ({by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _w FROM {nodes})))))"""


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_case(PLAN.domains, "coalesce(source, '')", 'other')} AS domain,
             coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n FROM documents),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, (sum(n) * {PLAN.epochs})::BIGINT AS cap FROM d GROUP BY ALL),
n1 AS (SELECT 0 AS a, domain, sum(cap)::BIGINT AS cap, {_case(PLAN.domain_weights, 'domain', PLAN.default_weight)} AS weight,
         (SELECT (sum(tokens) * {PLAN.share[0]}) // {PLAN.share[1]} FROM leaf)::BIGINT AS budget FROM leaf GROUP BY domain),
b1 AS (SELECT * FROM {_level_sql('n1', 'a', 'domain')}),
n2 AS (SELECT domain, lang, sum(leaf.cap)::BIGINT AS cap, {_case(PLAN.lang_weights, 'lang', PLAN.default_weight)} AS weight, any_value(b1.budget) AS budget FROM leaf JOIN b1 USING (domain) GROUP BY domain, lang),
b2 AS (SELECT * FROM {_level_sql('n2', 'domain', 'lang')}),
n3 AS (SELECT domain, lang, source, leaf.cap, leaf.tokens, {_case(PLAN.source_weights, 'source', PLAN.default_weight)} AS weight, b2.budget FROM leaf JOIN b2 USING (domain, lang)),
b3 AS (SELECT *, budget // tokens AS whole, budget % tokens AS rest FROM {_level_sql('n3', 'domain, lang', 'source')} WHERE tokens > 0 AND budget > 0),
x AS (SELECT d.*, whole, rest, ('0x' || substr(md5('{PLAN.seed}:' || (whole + 1) || ':' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM d JOIN b3 USING (domain, lang, source)),
p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id::VARCHAR, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM x)
SELECT doc_id, domain, lang, source, e AS epoch, n AS n_tokens, n AS take_tokens FROM (SELECT *, unnest(range(1, whole + 1)) AS e FROM x)
UNION ALL SELECT doc_id, domain, lang, source, whole + 1, n, least(n, rest - used)::BIGINT FROM p WHERE used < rest
"""
