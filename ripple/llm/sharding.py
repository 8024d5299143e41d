"""Shards under a byte limit by extendible hashing, with DataFrame operations only."""

from pyspark.sql import Column, DataFrame, functions as F

from ripple.llm.common import cut, md5_bits

#: Bits of a hash, and bits by which the directory deepens in a round.
BITS, STEP = 60, 12


def extendible_shards(docs: DataFrame, key: str, size: Column, limit: int) -> DataFrame:
    """Give each row the shard that its hash prefix leads to; every shard holds at most ``limit`` bytes.

    The directory is indexed by the first bits of the md5 of ``key``. A bucket over the limit is split on its next
    bit, and only such a bucket: each round adds up the bytes of the still oversized buckets by a prefix of ``STEP``
    more bits (partial sums first, so a round shuffles prefixes, not rows) and keeps, on each path, the shallowest
    bucket that fits. Rows whose keys are equal go on by the md5 of the whole row, and equal rows at last by their
    number, so that a hot key is split too. A row larger than the limit is a shard of its own.

    Null keys hash as one key, null sizes count as 0 bytes, an empty table gives no rows; other columns only tell rows of one key apart. Returns ``key``, ``depth``
    (bits used), ``shard`` (those bits; hexadecimal, with the row hash and page after dots where they were needed),
    ``n_bytes``, ``shard_bytes`` and ``shard_rows``; a shard is named by ``depth`` and ``shard`` together.
    """
    spark = docs.sparkSession
    k1 = md5_bits(F.col(key).cast("string"))
    size = F.coalesce(size, F.lit(0)).cast("long")
    rows = docs.select(F.col(key).alias("_key"), k1.alias("_h"), F.lit(0).cast("long").alias("_g"), size.alias("_size"))
    rows = cut(rows, "shard_rows")
    done, todo, level = [], rows, 0
    while level < 2 * BITS:
        if level == BITS:  # equal keys: go on by the hash of the whole row
            hot = todo.select("_h").distinct()
            every = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
            whole = docs.select(F.col(key).alias("_key"), k1.alias("_h"), md5_bits(every).alias("_g"), size.alias("_size"))
            todo = cut(whole.join(hot, "_h", "left_semi"), "shard_equal_keys")
        found, rest = _round(todo, level, limit)
        done.append(found)
        level += STEP
        if rest.isEmpty():
            todo = None
            break
        todo = rest
    parts = [x.select("_key", "depth", "shard", "_size", "shard_bytes", "shard_rows") for x in done]
    if todo is not None:
        parts.append(_pages(todo, limit))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("_key").alias(key), "depth", "shard", F.col("_size").alias("n_bytes"), "shard_bytes", "shard_rows")


def _round(rows: DataFrame, level: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose bucket fits within ``STEP`` more bits, and the rows of buckets that do not."""
    deep = level + STEP
    of_row = level >= BITS
    used = deep - BITS if of_row else deep
    part = F.shiftright("_g" if of_row else "_h", BITS - used)
    top = F.col("_h") if of_row else F.lit(0).cast("long")
    rows = rows.withColumns({"_top": top, "_prefix": part})
    groups = cut(rows.groupBy("_top", "_prefix").agg(F.sum("_size").alias("b"), F.count(F.lit(1)).alias("n")), "shard_prefixes")
    paths = groups.select("*", F.explode(F.sequence(F.lit(used - STEP), F.lit(used))).alias("d")).withColumn(
        "node", F.expr(f"shiftright(_prefix, {used} - d)"))
    nodes = paths.groupBy("_top", "d", "node").agg(F.sum("b").alias("nb"), F.sum("n").alias("nn"))
    fits = nodes.where((F.col("nb") <= limit) | (F.col("nn") == 1))
    directory = cut(paths.join(fits, ["_top", "d", "node"]).groupBy("_top", "_prefix").agg(
        F.min(F.struct("d", "node", "nb", "nn")).alias("x")), "shard_directory")
    joined = rows.join(directory, ["_top", "_prefix"], "left")
    name = F.lower(F.hex("x.node"))
    name = F.concat(F.lower(F.hex("_h")), F.lit("."), name) if of_row else name
    found = joined.where("x is not null").select(
        "*", (F.col("x.d") + (BITS if of_row else 0)).alias("depth"), name.alias("shard"),
        F.col("x.nb").alias("shard_bytes"), F.col("x.nn").alias("shard_rows"))
    over = groups.join(directory, ["_top", "_prefix"], "left_anti").select("_top", "_prefix")
    return found, rows.join(over, ["_top", "_prefix"], "left_semi").drop("_top", "_prefix")


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Equal rows in pages under the limit; they are numbered by their count, not gathered."""
    same = rows.groupBy("_key", "_h", "_g", "_size").agg(F.count(F.lit(1)).alias("n"))
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col("_size"))).cast("long")
    pages = same.withColumn("each", each).withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(n - 1) div each"))))
    pages = pages.withColumn("shard_rows", F.least(F.col("each"), F.col("n") - F.col("page") * F.col("each")))
    return pages.select(
        "_key", F.lit(2 * BITS).alias("depth"), F.concat_ws(".", F.lower(F.hex("_h")), F.lower(F.hex("_g")), "page").alias("shard"),
        "_size", (F.col("shard_rows") * F.col("_size")).alias("shard_bytes"), "shard_rows",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("shard_rows")))).drop("col")


def write_shards(docs: DataFrame, shards: DataFrame, key: str, path: str) -> None:
    """Write the rows of ``docs`` (unique in ``key``) as one folder a shard; bits name a shard only together with their number.

    Rows with a null key have no folder; columns of ``docs`` named ``depth`` or ``shard`` are replaced.
    """
    named = docs.drop("depth", "shard").join(shards.select(key, "depth", "shard"), key)
    named.repartition("depth", "shard").write.partitionBy("depth", "shard").parquet(path)


def op4_extendible_sharding(spark, sf_dir):
    from ripple.llm.common import table

    docs = table(spark, sf_dir, "documents")
    return extendible_shards(docs, "doc_id", F.octet_length("text"), LIMIT)


#: Bytes of text in a shard of the registered query.
LIMIT = 1 << 20

OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS b, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
e AS (SELECT doc_id, b, k::INTEGER AS k, h >> ({BITS} - k)::BIGINT AS p FROM d, range(0, {BITS} + 1) r(k)),
s AS (SELECT k, p, sum(b)::BIGINT AS nb, count(*) AS nn FROM e GROUP BY k, p),
f AS (SELECT e.doc_id, e.b, min({{'k': e.k, 'p': e.p, 'nb': s.nb, 'nn': s.nn}}) AS x
      FROM e JOIN s ON e.k = s.k AND e.p = s.p WHERE s.nb <= {LIMIT} OR s.nn = 1 GROUP BY e.doc_id, e.b)
SELECT doc_id, x.k AS depth, lower(to_hex(x.p)) AS shard, b AS n_bytes, x.nb AS shard_bytes, x.nn AS shard_rows FROM f
"""
