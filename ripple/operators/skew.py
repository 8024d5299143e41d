"""Numbering rows inside groups that may not fit one task."""

from pyspark.sql import DataFrame, functions as F, Window as W

from ripple.session import cut


def group_hashed(df: DataFrame, *keys: str):
    """``groupBy`` with the hash of the keys in front.

    Aggregates over structs or arrays are sort-based; sorting by one long first is far cheaper than comparing
    long text keys that share a prefix. The hash only orders rows, equality still uses the keys themselves.
    """
    return df.groupBy(F.xxhash64(*keys).alias("_h"), *keys)


def _pieces(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows in pieces of one total order by (keys, order), each sorted and written; ``_row`` grows along a piece without gaps."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    return cut(parted.withColumns({"_piece": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "pieces")


def _before(pieces: DataFrame, keys: list[str], size) -> DataFrame:
    """One row per group and piece: the first ``_row`` of the group there, and what the pieces before it hold of the group.

    Stored, so that its size is known and the rows themselves need not be shuffled to meet it.
    """
    earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    return cut(pieces.groupBy(*keys, "_piece").agg(F.min("_row").alias("_first"), size.alias("_n"))
               .select(*keys, "_piece", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")), "before")


def rank_within(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Exact 1-based position of each row in its group, without gathering a group in one task.

    Rows are range-partitioned by (keys, order), so a hot group spans many pieces; within a piece the rows of a group follow one another,
    so a position is a difference of row numbers. The rows themselves are shuffled once: what is joined to them is one row per group and piece.
    """
    pieces = _pieces(df, keys, order)
    return (pieces.join(_before(pieces, keys, F.count("*")), [*keys, "_piece"])
            .withColumn(name, F.col("_row") - F.col("_first") + F.col("_before") + 1).drop("_piece", "_row", "_first", "_before"))


def running_total(df: DataFrame, keys: list[str], order: list[str], amount: str, name: str) -> DataFrame:
    """Sum of ``amount`` over the rows that come before each row in its group, in pieces as ``rank_within``; a window spans one piece at most."""
    pieces = _pieces(df, keys, order)
    upto = W.partitionBy(*keys, "_piece").orderBy("_row").rowsBetween(W.unboundedPreceding, -1)
    local = pieces.withColumn("_sum", F.coalesce(F.sum(amount).over(upto), F.lit(0)))
    return (local.join(_before(pieces, keys, F.sum(amount)), [*keys, "_piece"])
            .withColumn(name, F.col("_sum") + F.col("_before")).drop("_piece", "_row", "_first", "_before", "_sum"))
