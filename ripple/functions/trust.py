"""Confidence as an integer trust rank (weakest link = greatest rank)."""

from pyspark.sql import Column, functions as F

from ripple.functions.keys import _c
from ripple.schema import CONFIDENCE_BY_RANK


def conf_rank(confidence) -> Column:
    return (F.array_position(F.array(*[F.lit(x) for x in CONFIDENCE_BY_RANK]), _c(confidence)) - 1).cast("int")


def conf_name(rank) -> Column:
    return F.get(F.array(*[F.lit(x) for x in CONFIDENCE_BY_RANK]), _c(rank).cast("int"))


def weaker(a, b) -> Column:
    return conf_name(F.greatest(conf_rank(a), conf_rank(b)))
