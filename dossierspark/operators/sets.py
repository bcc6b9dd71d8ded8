"""Unions, first-wins merges and token-set overlap."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierspark.operators.ranking import best_row


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_distinct(*dfs: DataFrame) -> DataFrame:
    """Distinct before and after the union, so the exchange carries one row per value and task."""
    return reduce(DataFrame.unionByName, [d.distinct() for d in dfs]).distinct()


def merge_first(sets, keys, order) -> DataFrame:
    """Union of candidate sets; the earliest set wins, then the given order."""
    tagged = [df.withColumn("set_no", F.lit(i)) for i, df in enumerate(sets)]
    return best_row(union_all(*tagged), keys, [F.col("set_no"), *order])


def jaccard(a: Column, b: Column) -> Column:
    """|a ∩ b| / |a ∪ b| of two token sets; 0 where one is empty."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / union)
