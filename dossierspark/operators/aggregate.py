"""Counts, summaries and first-seen numbering; all with map-side partial aggregation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierspark.operators.ranking import ranked, top_n
from dossierspark.session import as_cols


def value_counts(df: DataFrame, columns, empty: str = "missing") -> DataFrame:
    """Counts of the values of several columns in one pass over the data."""
    clean = df.select(*[
        F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit(empty)).alias(c) for c in columns
    ])
    grouped = clean.groupingSets([[F.col(c)] for c in columns], *as_cols(columns)).agg(
        F.count(F.lit(1)).alias("n")
    )
    field = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns])
    return grouped.select(field.alias("field"), F.coalesce(*columns).alias("value"), "n")


def conditional_counts(df: DataFrame, keys, measures: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in measures.items()])


def counts_including_empty(base: DataFrame, rows: DataFrame, key: str, measures: dict[str, Column]) -> DataFrame:
    """Every base key with its counts, zero where no row was processed; rows aggregate before the join."""
    agg = conditional_counts(rows, [key], measures)
    return base.join(agg, key, "left").fillna(0, subset=list(measures))


def weighted_signal(hits: DataFrame, title: str, score: str, weight: str, source: str, seq: str,
                    keep: int = 4, compat: bool = False) -> DataFrame:
    """Weighted mean score per title, with its first distinct source ids.

    ``compat`` divides by at least 1, as the behaviour to match does for light titles.
    """
    total = F.sum(weight)
    divisor = F.greatest(total, F.lit(1.0)) if compat else total
    mean = hits.groupBy(title).agg((F.sum(F.col(weight) * F.col(score)) / divisor).alias("signal"))
    firsts = hits.groupBy(title, source).agg(F.min(seq).alias("_first"))
    ids = (
        top_n(firsts, [title], [F.col("_first"), F.col(source)], keep, "_r")
        .groupBy(title)
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", source))),
                                      lambda s: s[source].cast("string")), ",").alias("source_ids"))
    )
    return mean.join(ids, title)


def pivot_scores(df: DataFrame, key: str, area: str, areas) -> DataFrame:
    return df.groupBy(key).pivot(area, list(areas)).agg(F.count(F.lit(1))).fillna(0)


def weighted_votes(votes: DataFrame, original: DataFrame, profile: str, letter: str, weight: str,
                   position: str) -> DataFrame:
    """Sum of vote weights per letter, only letters of the original code, original order on ties."""
    sums = votes.groupBy(profile, letter).agg(F.sum(weight).alias("votes"))
    kept = original.join(sums, [profile, letter], "left").fillna(0.0, subset=["votes"])
    order = Window.partitionBy(profile).orderBy(F.col("votes").desc(), F.col(position))
    return kept.withColumn("refined_rank", F.row_number().over(order))


def text_stats(df: DataFrame, keys, text: str) -> DataFrame:
    n = F.length(text)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(n).alias("total_chars"), F.avg(n).alias("mean_chars")
    )


def coverage(tables, key: str) -> DataFrame:
    """How many of the named tables hold each key; each table is reduced to its keys first."""
    tagged = [df.select(key).distinct().withColumn("table_name", F.lit(n)) for n, df in tables]
    return (
        reduce(DataFrame.unionByName, tagged).groupBy(key)
        .agg(F.count(F.lit(1)).alias("tables_covered"),
             F.array_join(F.array_sort(F.collect_list("table_name")), ",").alias("table_names"))
    )


def leading_entity(hits: DataFrame, query: str, entity: str, rank: str) -> DataFrame:
    """First seen and most frequent entity of each hit list; ties go to the earlier one."""
    per = hits.filter(F.col(entity).isNotNull()).groupBy(query, entity).agg(
        F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")
    )
    return per.groupBy(query).agg(
        F.min_by(entity, F.struct("first", entity)).alias("first_entity"),
        F.max_by(entity, F.struct(F.col("n"), -F.col("first"), F.col(entity))).alias("frequent_entity"),
        F.max("n").alias("frequent_count"),
    )


def latest(df: DataFrame, keys, seq, columns) -> DataFrame:
    """Last row per key of an append log, as a partial aggregate."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*seq)).alias("_row"))
    return picked.select(*keys, "_row.*")


def core_items(df: DataFrame, profile: str, item: str, rank: str, n: int = 10) -> DataFrame:
    """First n distinct items of a ranked list, in order of first appearance."""
    firsts = df.groupBy(profile, item).agg(F.min(rank).alias("first_rank"))
    return top_n(firsts, [profile], [F.col("first_rank"), F.col(item)], n, "place")


def first_seen_ids(df: DataFrame, report: str, key, seq) -> DataFrame:
    """Citation numbers: distinct keys numbered by first appearance in their report."""
    firsts = df.groupBy(report, *key).agg(F.min(F.struct(*seq)).alias("_first"))
    return ranked(firsts, [report], [F.col("_first")], "citation_id").drop("_first")


def table_profile(spark, tables) -> DataFrame:
    """Row count and schema per table; the schema is metadata, only the counts read data."""
    parts = []
    for name, df in tables:
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
        parts.append(df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows",
            F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(fields).alias("fields"),
        ))
    return reduce(DataFrame.unionByName, parts)
