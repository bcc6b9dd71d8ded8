"""Joins with labels, fallbacks and agreement checks. Spark picks the physical join by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierspark.operators.ranking import best_row


def with_label(facts: DataFrame, dim: DataFrame, on, how: str = "inner") -> DataFrame:
    return facts.join(dim, on, how)


def label_fallback(df: DataFrame, chain, out: str, default: str) -> DataFrame:
    """Left-join several label tables, first non-empty label wins.

    ``chain`` is a list of (dim, join columns, label column); dims are reduced to
    one row per key first, so a 1:n hierarchy cannot multiply the facts.
    """
    labels = []
    for i, (dim, on, label) in enumerate(chain):
        name = f"_label{i}"
        one = dim.groupBy(*on).agg(F.min(F.nullif(F.trim(F.col(label)), F.lit(""))).alias(name))
        df = df.join(one, list(on), "left")
        labels.append(F.col(name))
    return df.withColumn(out, F.coalesce(*labels, F.lit(default))).drop(*[f"_label{i}" for i in range(len(chain))])


def related_titles(edges: DataFrame, dim: DataFrame, key: str, title: str, source: str, target: str,
                   how: str = "inner") -> DataFrame:
    """Both ends of an edge list get their title from one dimension."""
    a = dim.select(F.col(key).alias(source), F.col(title).alias("source_title"))
    b = dim.select(F.col(key).alias(target), F.col(title).alias("target_title"))
    return edges.join(a, source, "inner").join(b, target, how)


def first_match(df: DataFrame, ref: DataFrame, on, order) -> DataFrame:
    """Left join to one reference row per key."""
    return df.join(best_row(ref, on, order), list(on), "left")


def lookup_fill(df: DataFrame, ref: DataFrame, code: str, title: str) -> DataFrame:
    """Missing codes come from the title, missing titles from the code."""
    by_code = ref.groupBy(code).agg(F.min(title).alias("_title"))
    by_title = ref.groupBy(title).agg(F.min(code).alias("_code"))
    return (
        df.join(by_code, code, "left").join(by_title, title, "left")
        .withColumn(code, F.coalesce(code, "_code"))
        .withColumn(title, F.coalesce(title, "_title"))
        .drop("_code", "_title")
    )


def evidence_for_tasks(tasks: DataFrame, evidence: DataFrame, on, task_text: Column, evidence_text: Column,
                       order) -> DataFrame:
    """Best agreeing evidence row per task; a warning where only disagreeing rows exist.

    Two bounded joins instead of one task × evidence product: the best agreeing
    row per key and text, and a flag whether the key has evidence at all.
    """
    tasks = tasks.withColumn("_text", task_text)
    evidence = evidence.withColumn("_text", evidence_text)
    agreeing = best_row(evidence, [*on, "_text"], order)
    known = evidence.select(*on).distinct().withColumn("_known", F.lit(True))
    return (
        tasks.join(agreeing.withColumn("_agrees", F.lit(True)), [*on, "_text"], "left")
        .join(known, list(on), "left")
        .withColumn(
            "evidence_status",
            F.when(F.col("_agrees"), F.lit("evidence"))
            .when(F.col("_known"), F.lit("text_mismatch"))
            .otherwise(F.lit("unobserved")),
        )
        .drop("_text", "_agrees", "_known")
    )


def match_listings(profiles: DataFrame, listings: DataFrame, targets, category: str, level: str) -> DataFrame:
    """Explode the (group, category, level) targets of each profile and equi-join the listings."""
    spread = profiles.select(
        "*",
        F.explode(F.array(*[
            F.struct(F.lit(g).alias("match_group"), c.alias(category), lv.alias(level)) for g, c, lv in targets
        ])).alias("_t"),
    ).select(*profiles.columns, "_t.*")
    return spread.join(listings, [category, level])


def match_nearby(profiles: DataFrame, listings: DataFrame, category: str, level: str, low: int = 1,
                 high: int = 5) -> DataFrame:
    """Levels one below and one above, inside the scale: an equi-join on two values."""
    near = F.filter(
        F.array(F.col(level) - 1, F.col(level) + 1), lambda v: (v >= low) & (v <= high)
    )
    spread = profiles.withColumn("listing_level", F.explode(near))
    return spread.join(listings.withColumnRenamed(level, "listing_level"), [category, "listing_level"])


def linkage(tables, label: DataFrame, label_key: str, label_name: str) -> DataFrame:
    """Distinct (source, kind, target name) over several link tables given as (kind, df[source, target])."""
    links = None
    for kind, df in tables:
        part = df.select("source", "target").withColumn("kind", F.lit(kind))
        links = part if links is None else links.unionByName(part)
    names = label.select(F.col(label_key).alias("target"), F.col(label_name).alias("target_name"))
    named = links.distinct().join(names, "target", "left")
    return named.select(
        "source", "kind", F.coalesce("target_name", F.col("target").cast("string")).alias("target_name")
    ).distinct()
