"""Vector search for a table of queries, and what happens to its hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierspark.operators.ranking import best_row, cap_per_key, top_n
from dossierspark.operators.vectors import Lists, fit_lists, list_search, pair_search


def score_of(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def knn(queries: DataFrame, corpus: DataFrame, qid: str, cid: str, vec: str, k: int, metric: str = "l2sq", where: Column | None = None,
        within: str | None = None) -> DataFrame:
    """k nearest corpus rows per query: (qid, cid, distance, score, rank); filters come before the k.

    ``within`` names a column both sides share: only rows of the same entity meet. See ``vectors`` for the blocks that meet.
    """
    if where is not None:
        corpus = corpus.filter(where)
    hits = pair_search(queries, corpus, qid, cid, vec, k, metric, within)
    return top_n(hits, [qid], [F.col("distance"), F.col(cid)], k).withColumn("score", score_of(F.col("distance")))


def approximate_knn(queries: DataFrame, corpus: DataFrame, qid: str, cid: str, vec: str, k: int, fitted: Lists | None = None) -> DataFrame:
    """As ``knn`` over inverted lists: all corpus rows are indexed, each query probes the lists nearest to it."""
    hits = list_search(queries, corpus, qid, cid, vec, k, fitted or fit_lists(corpus, cid, vec, k))
    return top_n(hits, [qid], [F.col("distance"), F.col(cid)], k).withColumn("score", score_of(F.col("distance")))


def merge_sets(sets, qid: str, cid: str, order, k: int | None = None) -> DataFrame:
    """Hits of several searches: the earliest set keeps a repeated document, then the first k."""
    tagged = [df.withColumn("set_no", F.lit(i)) for i, df in enumerate(sets)]
    once = best_row(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged), [qid, cid], [F.col("set_no"), *order])
    return once if k is None else top_n(once, [qid], [F.col("set_no"), *order], k, "place")


def best_of(sets, qid: str, cid: str, k: int) -> DataFrame:
    """Hits of several collections, best first, each document once."""
    all_hits = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sets)
    once = best_row(all_hits, [qid, cid], [F.col("distance")])
    return top_n(once, [qid], [F.col("distance"), F.col(cid)], k, "place")


def fuse(hits: DataFrame, request: str, doc: str, score: str, k: int) -> DataFrame:
    """Best score per document over all query variants of a request."""
    best = hits.groupBy(request, doc).agg(F.max(score).alias(score))
    return top_n(best, [request], [F.col(score).desc(), F.col(doc)], k, "place")


def rerank(hits: DataFrame, boosts, qid: str, cid: str, exact: Column | None, k: int) -> DataFrame:
    """Adds boosts ``(name, condition, points)`` to the score and lists their names.

    Where at least k candidates match ``exact``, only those stay. Hits are bounded per query by the
    searches before, so the count window is small.
    """
    total, names = F.col("score"), []
    for name, condition, points in boosts:
        total = total + F.when(condition, F.lit(points)).otherwise(F.lit(0.0))
        names.append(F.when(condition, F.lit(name)))
    out = hits.withColumns({"reranked": total, "reasons": F.array_compact(F.array(*names))})
    if exact is not None:
        w = Window.partitionBy(qid)
        out = out.withColumn("_exact", F.coalesce(exact, F.lit(False))).withColumn("_n", F.count_if("_exact").over(w))
        out = out.filter((F.col("_n") < k) | F.col("_exact")).drop("_exact", "_n")
    return out.withColumn("place", F.row_number().over(Window.partitionBy(qid).orderBy(F.col("reranked").desc(), F.col(cid))))


def semantic_score(base: Column, overlap: Column, level: Column, allowed: Column, weight: Column) -> tuple[Column, Column]:
    """(adjusted score, rank score) from similarity, term overlap and level agreement."""
    boost = F.least(F.lit(0.22), overlap * F.lit(0.035))
    fits = F.array_contains(allowed, level)
    move = F.when(level.isNull() | (F.size(allowed) == 0), F.lit(0.0)).when(fits, F.lit(0.08)).otherwise(F.lit(-0.24))
    adjusted = F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + boost + move))
    return adjusted, adjusted * weight


def tiered_select(hits: DataFrame, qid: str, cid, title: str, tier: Column, order, k: int, per_title: int = 2) -> DataFrame:
    """Matched before unknown before mismatched, each document once, at most two rows per title."""
    placed = hits.withColumn("tier", tier)
    full = [F.col("tier"), *order]
    once = best_row(placed, [qid, *cid], full)
    return cap_per_key(once, [qid], [title], full, per_title, k)


def evidence_pack(chunks: DataFrame, qid: str, key, role: Column, score: str, source: str, cap: Column, cap_max: int, total: int,
                  tie) -> DataFrame:
    """Best chunk per key, roles by priority, a cap per source, a total per query."""
    best = best_row(chunks.withColumns({"role_priority": role, "_cap": cap}), [qid, *key], [F.col(score).desc(), *tie])
    order = [F.col("role_priority").desc(), F.col(score).desc(), *tie]
    return cap_per_key(best, [qid], [source], order, F.col("_cap"), total, max_m=cap_max).drop("_cap")


def gated_groups(groups, qid: str, cid: str, gate: float, gated, limit: int) -> DataFrame:
    """Ordered evidence groups merged to a limit; a gated group needs one score at the gate."""
    kept = []
    for i, df in enumerate(groups):
        if i in gated:
            strong = df.groupBy(qid).agg(F.max("score").alias("_m")).filter(F.col("_m") >= gate).select(qid)
            df = df.join(strong, qid, "left_semi")
        kept.append(df)
    return merge_sets(kept, qid, cid, [F.col("score").desc(), F.col(cid)], limit)


def recall_of(approximate: DataFrame, exact: DataFrame, qid: str, cid: str) -> DataFrame:
    """(qid, exact_hits, found, recall) of the exact hits that the approximate search returned too."""
    found = exact.join(approximate.select(qid, cid, F.lit(True).alias("_hit")), [qid, cid], "left")
    return found.groupBy(qid).agg(F.count(F.lit(1)).alias("exact_hits"), F.count_if(F.col("_hit")).alias("found"),
                                  (F.count_if(F.col("_hit")) / F.count(F.lit(1))).alias("recall"))
