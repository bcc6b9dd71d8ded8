"""Entity matching in stages, each only on the rows that are still open."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierspark.functions import text as X
from dossierspark.functions.udfs import char_counts, count_bound, ratio_at_least, ratio_bound
from dossierspark.operators.ranking import best_row, top_n
from dossierspark.operators.sets import jaccard


def exact_stages(rows: DataFrame, ref: DataFrame, row_id: str, group: str, item: str, text: str, ref_order) -> DataFrame:
    """Stage 1: id inside the group. Stage 2: equal text inside the group. Stage 3: equal text anywhere.

    Both sides carry (group, item, text); the reference is reduced to its first row per key, so a
    frequent key joins one row.
    """
    r = ref.select(F.col(group).alias("_g"), F.col(item).alias("_i"), F.col(text).alias("_t"), *ref_order)
    order = [F.col(c) for c in ref_order]
    by_id = best_row(r, ["_g", "_i"], order).select(F.col("_g").alias("g1"), F.col("_i").alias("i1"), F.col("_i").alias("m1"))
    in_group = best_row(r, ["_g", "_t"], order).select(F.col("_g").alias("g2"), F.col("_t").alias("t2"), F.col("_i").alias("m2"), F.col("_g").alias("h2"))
    anywhere = best_row(r, ["_t"], order).select(F.col("_t").alias("t3"), F.col("_i").alias("m3"), F.col("_g").alias("h3"))
    joined = (
        rows.join(by_id, (F.col(group) == F.col("g1")) & (F.col(item) == F.col("i1")), "left")
        .join(in_group, (F.col(group) == F.col("g2")) & (F.col(text) == F.col("t2")) & (F.col(text) != ""), "left")
        .join(anywhere, (F.col(text) == F.col("t3")) & (F.col(text) != ""), "left")
    )
    stage = F.when(F.col("m1").isNotNull(), 1).when(F.col("m2").isNotNull(), 2).when(F.col("m3").isNotNull(), 3)
    return joined.select(
        row_id, group, text, F.coalesce("m1", "m2", "m3").alias("matched_item"),
        F.when(stage == 1, F.col("g1")).when(stage == 2, F.col("h2")).otherwise(F.col("h3")).alias("matched_group"), stage.alias("stage"),
        F.when(stage <= 2, "high").when(stage == 3, "medium").alias("confidence"))


def fuzzy_best(rows: DataFrame, ref: DataFrame, row_id: str, block: str, text: str, ref_item: str, least: float = 0.78) -> DataFrame:
    """Best sequence ratio inside a block. Each distinct pair of texts is compared once, and only when the
    lengths and the classes of their characters allow the threshold; both bounds are columns."""
    asked = rows.filter(F.col(text) != "").select(F.col(block).alias("_b"), F.col(text).alias("_q")).distinct().withColumn("_qc", char_counts("_q"))
    known = ref.filter(F.col(text) != "").groupBy(F.col(block).alias("_b"), F.col(text).alias("_t")).agg(F.min(ref_item).alias("matched_item")).withColumn(
        "_tc", char_counts("_t"))
    # Length classes turn the length bound into an equi-join: a class and its two neighbours.
    base = F.log(F.lit((2 - least) / least))
    cls = lambda c: F.floor(F.log(F.length(c).cast("double")) / base)
    near = known.withColumn("_c", F.explode(F.array(cls("_t") - 1, cls("_t"), cls("_t") + 1)))
    pairs = asked.withColumn("_c", cls("_q")).join(near, ["_b", "_c"]).filter(ratio_bound(F.col("_q"), F.col("_t")) >= least)
    pairs = pairs.filter(count_bound(F.col("_qc"), F.col("_tc"), F.length("_q"), F.length("_t")) + 1e-12 >= least).drop("_qc", "_tc")
    scored = pairs.withColumn("similarity", ratio_at_least(least)("_q", "_t")).filter(F.col("similarity").isNotNull())
    best = best_row(scored, ["_b", "_q"], [F.col("similarity").desc(), F.col("matched_item")])
    return rows.select(row_id, F.col(block).alias("_b"), F.col(text).alias("_q")).join(best, ["_b", "_q"]).select(row_id, "matched_item", "similarity")


def staged_match(rows: DataFrame, ref: DataFrame, row_id: str, group: str, item: str, text: str, ref_order,
                 sure: float = 0.88, least: float = 0.78):
    """``(matched, warnings)``: the exact stages, then similarity inside the group for the rest."""
    exact = exact_stages(rows, ref, row_id, group, item, text, ref_order)
    rest = exact.filter(F.col("stage").isNull()).select(row_id, group, text)
    close = fuzzy_best(rest, ref, row_id, group, text, item, least).withColumnRenamed("matched_item", "_item")
    out = exact.join(close, row_id, "left").withColumns({
        "stage": F.coalesce("stage", F.when(F.col("similarity") >= sure, 4).when(F.col("similarity") >= least, 5), F.lit(6)),
        "matched_item": F.coalesce("matched_item", "_item")})
    out = out.withColumn("confidence", F.coalesce("confidence", F.when(F.col("stage") == 4, "medium").when(
        F.col(text) != "", "low").otherwise("medium"))).drop("_item")
    warnings = out.filter((F.col("stage") >= 3) & (F.col(text) != "")).select(
        row_id, F.element_at(F.array(*[F.lit(s) for s in (
            "text of another group", "matched by similarity", "uncertain similarity", "no confident match")]), F.col("stage") - 2).alias("warning"))
    return out, warnings


def containment_join(needles: DataFrame, titles: DataFrame, needle: str, title: str, order) -> DataFrame:
    """First title (by ``order``) that contains the needle or lies inside it.

    A contained text shares every one of its grams, so each short side is joined on its single
    rarest gram: an equi-join without loss. Texts under three characters are their own gram.
    """
    def grams(c: Column, q: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (q - 1)), lambda i: F.substr(c, i, F.lit(q))))

    def tagged(c: Column) -> Column:
        """Grams of size 3, 2 and 1, as far as the text is long enough."""
        parts = [F.when(F.length(c) >= q, grams(c, q)).otherwise(F.array().cast("array<string>")) for q in (3, 2, 1)]
        return F.flatten(F.array(*parts))

    own = lambda c: F.when(F.length(c) >= 3, grams(c, 3)).otherwise(F.array(c))

    def inside(short: DataFrame, s: str, long: DataFrame, lo: str) -> DataFrame:
        spread = long.select(lo, F.explode(tagged(F.col(lo))).alias("_g"))
        counts = spread.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
        rare = short.select(s, F.explode(own(F.col(s))).alias("_g")).join(counts, "_g", "left").groupBy(s).agg(
            F.min_by("_g", F.struct(F.coalesce("_n", F.lit(0).cast("long")), F.col("_g"))).alias("_g"))
        return rare.join(spread, "_g").filter(F.col(lo).contains(F.col(s))).select(F.col(s), F.col(lo))

    asked = needles.select(needle).filter(F.col(needle) != "").distinct()
    known = titles.select(title).filter(F.col(title) != "").distinct()
    pairs = inside(asked, needle, known, title).unionByName(inside(known, title, asked, needle)).distinct()
    return best_row(pairs.join(titles, title), [needle], order)


def jaccard_best(rows: DataFrame, ref: DataFrame, row_id: str, block: str, tokens: str, ref_id: str, threshold: float = 0.58,
                 k: int = 4) -> DataFrame:
    """The k most similar reference rows of the same block by token Jaccard.

    Distinct token sets are compared once, candidates share one of the elements a match must share,
    and at most k reference rows per set are kept before the join back to the rows.
    """
    key = F.array_join(F.array_sort(F.array_distinct(tokens)), " ")
    asked = rows.select(row_id, block, key.alias("_q"))
    known = top_n(ref.select(ref_id, block, key.alias("_t")), [block, "_t"], [F.col(ref_id)], k, "_r").drop("_r")
    # Any fixed order of the elements serves the prefix filter; the hash spreads the join keys.
    ordered = lambda c: F.transform(F.array_sort(F.transform(F.split(c, " "), lambda e: F.struct(F.xxhash64(e).alias("h"), e.alias("e")))), lambda s: s["e"])
    need = lambda c: (F.size(c) - F.ceil(F.lit(threshold) * F.size(c) - F.lit(1e-9)) + 1).cast("int")
    left = asked.select(block, "_q").distinct().withColumn("_s", ordered(F.col("_q")))
    right = known.select(block, "_t").distinct().withColumn("_u", ordered(F.col("_t")))
    a = left.select(block, "_q", "_s", F.explode(F.slice("_s", F.lit(1), need(F.col("_s")))).alias("_e"))
    b = right.select(block, "_t", "_u", F.explode(F.slice("_u", F.lit(1), need(F.col("_u")))).alias("_e"))
    pairs = a.join(b, [block, "_e"]).select(block, "_q", "_t", jaccard(F.col("_s"), F.col("_u")).alias("similarity"))
    close = pairs.filter(F.col("similarity") >= threshold).distinct()
    best = top_n(close.join(known, [block, "_t"]), [block, "_q"], [F.col("similarity").desc(), F.col(ref_id)], k, "place")
    return asked.join(best, [block, "_q"]).select(row_id, ref_id, "similarity", "place")


def _counts(texts: list[str]) -> np.ndarray:
    return np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) % 32, minlength=32) for t in texts]).astype(np.int32)


def _best_title(keys: list[str], titles: list[str], least: float):
    """(key, title, similarity) of the best of the sorted ``titles`` by the larger of sequence ratio and token overlap, if at ``least``.

    Titles are tried by falling upper bound of both, from character classes and tokens, until no bound is over the best so far.
    """
    sets, counts, sizes = [set(t.split()) for t in titles], _counts(titles), np.array([len(t) for t in titles])
    holders: dict[str, list[int]] = {}
    for i, own in enumerate(sets):
        for token in own:
            holders.setdefault(token, []).append(i)
    out = []
    for key, own in zip(keys, _counts(keys)):
        mine, best, score = set(key.split()), None, least
        shared = np.bincount(np.array([i for t in mine for i in holders.get(t, ())], np.int64), minlength=len(titles))
        overlap = shared / np.maximum(1, len(mine) + np.array([len(s) for s in sets]) - shared)
        bound = np.maximum(overlap, 2.0 * np.minimum(counts, own).sum(1) / np.maximum(1, sizes + len(key)))
        for i in np.lexsort((np.arange(len(titles)), -bound)):
            if bound[i] < score:
                break
            m = SequenceMatcher(None, key, titles[i])
            value = max(float(overlap[i]), m.ratio() if m.quick_ratio() >= score else 0.0)
            if value > score or (value == score and (best is None or i < best)):
                best, score = int(i), value
        if best is not None:
            out.append((key, titles[best], score))
    return out


def similar_title(needles: DataFrame, titles: DataFrame, needle: str, title: str, least: float = 0.54, block: int = 500, tile: int = 20_000) -> DataFrame:
    """(needle, title, similarity) of the best title; the first by name at a tie.

    Needles are dealt to blocks and titles to tiles by hash, each one row; a block and a tile are compared in one task, and the best
    of all tiles stays. Neither side goes through the driver.
    """
    asked = needles.select(F.col(needle).alias("_x")).filter("_x <> ''").distinct()
    known = titles.select(F.col(title).alias("_x")).filter("_x <> ''").distinct()

    def packed(df, most, number, name):
        size = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / most)).cast("int").alias("_parts"))
        dealt = df.crossJoin(F.broadcast(size))  # one row
        return dealt.groupBy(F.pmod(F.xxhash64("_x"), F.col("_parts")).cast("int").alias(number), "_parts").agg(F.sort_array(F.collect_list("_x")).alias(name))

    tiles = packed(known, tile, "_tile", "_titles")
    count = tiles.agg(F.max("_parts").alias("_n"))
    blocks = packed(asked, block, "_block", "_keys").crossJoin(F.broadcast(count)).filter("_n is not null")  # one row
    pairs = blocks.select("_keys", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_tile")).join(tiles, "_tile").select("_keys", "_titles")

    def run(batches):
        for pdf in batches:
            for keys, names in zip(pdf["_keys"], pdf["_titles"]):
                yield pd.DataFrame(_best_title(list(keys), list(names), least), columns=[needle, title, "similarity"])

    found = pairs.mapInPandas(run, f"{needle} string, {title} string, similarity double")
    return best_row(found, [needle], [F.col("similarity").desc(), F.col(title)])


def by_variant(requests: DataFrame, names: DataFrame, request: str) -> DataFrame:
    """First entity with a name whose singular or plural form equals one of the request's."""
    order = [F.col("place"), F.col("entity")]
    mine = requests.select(request, F.explode(X.title_variants(F.col(request))).alias("variant"))
    theirs = names.select("entity", "place", F.explode(X.title_variants(F.col("name"))).alias("variant"))
    return best_row(mine.join(best_row(theirs, ["variant"], order), "variant"), [request], order).select(request, "entity")


def resolve_aliases(requests: DataFrame, titles: DataFrame, request: str, preferred: DataFrame | None = None) -> DataFrame:
    """Official title, preference, alias, containment, similarity: the first stage that finds something.

    ``titles`` holds (entity, name, official, place): every name of an entity, its official title
    flagged, and the entity order that settles ties. ``preferred`` holds (key, entity).
    """
    asked = requests.select(request).distinct().withColumn("key", X.title_key(F.col(request)))
    names = titles.withColumn("name_key", X.title_key(F.col("name")))
    stages = [(by_variant(asked, titles.filter("official"), request), "official_title_exact", 0.99)]
    if preferred is not None:
        stages.append((asked.join(preferred, "key").select(request, "entity"), "preferred_title", 0.88))
    stages.append((by_variant(asked, titles.filter("NOT official"), request), "alias_exact", 0.94))
    out = asked
    for i, (found, _, _) in enumerate(stages):
        out = out.join(found.withColumnRenamed("entity", f"_e{i}"), request, "left")
    open_ = out.filter(F.coalesce(*[F.col(f"_e{i}") for i in range(len(stages))]).isNull()).select(request, "key")
    partial = containment_join(open_, names.select("name_key", "entity", "place"), "key", "name_key", [F.col("place"), F.col("entity"), F.col("name_key")])
    partial = partial.select("key", F.col("entity").alias("_partial"))
    last = open_.join(partial, "key", "left_anti")
    close = similar_title(last, names, "key", "name_key").join(
        best_row(names, ["name_key"], [F.col("place"), F.col("entity")]).select("name_key", F.col("entity").alias("_close")), "name_key")
    out = out.join(partial, "key", "left").join(close.select("key", "_close", "similarity"), "key", "left")
    method, score = F.lit("unresolved"), F.lit(0.0)
    method = F.when(F.col("_close").isNotNull(), "title_similarity").otherwise(method)
    score = F.when(F.col("_close").isNotNull(), F.least(F.lit(0.80), F.greatest(F.lit(0.55), F.col("similarity")))).otherwise(score)
    method = F.when(F.col("_partial").isNotNull(), "alias_partial").otherwise(method)
    score = F.when(F.col("_partial").isNotNull(), 0.82).otherwise(score)
    for i, (_, name, value) in reversed(list(enumerate(stages))):
        method = F.when(F.col(f"_e{i}").isNotNull(), name).otherwise(method)
        score = F.when(F.col(f"_e{i}").isNotNull(), value).otherwise(score)
    return out.select(request, F.coalesce(*[F.col(f"_e{i}") for i in range(len(stages))], "_partial", "_close").alias("entity"),
                      method.alias("method"), F.round(score, 2).alias("confidence"))
