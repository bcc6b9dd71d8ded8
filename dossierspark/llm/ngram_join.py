"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when their sets of word shingles have a Jaccard similarity of at least num/den. All filters lose no link:

1. *Hash prefix.* In the order of the hashes, a document of n shingles keeps its first n - c + l, where c = ceil(n num/den) is
   what it must share with a partner and l is about a tenth of n. Linked documents share at least l of these (the smaller l), so
   a document that shares fewer with all others together has no partner.
2. *Copies.* Documents with equal sets are one class; only its first document goes on.
3. *Shared.* A document that shares fewer than c of its whole set with all others together has no partner.
4. *Adaptive prefix.* A document sorts its shared tokens by rising frequency. Of p tokens with c needed ones, the first p - c + m
   hold m needed ones. m is 1 where the tokens are rare and grows with their mean frequency, the estimated number of candidates,
   so that costly prefixes get longer. With k the smaller m of a pair, the k first common tokens of a link lie in both prefixes,
   so a pair with fewer common prefix tokens is not verified.
5. *Hubs first.* Each token's documents are compared with its most central one, which a family of near copies mostly
   links to; the components of these links are contracted, and only pairs of different components remain to be found.
6. Tokens of up to ``COMMON`` documents give these pairs by a join, ``COMMON`` rows a token row at most. Prefix tokens that take no part in
   it, since they are more frequent or of one component only, are counted as common before a pair is refused. For more frequent tokens, the documents of a
   hub are dealt to tiles, and pairs of tiles count common tokens as matrix products. Such a product emits one link for a
   document and other component at most, so that no group becomes all its pairs; its arithmetic grows with the square of what
   stays apart in a family.
7. Pairs are verified on whole shingle sets.

Defined results: documents without words or with null text are linked with nothing (0 shingles, own class); fewer words than a
shingle are one shingle; repeated rows of an id count as one document, that of the smallest text that is not null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierspark.llm.rows import checked_broadcast, quoted, with_columns
from dossierspark.llm.shingles import WordHashes, plain_words, shingle_set
from dossierspark.operators.groups import components
from dossierspark.operators.ranking import best_row
from dossierspark.session import durable

#: Hubs of rare tokens that a document is compared with. Only speed depends on it.
STARS = 3
#: Documents of a token up to which pairs come from a join, and of a tile beyond.
COMMON, TILE = 64, 512
#: Copies of a text beyond which its class is looked up by broadcast, if the table of such classes is small enough, and not by shuffle.
HOT_CLASS = 1000


def needed(n, num: int, den: int):
    """What a set of n must share with any partner at num/den."""
    return (n * num + den - 1) // den


def matches(n):
    """l: common tokens of the hash prefixes that a link must have."""
    return (n + 9) // 10


def _longs(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.empty(0, np.int64)])))


def sketch(docs: DataFrame, id_: str, text: str, num: int, den: int, words: Callable = plain_words) -> DataFrame:
    """(id, n_shingles, two fingerprints of the set, hash prefix) of every document."""
    def make():
        known = WordHashes()

        def fn(column):
            sets = [shingle_set(words(column[i].as_py()), known) for i in range(len(column))]
            sizes = np.array([len(s) for s in sets], np.int64)
            with np.errstate(over="ignore"):
                sums = [int(s.sum()) for s in sets]
                mixes = [int(((s ^ (s >> 29)) * np.int64(-7046029254386353131)).sum()) for s in sets]
            return [pa.array(sizes), pa.array(sums, pa.int64()), pa.array(mixes, pa.int64()),
                    _longs([s[:len(s) - needed(len(s), num, den) + matches(len(s))] for s in sets])]
        return fn

    return with_columns(docs.select(F.col(id_).alias("id"), F.col(text).alias("_text")), ["_text"],
                        "n long, f1 long, f2 long, prefix array<long>", make, ("_text",))


def _whole_sets(docs: DataFrame, id_: str, text: str, words: Callable) -> DataFrame:
    def make():
        known = WordHashes()
        return lambda column: [_longs([shingle_set(words(column[i].as_py()), known) for i in range(len(column))])]

    return with_columns(docs.select(F.col(id_).alias("id"), F.col(text).alias("_text")), ["_text"], "shingles array<long>", make, ("_text",))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    a = sets.select(F.col("id").alias("id_a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("id_b"), F.col("shingles").alias("sb"))
    both = pairs.join(a, "id_a").join(b, "id_b").withColumn("same", F.size(F.array_intersect("sa", "sb")))
    return both.filter(den * F.col("same") >= num * (F.size("sa") + F.size("sb") - F.col("same"))).select("id_a", "id_b")


def _across(families: DataFrame, ranked: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components of a hub's documents: of each document with each other component of a pair of tiles, one."""
    tiles = (families.groupBy("hub").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
             .select("hub", F.ceil(F.col("c") / TILE).cast("int").alias("tiles")))
    rows = (families.join(tiles, "hub").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            .withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other"))
            .join(ranked.select("id", "n", "tokens"), "id")
            .select("hub", "low", "high", "tile", "id", "comp", "n", "tokens"))

    def counted(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_links(pdf, num, den)

    return rows.groupBy("hub", "low", "high").applyInPandas(counted, "id_a long, id_b long")


def _tile_links(pdf: pd.DataFrame, num: int, den: int) -> pd.DataFrame:
    low, high = pdf["low"].iat[0], pdf["high"].iat[0]
    tokens, ids, comp, n, tile = list(pdf["tokens"]), pdf["id"].to_numpy(), pdf["comp"].to_numpy(), pdf["n"].to_numpy(), pdf["tile"].to_numpy()
    names, counts = np.unique(comp, return_counts=True)
    # Pairs inside the largest component are settled, so one side is always outside it.
    left = np.flatnonzero(comp != names[counts.argmax()])
    out = []
    if len(names) > 1:
        flat = np.concatenate(tokens)
        vocabulary, code = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(ids)), [len(t) for t in tokens])
        same = np.zeros((len(left), len(ids)), np.float32)
        place = np.full(len(ids), -1)
        place[left] = np.arange(len(left))
        for lo in range(0, len(vocabulary), 8192):
            inside = (code >= lo) & (code < lo + 8192)
            every = np.zeros((len(ids), min(8192, len(vocabulary) - lo)), np.float32)
            every[row[inside], code[inside] - lo] = 1
            same += every[left] @ every.T
        linked = den * same >= num * (n[left][:, None] + n[None, :] - same)
        linked &= comp[left][:, None] != comp[None, :]
        if low != high:
            linked &= tile[left][:, None] != tile[None, :]
        for a, b in zip(*np.nonzero(linked)):
            out.append((comp[left[a]], comp[b], ids[left[a]], ids[b]))
    found = pd.DataFrame(out, columns=["ca", "cb", "id_a", "id_b"]).drop_duplicates(["id_a", "cb"])
    return found[["id_a", "id_b"]].astype("int64")


def _once(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """(id, text) with one row an id, that of the smallest text; rows without an id go."""
    rows = docs.select(quoted(id_).alias(id_), quoted(text).alias(text)).filter(F.col(id_).isNotNull())
    repeated = durable(rows.groupBy(id_).count().filter("count > 1").select(id_))
    if not repeated.limit(1).count():
        return rows
    few = checked_broadcast(repeated)
    return rows.join(few, id_, "left_anti").unionByName(rows.join(few, id_, "left_semi").groupBy(id_).agg(F.min(text).alias(text)))


def _class_members(left: DataFrame) -> DataFrame:
    """(id, rep): the smallest id of the documents with an equal set. Classes of many copies are joined without a shuffle."""
    keys = ["n", "f1", "f2"]
    classes = durable(left.groupBy(*keys).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")))
    hot = checked_broadcast(durable(classes.filter(F.col("copies") > HOT_CLASS).select(*keys, "rep")))
    cold = classes.filter(F.col("copies") <= HOT_CLASS).select(*keys, "rep")
    return left.join(hot, keys).select("id", "rep").unionByName(left.join(hot.select(*keys), keys, "left_anti").join(cold, keys).select("id", "rep"))


def link_components(docs: DataFrame, id_: str = "doc_id", text: str = "text", num: int = 4, den: int = 5,
                    words: Callable = plain_words) -> DataFrame:
    """(id, n_shingles, component_id) of every document; the component is the smallest id reachable by links."""
    close = lambda x, y: den * F.least(x, y) >= num * F.greatest(x, y)
    docs = _once(docs, id_, text)
    drawn = durable(sketch(docs, id_, text, num, den, words))
    known = drawn.select("id", "n", "f1", "f2")
    tokens = drawn.select("id", F.explode("prefix").alias("h"))
    shared = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1).select("h")
    left = durable(tokens.join(shared, "h").groupBy("id").agg(F.count(F.lit(1)).alias("hits")).join(known, "id")
                   .filter(F.col("hits") >= F.floor((F.col("n") + 9) / 10)).drop("hits"))
    member = durable(_class_members(left))
    reps = durable(member.filter(F.col("id") == F.col("rep")).select(F.col("id").alias(id_)))
    sets = durable(_whole_sets(docs.join(checked_broadcast(reps), id_, "left_semi").select(id_, text), id_, text, words))

    spread = sets.select("id", F.explode("shingles").alias("h"))
    shared = spread.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    sizes = sets.select("id", F.size("shingles").alias("n"))
    must = -F.floor(-F.col("n") * num / den).cast("int")
    total = lambda m: F.aggregate(m, F.lit(0.0), lambda s, x: s + x["df"])
    cost = total(F.slice("m", F.lit(1), F.col("base"))) / F.col("base")
    # Written with need and central, so that they are computed once a document and not once a token.
    ranked = durable(spread.join(shared, "h").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("m"))
                     .join(sizes, "id").filter(F.size("m") >= must).withColumn("base", F.size("m") - must + 1)
                     .withColumns({"need": F.least(F.size("m") - F.col("base") + 1, 1 + F.floor(F.log2(cost)).cast("int")), "central": total(F.col("m")) / F.col("n")})
                     .withColumn("tokens", F.transform("m", lambda t: t["h"])).drop("m"))
    index = durable(ranked.select("id", "n", "need", "central", (F.col("base") + F.col("need") - 1).alias("held"), F.explode(F.expr("slice(tokens, 1, base + need - 1)")).alias("h")))

    hubs = index.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("central", (-F.col("id")).alias("minus"), "n")).alias("hub")).filter("c > 1")
    met = (index.join(hubs, "h").withColumn("hub_n", F.col("hub.n")).withColumn("hub", -F.col("hub.minus"))
           .groupBy("id", "hub", "n", "hub_n").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("c") > COMMON).alias("hot")))
    met = durable(met.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("c"), "hub"))))
    star = met.filter((F.col("id") != F.col("hub")) & (F.col("hot") | (F.col("k") <= STARS)) & close(F.col("n"), F.col("hub_n")))
    linked = durable(_verified(star.select(F.col("hub").alias("id_a"), F.col("id").alias("id_b")), sets, num, den))
    comp = durable(components(linked).withColumnRenamed("component", "comp"))

    placed = durable(index.join(hubs.filter(F.col("c") <= COMMON).select("h"), "h").join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("h")
    open_ = durable(placed.join(mixed, "h"))
    # Of the prefix tokens of a document, so many take no part in the join below.
    out = open_.groupBy("id").agg((F.first("held") - F.count(F.lit(1))).alias("out"))
    open_ = durable(open_.join(out, "id"))
    x, y = open_.alias("x"), open_.alias("y")
    pairs = (x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp"))
                    & close(F.col("x.n"), F.col("y.n")))
             .groupBy(F.col("x.id").alias("id_a"), F.col("y.id").alias("id_b"))
             .agg(F.count(F.lit(1)).alias("c"), F.min(F.least("x.need", "y.need") - F.least("x.out", "y.out")).alias("least"))
             .filter(F.col("c") >= F.col("least")).select("id_a", "id_b"))
    families = met.filter("hot").join(comp, "id", "left").select("hub", "id", F.coalesce("comp", "id").alias("comp"))
    more = _verified(pairs, sets, num, den).unionByName(_across(families, ranked, num, den))
    named = lambda side: comp.select(F.col("id").alias(side), F.col("comp").alias(f"c_{side}"))
    more = durable(more.join(named("id_a"), "id_a", "left").join(named("id_b"), "id_b", "left").select(
        F.coalesce("c_id_a", "id_a").alias("id_a"), F.coalesce("c_id_b", "id_b").alias("id_b")).distinct())
    final = comp
    if more.limit(1).count():
        over = components(more).select(F.col("id").alias("comp"), F.col("component").alias("upper"))
        alone = more.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct().join(comp, "id", "left_anti")
        final = (comp.unionByName(alone.withColumn("comp", F.col("id"))).join(over, "comp", "left")
                 .select("id", F.coalesce("upper", "comp").alias("comp")))
    rep = member.join(final.select(F.col("id").alias("rep"), "comp"), "rep", "left").select("id", F.coalesce("comp", "rep").alias("comp"))
    return (known.join(rep, "id", "left")
            .select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), F.coalesce("comp", "id").alias("component_id")))


def keep_first(docs: DataFrame, id_: str = "doc_id", text: str = "text", num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; columns and null ids stay as they are."""
    found = durable(link_components(docs, id_, text, num, den))
    gone = found.filter(F.col(id_) != F.col("component_id")).select(id_)
    kept = docs.join(checked_broadcast(durable(gone)), id_, "left_anti").select(*[quoted(c) for c in docs.columns])
    repeated = durable(docs.filter(F.col(id_).isNotNull()).groupBy(id_).count().filter("count > 1").select(id_))
    if not repeated.limit(1).count():
        return kept
    few = checked_broadcast(repeated)
    first = best_row(kept.join(few, id_, "left_semi").select(*[quoted(c) for c in docs.columns]), [id_], [quoted(text).asc_nulls_last()])
    return kept.join(few, id_, "left_anti").select(*[quoted(c) for c in docs.columns]).unionByName(first)
