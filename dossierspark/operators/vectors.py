"""Exact and approximate nearest neighbours between two tables of vectors.

Both sides are packed: rows of an entity are dealt by a hash of their id to blocks of about ``BLOCK`` queries and tiles of about ``TILE``
corpus rows, each one row with its ids and its vectors. Blocks and tiles of an entity meet by an equi-join; one pair is one matrix product, which
emits k rows a query. Nothing goes through the driver, the plan is the same for any number of queries, and an entity with a third of all
rows is only more tiles. Vectors are shuffled once for packing, and blocks once more for each tile of their entity.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Queries of a block, corpus rows of a tile, and queries of one matrix product inside a task.
BLOCK, TILE, SLICE = 2048, 8192, 256
#: Bound of the rows that the centres of the inverted lists are fitted on, and of the queries that tell how many lists to probe.
FIT_ROWS, FIT_QUERIES = 20_000, 200


def _sized(df: DataFrame, of: DataFrame, entity: list[str]) -> DataFrame:
    """``df`` with ``_n``, how many rows of ``of`` its entity has; without an entity one number for all, a scalar subquery."""
    count = F.count(F.lit(1)).alias("_n")
    return df.join(of.groupBy(*entity).agg(count), entity) if entity else df.withColumn("_n", of.agg(count).scalar())


def _packed(rows: DataFrame, entity: list[str], id_: str, vec: str, number: str, most: int, name: str) -> DataFrame:
    """One row per (entity, number) with the array ``name`` of (id, vec)."""
    dealt = _sized(rows, rows, entity).withColumn(number, F.pmod(F.xxhash64(id_), F.ceil(F.col("_n") / most)).cast("int"))
    return dealt.groupBy(*entity, number).agg(F.collect_list(F.struct(F.col(id_).alias("id"), F.col(vec).alias("vec"))).alias(name))


def packed_side(column: pa.Array, row: int) -> tuple[pa.Array, np.ndarray]:
    items = column[row].values
    vectors = items.field("vec")
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return items.field("id"), flat.reshape(len(vectors), -1)


def _rough(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        norm = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]
        return 1.0 - (q @ c.T) / norm
    return (q**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2.0 * (q @ c.T)


def _exact(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances of one query; they do not depend on which rows are compared together."""
    if metric == "cosine":
        return 1.0 - (c * q).sum(1) / np.sqrt((c * c).sum(1) * (q * q).sum())
    return ((c - q) ** 2).sum(1)


def nearest(q: np.ndarray, c: np.ndarray, ids: np.ndarray, k: int, metric: str):
    """(row of q, row of c, distance) of the k nearest rows of ``c`` for each row of ``q``; equal distances go by id."""
    rows, cols, dist = [], [], []
    slack = 1e-9 * (1.0 if metric == "cosine" else 1.0 + float((q**2).sum(1).max(initial=0.0)) + float((c**2).sum(1).max(initial=0.0)))
    for lo in range(0, len(q), SLICE):
        # The matrix product picks candidates with some slack, their distances are then exact.
        rough = _rough(q[lo:lo + SLICE], c, metric)
        limit = np.partition(rough, k - 1, axis=1)[:, k - 1] if k < len(c) else np.full(len(rough), np.inf)
        for i, row in enumerate(rough):
            near = np.flatnonzero(row <= limit[i] + slack)
            exact = _exact(q[lo + i], c[near], metric)
            order = np.lexsort((ids[near], exact))[:k]
            rows.append(np.full(len(order), lo + i))
            cols.append(near[order])
            dist.append(exact[order])
    return np.concatenate([*rows, np.empty(0, int)]), np.concatenate([*cols, np.empty(0, int)]), np.concatenate([*dist, np.empty(0)])


def pair_search(queries: DataFrame, corpus: DataFrame, qid: str, cid: str, vec: str, k: int, metric: str = "l2sq", within: str | None = None,
                block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(qid, cid, distance): at least the k nearest corpus rows per query, k from every tile that the query meets.

    Rows with a null id, vector or entity meet nothing. A query that stands in several entities meets the rows of each.
    """
    entity = ["_entity"] if within else []
    key = [F.col(within).alias("_entity")] if within else []
    q = queries.select(*key, F.col(qid), F.col(vec)).dropna()
    c = corpus.select(*key, F.col(cid), F.col(vec)).dropna()
    tiles = _packed(c, entity, cid, vec, "_tile", tile, "_corpus")
    blocks = _packed(q, entity, qid, vec, "_block", block, "_queries")
    last = F.ceil(F.col("_n") / tile).cast("int") - 1
    spread = _sized(blocks, c, entity).filter("_n > 0").withColumn("_tile", F.explode(F.sequence(F.lit(0), last)))
    key = [*entity, "_tile", "_block"]
    pairs = spread.join(tiles, [*entity, "_tile"]).select(*key, "_queries", "_corpus")
    names = [qid, cid, "distance"]
    kinds = dict(queries.dtypes)[qid], dict(corpus.dtypes)[cid]
    schema = f"`{qid}` {kinds[0]}, `{cid}` {kinds[1]}, distance double"
    types = to_arrow_schema(T.StructType.fromDDL(schema)).types

    def run(pair: pa.Table) -> pa.Table:
        parts = []
        for batch in pair.select(["_queries", "_corpus"]).to_batches():
            for row in range(batch.num_rows):
                (qids, q_vecs), (cids, c_vecs) = packed_side(batch.column(0), row), packed_side(batch.column(1), row)
                a, b, d = nearest(q_vecs, c_vecs, np.array(cids.to_pylist()), k, metric)
                parts.append([qids.take(pa.array(a)), cids.take(pa.array(b)), pa.array(d)])
        return pa.table([pa.chunked_array([p[i] for p in parts], types[i]) for i in range(3)], names=names)

    # One pair of a block and a tile a call: in Arrow batches by number of rows, all pairs of a task would stand in Python at once.
    return pairs.groupBy(*key).applyInArrow(run, schema)


class Lists:
    """Centres of inverted lists and how many of the nearest lists a search probes. ``recall`` is what the sample found with that many."""

    def __init__(self, centres: np.ndarray, probes: int, recall: float):
        self.centres, self.probes, self.recall = centres, probes, recall

    def near(self, vec: Column, n: int) -> Column:
        """Numbers of the ``n`` nearest lists of a vector, nearest first."""
        centres, width = self.centres, min(n, len(self.centres))

        @F.pandas_udf("array<int>")
        def places(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_list()).astype(np.float64)
            order = np.argsort(_rough(x, centres, "l2sq"), axis=1, kind="stable")[:, :width]
            return pd.Series(list(order.astype(np.int32)))

        return places(vec)


def k_means(x: np.ndarray, n: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[np.sort(rng.choice(len(x), n, replace=False))]
    for _ in range(rounds):
        own = np.concatenate([_rough(x[lo:lo + 4096], centres, "l2sq").argmin(1) for lo in range(0, len(x), 4096)])
        counts = np.bincount(own, minlength=n)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit_lists(corpus: DataFrame, cid: str, vec: str, k: int, lists: int | None = None, recall: float = 0.97, rows: int = FIT_ROWS,
              sample_queries: int = FIT_QUERIES) -> Lists:
    """Lists fitted on at most ``rows`` rows, in the order of a hash of their id; by default as many lists as the root of the sample.

    The sample also tells the number of probes: the smallest with which its first ``sample_queries`` rows find the share ``recall`` of their k
    nearest neighbours in the sample.
    """
    taken = corpus.select(cid, vec).dropna().orderBy(F.xxhash64(cid), cid).limit(rows).collect()
    if not taken:
        return Lists(np.zeros((1, 1)), 1, 1.0)
    x = np.array([r[1] for r in taken], dtype=np.float64)
    n = min(len(x), lists or max(1, int(len(x) ** 0.5)))
    centres = k_means(x, n)
    own = _rough(x, centres, "l2sq").argmin(1)
    asked = x[:sample_queries]
    row, col, _ = nearest(asked, x, np.arange(len(x)), min(k, len(x)), "l2sq")
    order = np.argsort(_rough(asked, centres, "l2sq"), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[None, :], axis=1)
    needed = np.sort(place[row, own[col]]) + 1  # of each true neighbour, the probes that reach its list
    probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    return Lists(centres, probes, float((needed <= probes).mean()))


def list_search(queries: DataFrame, corpus: DataFrame, qid: str, cid: str, vec: str, k: int, fitted: Lists) -> DataFrame:
    """(qid, cid, distance) as ``pair_search``, but each query meets only the rows of the lists it probes. Every corpus row is in one list."""
    held = corpus.select(cid, vec).dropna().withColumn("_list", F.get(fitted.near(F.col(vec), 1), F.lit(0)))
    asked = queries.select(qid, vec).dropna().withColumn("_list", F.explode(fitted.near(F.col(vec), fitted.probes)))
    return pair_search(asked, held, qid, cid, vec, k, within="_list")
