"""Exact ranked lexical search by sparse ball trees.

Texts and queries are sparse vectors over the queries' terms. An entry of a document is w * ((10^9 tf) div (1000 tf + 20 m)), an integer, where m
grows with the document's length; a query is 1 at its terms, so the inner product is the score. Scores are whole numbers below 2^53.

1. *Count.* One pass over the texts finds term frequencies of the queries' terms and lengths; Spark sums N, L and df over the written rows.
2. *Trees.* A task cuts its documents into chunks and builds a ball tree over each: a node is split between two far apart documents at the
   median of the difference of the distances, and keeps its centroid (sparse) and the largest distance from it.
3. *Search.* No document of a ball scores more than q.c + |q| r, by the Cauchy-Schwarz inequality; of q only the terms that the ball's
   documents hold count in |q|. Centroid products and radii are rounded up by more than the floating-point error can be. A query
   visits nodes by falling bound and stops at the first that is below its k-th score so far, also from earlier chunks; documents of
   visited leaves are scored in integers.
4. *Merge.* Each task returns its k best a query; the best of all tasks are taken in two rounds, so no task gets a query's whole list.

Queries are a stated query set. They go past the documents in blocks of at most ``ITEMS``, each collected and sent to the tasks.

Terms are runs of letters a-z, digits and characters beyond ASCII, where only A-Z are lower-cased.

Defined results: null and empty texts have no terms; queries without terms, and those that no document meets, give no rows; a term counts once a
query. Equal scores go by ascending document id. Repeated rows of a document are documents of their own; rows without an id are none.
Repeated rows of a query id are one query (its smallest text). Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierspark.llm.rows import give_back, quoted, with_columns
from dossierspark.operators.ranking import top_n
from dossierspark.session import durable

#: Queries of one block, documents of a chunk and of a leaf, and into how many parts a query's hits are dealt before the last round.
ITEMS, CHUNK, LEAF, DEAL = 20_000, 4096, 32, 64
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """The terms of UTF-8 ``text``; bytes beyond ASCII belong to characters beyond it."""
    return text.translate(_TERM).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def counted(docs: DataFrame, id_: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(_doc, _n, _terms, _tf): length in terms, and frequency of each vocabulary term, of every document."""
    def make():
        def fn(column):
            get, n, at, tf, stops = vocabulary.get, [], [], [], [0]
            column = column.cast(pa.binary())
            for i in range(len(column)):
                words = terms(column[i].as_py() or b"")
                n.append(len(words))
                found = np.fromiter((k for k in map(get, words) if k is not None), np.int32)
                own, times = np.unique(found, return_counts=True)
                at.append(own)
                tf.append(times)
                stops.append(stops[-1] + len(own))
            offsets = pa.array(np.array(stops, np.int32))
            flat = lambda parts, kind: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*parts, np.empty(0, kind)]).astype(kind)))
            return [pa.array(n, pa.int64()), flat(at, np.int32), flat(tf, np.int64)]
        return fn

    source = docs.filter(quoted(id_).isNotNull()).select(quoted(id_).cast("long").alias("_doc"), quoted(text).alias("_text"))
    return with_columns(source, ["_text"], "_n long, _terms array<int>, _tf array<long>", make, ("_text",))


@dataclass
class Chunk:
    """Documents as rows of a sparse matrix: row i has terms[start[i]:start[i + 1]] and as many whole-number values."""
    ids: np.ndarray
    start: np.ndarray
    terms: np.ndarray
    values: np.ndarray

    def take(self, rows: np.ndarray) -> "Chunk":
        sizes = np.diff(self.start)[rows]
        at = np.repeat(self.start[:-1][rows] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        return Chunk(self.ids[rows], np.concatenate([[0], np.cumsum(sizes)]), self.terms[at], self.values[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Products of all rows with a vector; every row has an entry."""
        return np.add.reduceat(self.values * dense[self.terms], self.start[:-1]) if len(self.ids) else np.empty(0)

    def norms(self) -> np.ndarray:
        v = self.values.astype(float)
        return np.add.reduceat(v * v, self.start[:-1])


@dataclass
class Node:
    first: int
    stop: int
    centre_terms: np.ndarray
    centre: np.ndarray
    radius: float
    children: tuple[int, int] | None


def ball_tree(rows: Chunk, n_terms: int, leaf: int = LEAF) -> tuple[Chunk, list[Node]]:
    """``rows`` in the order of the tree's leaves, and its nodes; the root is the first. Radii are upper bounds."""
    norms = rows.norms()
    order = np.arange(len(rows.ids))
    nodes: list[Node] = []
    scratch = np.zeros(n_terms)

    def node(first: int, stop: int) -> int:
        own = order[first:stop]
        part = rows.take(own)
        sums = np.bincount(part.terms, part.values, n_terms)
        at = np.flatnonzero(sums)
        centre = sums[at] / len(own)
        scratch[at] = centre
        square = float(centre @ centre)
        apart = norms[own] - 2 * part.dot(scratch) + square
        # The error of these sums is far below 1e-9 of their terms.
        radius = math.sqrt(max(0.0, float((apart + 1e-9 * (norms[own] + square)).max()))) * (1 + 1e-9)
        scratch[at] = 0
        place = len(nodes)
        nodes.append(Node(first, stop, at, centre, radius, None))
        if len(own) > leaf:
            def distances(i: int) -> np.ndarray:
                lo, hi = rows.start[own[i]], rows.start[own[i] + 1]
                scratch[rows.terms[lo:hi]] = rows.values[lo:hi]
                out = norms[own] - 2 * part.dot(scratch) + norms[own[i]]
                scratch[rows.terms[lo:hi]] = 0
                return out

            a = int(apart.argmax())
            from_a = distances(a)
            side = from_a - distances(int(from_a.argmax()))
            middle = first + len(own) // 2
            order[first:stop] = own[np.argsort(side, kind="stable")]
            nodes[place].children = node(first, middle), node(middle, stop)
        return place

    node(0, len(order))
    return rows.take(order), nodes


class Queries:
    """Term lists of the queries, and for each term the queries that hold it."""

    def __init__(self, lists: list[np.ndarray], n_terms: int):
        self.lists = lists
        flat = np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)
        of = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
        order = np.argsort(flat, kind="stable")
        self.holders = of[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=n_terms))])

    def bounds(self, v: Node) -> np.ndarray:
        """What no document of a ball scores more than, for every query."""
        at = v.centre_terms
        sizes = (self.start[at + 1] - self.start[at])
        ends = np.cumsum(sizes)
        place = np.repeat(self.start[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        own = self.holders[place]
        product, norm = np.bincount(own, np.repeat(v.centre, sizes), len(self.lists)), np.sqrt(np.bincount(own, minlength=len(self.lists)))
        return (product + v.radius * norm) * (1 + 1e-9) + 1.0


class Best:
    """The k best (score, smallest id) of every query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.empty(0, np.int64) for _ in range(n)]
        self.ids = [np.empty(0, np.int64) for _ in range(n)]

    def least(self, q: int) -> int:
        return int(self.score[q][-1]) if len(self.score[q]) == self.k else 1

    def add(self, q: int, ids: np.ndarray, score: np.ndarray) -> None:
        good = score >= self.least(q)
        if good.any():
            ids, score = np.concatenate([self.ids[q], ids[good]]), np.concatenate([self.score[q], score[good]])
            order = np.lexsort((ids, -score))[:self.k]
            self.ids[q], self.score[q] = ids[order], score[order]


def search(rows: Chunk, nodes: list[Node], queries: Queries, best: Best, n_terms: int) -> int:
    """Adds the documents of one tree to ``best``; how many leaves were scored."""
    bounds = np.stack([queries.bounds(v) for v in nodes])
    member = np.zeros(n_terms, np.int64)
    scored = 0
    for q, own in enumerate(queries.lists):
        if not len(own) or bounds[0, q] < best.least(q):
            continue
        member[own] = 1
        column = bounds[:, q]
        heap = [(-column[0], 0)]
        while heap:
            bound, i = heapq.heappop(heap)
            if -bound < best.least(q):
                break
            v = nodes[i]
            if v.children:
                for c in v.children:
                    if column[c] >= best.least(q):
                        heapq.heappush(heap, (-column[c], c))
                continue
            lo, hi = rows.start[v.first], rows.start[v.stop]
            score = np.add.reduceat(rows.values[lo:hi] * member[rows.terms[lo:hi]], rows.start[v.first:v.stop] - lo)
            best.add(q, rows.ids[v.first:v.stop], score)
            scored += 1
        member[own] = 0
    return scored


def _chunk_of(batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms_all: int) -> Chunk:
    """A chunk of the rows of ``batch`` that hold a term of positive weight."""
    ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    lists = batch.column(2)
    sizes = np.asarray(lists.value_lengths())
    at = lists.flatten().to_numpy().astype(np.int64)
    tf = batch.column(3).flatten().to_numpy()
    m = np.repeat(100 - 50 + (50 * n * n_docs) // max(n_terms_all, 1), sizes)
    values = weights[at] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
    row = np.repeat(np.arange(len(ids)), sizes)
    good = values > 0
    row, at, values = row[good], at[good], values[good]
    count = np.bincount(row, minlength=len(ids))
    full = count > 0
    return Chunk(ids[full], np.concatenate([[0], np.cumsum(count[full])]), at, values)


def _hits(vectors: DataFrame, queries: Queries, names: list[int], weights: np.ndarray, n_docs: int, length: int, k: int, query_id: str) -> DataFrame:
    n_terms = len(weights)
    schema = pa.schema([(query_id, pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        best = Best(len(names), k)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                rows = _chunk_of(batch.slice(at, CHUNK), weights, n_docs, length)
                if len(rows.ids):
                    search(*ball_tree(rows, n_terms), queries, best, n_terms)
        for q, name in enumerate(names):
            if len(best.ids[q]):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids[q]), name)), pa.array(best.ids[q]), pa.array(best.score[q])], schema=schema)
        best = None
        give_back()

    return vectors.filter(F.size("_terms") > 0).select("_doc", "_n", "_terms", "_tf").mapInArrow(run, f"`{query_id}` long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id_: str = "doc_id", text: str = "text", query_id: str = "item_id",
         query_text: str = "text", block: int = ITEMS) -> DataFrame:
    """(query id, rank, doc_id, score) of the k best documents of every query."""
    spark = docs.sparkSession
    clean = items.filter(quoted(query_id).isNotNull() & quoted(query_text).isNotNull()).groupBy(quoted(query_id).cast("long").alias("_id")).agg(
        F.min(quoted(query_text)).alias("_text"))
    blocks = -(-clean.count() // block)
    found = None
    for b in range(blocks):
        part = sorted((r["_id"], r["_text"]) for r in clean.filter(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b).collect())
        vocabulary: dict[bytes, int] = {}
        lists = [np.unique([vocabulary.setdefault(t, len(vocabulary)) for t in terms(x.encode("utf-8", "replace"))]).astype(np.int64) for _, x in part]
        vectors = durable(counted(docs, id_, text, vocabulary))
        n_docs, length = vectors.agg(F.count_if(F.col("_n") > 0), F.coalesce(F.sum("_n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("_terms").alias("t")).groupBy("t").count().collect():  # a row a term of the queries
            df[r["t"]] = r["count"]
        weights = np.array([weight(n_docs, d) if d else 0 for d in df.tolist()], np.int64)
        hits = _hits(vectors, Queries(lists, len(vocabulary)), [i for i, _ in part], weights, n_docs, length, k, query_id)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return spark.createDataFrame([], f"`{query_id}` long, rank int, doc_id long, score long")
    order = [F.col("score").desc(), F.col("doc_id")]
    dealt = top_n(found.withColumn("_deal", F.pmod(F.xxhash64("doc_id"), F.lit(DEAL))), [query_id, "_deal"], order, k)
    return top_n(dealt.drop("rank", "_deal"), [query_id], order, k).select(quoted(query_id), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
