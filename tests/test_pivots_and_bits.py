"""Vector links by pivot tiles and texts that share two words, against loops over all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from dossierspark.operators import profiles as P
from dossierspark.operators import similarity as S


def clustered(seed, centres, each, dims=16, noise=0.03):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, dims))
    x = np.repeat(base / np.linalg.norm(base, axis=1, keepdims=True), each, axis=0) + noise * rng.normal(size=(centres * each, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links(x, blocks, threshold):
    sims = x @ x.T
    return {(i, j) for i, j in zip(*np.nonzero(sims >= threshold)) if i < j and blocks[i] == blocks[j]}


def test_vector_links_of_clusters_equal_all_pairs(spark):
    x = clustered(3, 20, 30)
    # One block holds two thirds of the rows, the smaller blocks fit one tile.
    blocks = [0 if i % 3 else 1 + i % 2 for i in range(len(x))]
    df = spark.createDataFrame([(i, blocks[i], v.tolist()) for i, v in enumerate(x)], "id long, b int, v array<double>")
    for threshold in (0.5, 0.9, 0.97):
        got = [(r.id_a, r.id_b) for r in S.vector_pairs(df, "id", "b", "v", threshold, tile=25).collect()]
        assert len(got) == len(set(got)) and set(got) == links(x, blocks, threshold)


def test_far_tiles_do_not_meet(spark):
    x = clustered(5, 16, 40)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, b int, v array<double>")
    pivots = S._pivots(df, "id", "v", 16)
    tiles = S.vector_tiles(df, "id", "b", "v", pivots, 40)
    n = tiles.count()
    met = S.tile_pairs(tiles, "b", 0.94)
    assert n >= 16 and met.count() == met.distinct().count() <= n * (n + 1) // 2 * 0.4
    assert tiles.agg(F.sum(F.size("_rows"))).first()[0] == len(x)


def test_vector_links_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.0]), (3, "a", [0.99, 0.01]), (4, "a", None), (5, "a", [nan, 1.0]), (6, "a", [0.0, 0.0]), (7, "a", [0.0, 0.0]),
            (8, "a", [inf, 1.0]), (9, "a", [1.0, None]), (None, "a", [1.0, 0.0]), (10, None, [1.0, 0.0]), (11, "a", [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, b string, v array<double>")
    got = {(r.id_a, r.id_b) for r in S.vector_pairs(df, "id", "b", "v", 0.94).collect()}
    # Longer vectors link by their inner product, here 3 with the first and its like.
    assert got == {(1, 2), (1, 3), (6, 7), (1, 11), (3, 11)}
    assert S.vector_pairs(df.filter("id < 0"), "id", "b", "v", 0.94).count() == 0


def two_shared(tasks, chunks):
    return {t for t, words in tasks if any(len({w for w in words or [] if w} & {w for w in c or [] if w}) >= 2 for _, c in chunks)}


def test_texts_that_share_two_words(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    chunks = [(i, rng.choices(words, weights, k=rng.randint(0, 6))) for i in range(120)] + [(1000, None), (1001, [None, "w1", "w1"])]
    tasks = [(i, rng.choices(words + ["never", "seen"], k=rng.randint(0, 5))) for i in range(300)] + [(500, None), (501, ["w1", None])]
    t = spark.createDataFrame(tasks, "id long, w array<string>")
    c = spark.createDataFrame(chunks, "c long, cw array<string>")
    wanted = two_shared(tasks, chunks)
    assert 20 < len(wanted) < 300
    # No heavy word, some, one column of bits, several columns, all words heavy.
    for heavy in (1, 5, 64, 100):
        got = [r.id for r in P.supported_texts(t, "id", "w", c, "c", "cw", heavy=heavy).collect()]
        assert len(got) == len(set(got)) and set(got) == wanted
    assert P.supported_texts(t, "id", "w", c.limit(0), "c", "cw").count() == 0


def test_a_chunk_of_many_known_words(spark):
    words = [f"k{i}" for i in range(5000)]
    t = spark.createDataFrame([(i, [w, words[(i * 7 + 3) % 5000]]) for i, w in enumerate(words)] + [(9999, ["k1", "other"])], "id long, w array<string>")
    c = spark.createDataFrame([(1, words)], "c long, cw array<string>")
    assert {r.id for r in P.supported_texts(t, "id", "w", c, "c", "cw").collect()} == {i for i in range(5000) if (i * 7 + 3) % 5000 != i}
