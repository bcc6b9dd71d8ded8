"""Copies keyed once, components by contraction, families with many links in one slice."""

import random

import pytest

from pyspark.sql import functions as F

from dossierspark.operators import groups as G


def test_copies_are_keyed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(40).selectExpr("id", "id % 7 as k")
    members, _ = G.copies_of(rows.mapInArrow(count, rows.schema), "id", [F.col("k")])
    assert {(r.id, r.hub) for r in members.collect()} == {(i, i % 7) for i in range(40)} and seen.value == 40


def test_components_of_chains_cliques_and_texts(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(300)] + [(i, j) for i in range(400, 430) for j in range(i + 1, 430)] + [(900, 900), (950, 940)]
    edges += [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(200)]
    rng.shuffle(edges)
    place = {v: v for e in edges for v in e}

    def root(v):
        while place[v] != v:
            v = place[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        place[y] = x
    df = spark.createDataFrame(edges, "id_a long, id_b long")
    assert {(r.id, r.component) for r in G.components(df).collect()} == {(v, root(v)) for v in place}
    text = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "id_a string, id_b string")
    assert {(r.id, r.component) for r in G.components(text).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("y", "y"), ("z", "y")}
    assert G.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("base", [0, 2**60 + 1, 2**63 - 1000])
def test_a_family_with_many_links_is_one_slice(spark, monkeypatch, base):
    # 498,000 links went past in slices of 200,000; numbers above 2^53 lost their last digits beside nulls.
    calls, plain = [], G._fold_step
    monkeypatch.setattr(G, "_fold_step", lambda *a: calls.append(a) or plain(*a))
    n, rng = 500 if base else 700, random.Random(4)
    ids, rank = [base + i for i in range(n)], [rng.randrange(50) for _ in range(n)]
    rows = spark.createDataFrame(list(zip(ids, range(n), rank)), "id long, s long, p long")
    gap = lambda i, j: (j - i) % 97 != 5
    pairs = spark.createDataFrame([(ids[i], ids[j], 0.9) for i in range(n) for j in range(i + 1, n) if gap(i, j)], "id_a long, id_b long, similarity double")
    groups = []
    for i in range(n):
        home = next((g for g in groups if gap(g["leader"], i)), None)
        if home is None:
            groups.append({"leader": i, "first": i, "members": 1})
        else:
            home["members"] += 1
            home["leader"] = i if rank[i] > rank[home["leader"]] else home["leader"]
    got = G.leader_dedupe(rows, [G.hubs_of(pairs)], "id", [F.col("p")], F.col("s")).collect()
    assert {(r.id, r.leader_seq, r.members) for r in got} == {(ids[g["leader"]], g["first"], g["members"]) for g in groups}
    assert len(calls) == 1
