"""Links of claims: few candidates, pairs found once, small components in few calls."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from dossierspark.functions.udfs import char_counts, common_length, ratios_at_least
from dossierspark.operators import groups as G
from dossierspark.operators import similarity as S


def edited_texts(seed, count, alphabet="abcdefghijklmnop ", lengths=(120, 300)):
    rng, texts = random.Random(seed), []
    for i in range(count):
        if i % 2:
            t = list(texts[-1])
            for _ in range(rng.randrange(1 + len(t) // 25)):
                t[rng.randrange(len(t))] = rng.choice(alphabet)
            texts.append("".join(t) + rng.choice(["", " again"]))
        else:
            texts.append("".join(rng.choices(alphabet, k=rng.randint(*lengths))))
    return texts


def test_ratio_candidates_leave_few_pairs(spark):
    # Nearly all of the 44,850 pairs shared one of the grams that had to be looked at.
    rows = [(i, "x", t) for i, t in enumerate(edited_texts(1, 300))]
    df = spark.createDataFrame(rows, "id long, b string, t string").withColumns({"c": char_counts("t"), "n": F.length("t")})
    for hot in (2000, 40):
        got = [(r.id_a, r.id_b) for r in S.ratio_candidates(df, "id", "b", "c", "n", 0.9, hot).collect()]
        assert len(got) == len(set(got)) < 3000
        assert {(i, i + 1) for i in range(0, 300, 2) if SequenceMatcher(None, rows[i][2], rows[i + 1][2]).ratio() >= 0.9} <= set(got)


def test_ratio_pairs_of_long_texts_equal_brute_force(spark):
    texts = edited_texts(2, 60) + edited_texts(3, 40, "ab ", (1, 30)) + ["é𝄞" * 120, "é𝄞" * 118]
    df = spark.createDataFrame([(i, "x", t) for i, t in enumerate(texts)], "id long, b string, t string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio() >= 0.9
    wanted = {(a, b, ratio(x, y), ratio(y, x)) for x, a in first.items() for y, b in first.items() if x and y and a < b and (ratio(x, y) or ratio(y, x))}
    got = {(r.id_a, r.id_b, r.forward, r.backward) for r in S.ratio_pairs(df, "id", "b", "t", 0.9).filter("similarity < 1").collect()}
    assert got == wanted and len(wanted) > 15


def test_common_length_bounds_the_ratio():
    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            before = row
            row = [0]
            for j, e in enumerate(y):
                row.append(before[j] + 1 if c == e else max(before[j + 1], row[j]))
        return row[-1]

    rng = random.Random(4)
    for _ in range(200):
        x, y = ("".join(rng.choices("abc", k=rng.randrange(12))) for _ in range(2))
        assert common_length(x, y) == plain(x, y)


def test_pairs_are_found_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    pairs = spark.range(20).selectExpr("id as id_a", "id + 100 as id_b", "if(id % 2 = 0, 1.0D, 0.9D) as similarity")
    members, links = G.hubs_of(pairs.mapInArrow(count, pairs.schema))
    assert members.count() == 40 and links.count() == 20 and seen.value == 20


def test_small_components_share_calls(spark, monkeypatch):
    calls, plain = spark.sparkContext.accumulator(0), G._fold_step

    def counted(id_, follow):
        step = plain(id_, follow)

        def run(state, part):
            calls.add(1)
            return step(state, part)

        return run

    monkeypatch.setattr(G, "_fold_step", counted)
    rows = spark.range(600).withColumn("p", F.lit(0))
    relation = G.copies_of(rows, "id", [F.floor(F.col("id") / 3)])
    for dedupe in (G.leader_dedupe, G.member_groups):
        got = dedupe(rows, [relation], "id", [F.col("p")], F.col("id")).collect()
        assert {(r.id, r.leader_seq, r.members) for r in got} == {(i, i, 3) for i in range(0, 600, 3)}
    # 200 components each.
    assert 0 < calls.value <= 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
