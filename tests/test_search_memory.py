"""A task's pairs of blocks and tiles reach Python one by one."""

import numpy as np

from dossierspark.operators.vectors import pair_search


def test_one_pair_a_call(spark):
    x = np.random.default_rng(1).normal(size=(400, 4)).round(3)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    hits = pair_search(df.withColumnRenamed("id", "q"), df.withColumnRenamed("id", "c"), "q", "c", "v", 3, block=30, tile=50)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow [" not in plan.replace("FlatMapGroupsInArrow", "")
    got = {}
    for r in hits.collect():
        got.setdefault(r.q, []).append((r.distance, r.c))
    for q in range(400):
        d = ((x - x[q]) ** 2).sum(1)
        wanted = sorted(zip(d, range(400)))[:3]
        assert [c for _, c in sorted(got[q])[:3]] == [c for _, c in wanted]
