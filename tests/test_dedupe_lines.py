"""Repeated lines of a text, against a loop."""

import random

from pyspark.sql import functions as F

from dossierspark.functions import text as X


def model(text):
    out, seen = [], set()
    for line in (s.strip(" \t\r\f\x0b") for s in text.split("\n")):
        if line and line not in seen or not line and (not out or out[-1]):
            out.append(line)
        seen.add(line)
    return out


def test_dedupe_lines_equals_the_loop(spark):
    rng = random.Random(1)
    line = lambda: rng.choice(["", "", " ", "\t\r", "a", " a ", "b", "b\f", "0", "1", "A", "a b", "é ", "a  ", "b \u0085"])
    rows = [(i, "\n".join(line() for _ in range(rng.randint(1, 40)))) for i in range(200)] + [(200, ""), (201, "\n\n\n"), (202, "a\n\n\na\n\n\na")]
    df = spark.createDataFrame(rows + [(203, None)], "id long, t string")
    got = {r.id: r.k for r in df.select("id", X.dedupe_lines(F.split("t", "\n")).alias("k")).collect()}
    assert got == {i: model(t) for i, t in rows} | {203: None}


def test_lines_are_stripped_and_compared_once(spark):
    # Looking at the line before named the sorted lines three times, at two places: each line was stripped nine times.
    plan = spark.createDataFrame([("a",)], "t string").select(X.dedupe_lines(F.split("t", "\n")).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("trim(") + plan.count("regexp_replace(") <= 1


def test_dedupe_list_makes_its_keys_once(spark):
    df = spark.createDataFrame([(["B", " a", "b", None, "", "A ", "c"],)], "t array<string>").select(X.dedupe_list(F.col("t")).alias("k"))
    assert df.first().k == ["B", "a", "c"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
