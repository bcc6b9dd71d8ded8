"""Forms of claims, literal runs of patterns and filters on computed columns."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from dossierspark.functions import rules as RU
from dossierspark.operators import labels as L

SF = "/root/testdata/sf0.001"


def test_claim_texts_are_those_of_the_joined_parts(spark):
    parts = [None, "", " \t", "Of  the, End.", "é-A\x00b", "x--", "--y  (z)", "ΟΔΟΣ"]
    rows = [(c, e, q, m) for c in parts for e in (None, "E 1") for q in parts for m in (None, ["a", "b;"])]
    df = spark.createDataFrame(rows, "claim_text string, affected_entity_text string, evidence_quote string, mentions array<string>")
    found = L.claim_texts(df).collect()
    assert len(found) == len(rows)
    one = lambda s: re.sub("[ \t\n\r\f\x0b]+", " ", (s or "").replace("\x00", " ")).strip(" ")
    lower = lambda *p: " ".join(x for x in map(one, p) if x).lower()
    apart = lambda s: " " + re.sub(" +", " ", re.sub("([^a-z0-9_ ]+)", r" \1 ", s)).strip(" ") + " "
    for r in found:
        m = " ".join(r.mentions or [])
        wanted = {"_claim": lower(r.claim_text, r.affected_entity_text, m), "_quote": lower(r.evidence_quote),
                  "_text": lower(r.claim_text, r.affected_entity_text, r.evidence_quote, m)}
        for name, text in wanted.items():
            assert r[name] == text and r[f"{name}_words"].split() == apart(text).split(), (r, name)
            assert "  " not in r[f"{name}_words"].strip(" ")


def test_needed_parts():
    assert L.needed_parts("thea") == [" thea "] and L.needed_parts("of[ ]+the") == [" of", "the "]
    assert L.needed_parts("ab?c*") == [" a"] and L.needed_parts("a?b+") == ["b"]
    assert L.needed_parts("(a|b)c") == L.needed_parts("a.b") == L.needed_parts("a|b") == []


def test_bounded_patterns_equal_the_plain_pattern(spark):
    texts = ["of the", "of  the x", "xof the", "of,the", "of then", "é of the-", "la[", "aab", "b", "ab c", "_of the"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("w", RU.word_text(F.col("t")))
    for patterns in (["of[ ]+the"], ["a?b+", "la"], ["(a|b)", "c"]):
        plain = "(?:^|[^a-z0-9_])(?:" + "|".join(patterns) + ")(?:[^a-z0-9_]|$)"
        got = {r.t: r.b for r in df.select("t", L._bounded(F.col("t"), F.col("w"), patterns).alias("b")).collect()}
        assert got == {t: bool(re.search(plain, t)) for t in texts}


def test_claims_are_read_once(spark):
    for name in ("claim_filters", "relevance_class", "use_scope", "impact_clean", "direction_clean", "dq_label_warnings"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("split(") == 1 and plan.count("regexp_replace") < 20, name
