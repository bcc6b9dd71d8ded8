"""Questionnaire checks on small forms."""

from dossierspark.operators import quality as Q

AREAS = {"Tools": "T", "Ideas": "I"}
SCHEMA = "form int, position long, id string, area string, code string, text string"


def found(spark, rows):
    got = Q.form_checks(spark.createDataFrame(rows, SCHEMA), "form", "position", "id", "area", "code", "text", AREAS, size=4, per_area=2)
    return sorted(map(tuple, got.collect()), key=str)


def test_a_sound_form_has_no_row(spark):
    good = [(1, k, str(k), " tOOls" if k < 3 else "i" if k == 3 else "Ideas", "t " if k < 3 else "I", "go") for k in range(1, 5)]
    assert found(spark, good) == [] and found(spark, []) == []


def test_every_rule(spark):
    rows = [(2, 1, "1", "Tools", "I", "go"), (2, 2, "1", "Tools", "T", " "), (2, 3, "x", "Else", "T", "go"), (2, 4, None, None, None, None), (2, 5, "5", "Tools", "T", "go")]
    assert found(spark, rows) == sorted([
        (2, 1, "code differs from area", "I"), (2, 2, "id out of order", "1"), (2, 2, "empty text", ""), (2, 3, "id is no whole number", "x"), (2, 3, "unknown area", "Else"),
        *[(2, 4, f"missing {c}", "") for c in ("id", "area", "code", "text")],
        (2, None, "number of items", "5"), (2, None, "repeated ids", "1"), (2, None, "number of Tools", "3"), (2, None, "number of Ideas", "0")], key=str)
