"""Data-quality checks as violation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierspark.functions import rules as RU
from dossierspark.functions import text as X


def violations(df: DataFrame, id_: str, required=(), allowed: dict | None = None, unique: bool = True) -> DataFrame:
    """One row per failed rule. Repeated ids come from a count, so no group is gathered."""
    tests = [(f"missing {c}", F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "") for c in required]
    tests += [(f"unexpected {c}", F.col(c).isNull() | ~F.col(c).isin(*v)) for c, v in (allowed or {}).items()]
    failed = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in tests]))
    rows = df.select(F.col(id_), F.explode(failed).alias("rule"))
    if unique:
        repeated = df.groupBy(id_).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        rows = rows.unionByName(repeated.select(id_, F.lit("repeated id").alias("rule")))
    return rows


def presence(expected: DataFrame, tables) -> DataFrame:
    """Expected names with their row counts; ``missing`` or ``empty`` where there are none."""
    counts = reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables])
    n = F.col("n")
    return expected.join(counts, "name", "left").select(
        "name", F.coalesce(n, F.lit(0).cast("long")).alias("n"),
        RU.first_rule([(n.isNull(), "missing"), (n == 0, "empty")], "present").alias("status"))


def vector_dimensions(df: DataFrame, vec: str, keys, expected: int) -> DataFrame:
    return df.groupBy(*keys, F.size(vec).cast("long").alias("dimension")).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "consistent", F.col("dimension") == expected)


def label_warnings(df: DataFrame, id_: str, rules) -> DataFrame:
    """``rules`` is ``[(name, condition)]``; all are tested in one scan."""
    found = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))
    return df.select(id_, F.explode(found).alias("warning_type"))


def document_checks(df: DataFrame, id_: str, text: Column, marker: str, allowed) -> DataFrame:
    """Bullet counts, repeated names, whitelist, value markers and runs of blank lines per document."""
    bullets = F.filter(F.transform(X.lines(text), lambda s: F.trim(s)), lambda s: s.startswith("-"))
    names = F.transform(F.col("_bullets"), lambda s: F.trim(F.regexp_replace(F.substr(s, F.lit(3)), ":.*$", "")))
    return df.select(id_, text.alias("_t"), bullets.alias("_bullets")).select(
        id_, F.size("_bullets").cast("long").alias("items"),
        (F.size(F.array_distinct(names)) < F.size("_bullets")).alias("repeated_names"),
        F.forall("_bullets", lambda s: RU.any_substring(s, allowed)).alias("only_allowed"),
        F.forall("_bullets", lambda s: s.contains(marker)).alias("markers_present"),
        F.regexp_count(F.col("_t"), F.lit("\n{3,}")).cast("long").alias("blank_runs"))


def missing_sections(entities: DataFrame, facts, key: str) -> DataFrame:
    """Which named fact tables have no row for an entity."""
    out = entities.select(key)
    for name, df in facts:
        out = out.join(df.select(key).distinct().withColumn(f"_{name}", F.lit(True)), key, "left")
    absent = F.array_compact(F.array(*[F.when(F.col(f"_{n}").isNull(), F.lit(n)) for n, _ in facts]))
    return out.select(key, F.explode(absent).alias("missing_section"))


def report_disagreements(reports: DataFrame, profiles: DataFrame, key: str, fields) -> DataFrame:
    """``fields`` lists (name, report column, profile column, condition or None)."""
    joined = reports.alias("r").join(profiles.alias("p"), key)
    tests = []
    for name, mine, theirs, only_if in fields:
        differs = ~F.col(f"r.{mine}").eqNullSafe(F.col(f"p.{theirs}"))
        tests.append(F.when(differs if only_if is None else differs & only_if, F.lit(name)))
    return joined.select(key, F.explode(F.array_compact(F.array(*tests))).alias("mismatch"))


def form_checks(items: DataFrame, form: str, position: str, id_: str, area: str, code: str, text: str, areas: dict[str, str],
                size: int = 60, per_area: int = 10) -> DataFrame:
    """Broken rules of questionnaires: (form, position, rule, found).

    Items carry the one-based ``position`` they have in their form. ``areas`` maps labels to codes; an area is given by either, without
    regard to case and outer blanks. An item is checked for missing fields, a whole number as id that equals its position, a known area, the code of
    its area and a text; a form (position null) for its size, repeated ids and the number of items of every area, none included.
    """
    label = F.lower(F.trim(F.col(area)))
    names = {a.lower(): c for a, c in areas.items()} | {c.lower(): c for c in areas.values()}
    wanted = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), label)
    number = F.col(id_).cast("string").try_cast("long")
    letters = F.upper(F.trim(F.col(code)))
    rows = items.withColumns({"_want": wanted, "_id": number, "_code": letters})
    known = F.col("_want").isNotNull()
    tests = [(f"missing {c}", F.col(c).isNull(), F.lit("")) for c in (id_, area, code, text)]
    tests += [("id is no whole number", F.col(id_).isNotNull() & F.col("_id").isNull(), F.col(id_).cast("string")),
              ("id out of order", F.col("_id") != F.col(position), F.col("_id").cast("string")),
              ("unknown area", F.col(area).isNotNull() & ~known, F.col(area)),
              ("code differs from area", known & (F.col("_code") != F.col("_want")), F.col("_code")),
              ("empty text", F.trim(F.col(text)) == "", F.lit(""))]
    broken = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), found.alias("found"))) for rule, bad, found in tests]))
    single = rows.select(form, position, F.explode(broken).alias("_b")).select(form, position, "_b.rule", "_b.found")

    counts = rows.groupBy(form, "_id").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col("_want") == c).alias(f"_area_{c}") for c in areas.values()]).groupBy(form).agg(
        F.sum("_n").alias("_n"), F.count_if(F.col("_id").isNotNull() & (F.col("_n") > 1)).alias("_again"),
        *[F.sum(f"_area_{c}").alias(f"_area_{c}") for c in areas.values()])
    whole = [("number of items", F.col("_n") != size, F.col("_n")), ("repeated ids", F.col("_again") > 0, F.col("_again"))]
    whole += [(f"number of {a}", F.col(f"_area_{c}") != per_area, F.col(f"_area_{c}")) for a, c in areas.items()]
    broken = F.array_compact(F.array(*[F.when(bad, F.struct(F.lit(rule).alias("rule"), n.cast("string").alias("found"))) for rule, bad, n in whole]))
    place = items.schema[position].dataType
    return single.unionByName(counts.select(form, F.lit(None).cast(place).alias(position), F.explode(broken).alias("_b")).select(
        form, position, "_b.rule", "_b.found"))
