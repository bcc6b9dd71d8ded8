"""Assembled documents and reports per supplier, brand and nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierspark.operators import documents as D
from dossierspark.operators import joins as J
from dossierspark.operators.ranking import top_n
from dossierspark.plans.core import FACTS, SQL_BY_VALUE, _link_tables, by_value, named_facts
from dossierspark.plans.registry import Registry
from dossierspark.session import table

reg = Registry()

LIMITS = {"Skills": 10, "Knowledge": 8, "Abilities": 5}
SQL_LINES = f"""
WITH f AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'Skills' WHEN 'N' THEN 'Knowledge' ELSE 'Abilities' END AS section, p_name || ': ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS line FROM {FACTS}),
t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, section ORDER BY {SQL_BY_VALUE}) AS rank FROM f),
l AS (SELECT * FROM t WHERE rank <= CASE section WHEN 'Skills' THEN 10 WHEN 'Knowledge' THEN 8 ELSE 5 END)"""
SQL_SECTIONS = SQL_LINES + """,
s AS (SELECT l_suppkey, section, count(*) AS items, 'Supplier ' || l_suppkey || chr(10) || section || ':' || chr(10) || string_agg('- ' || line, chr(10) ORDER BY rank) AS text FROM l GROUP BY l_suppkey, section)"""


def lines(spark, d):
    flag = F.col("l_returnflag")
    facts = named_facts(spark, d).withColumns({
        "section": F.when(flag == "A", "Skills").when(flag == "N", "Knowledge").otherwise("Abilities"),
        "line": F.concat("p_name", F.lit(": "), F.col("l_quantity").cast("long").cast("string"))})
    return D.limited_lines(facts, ["l_suppkey"], "section", by_value(), LIMITS)


def sections(spark, d):
    title = F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string"))
    return D.section_documents(lines(spark, d), ["l_suppkey"], "section", title, "line")


@reg.add("doc_assemble_sections", SQL_SECTIONS + " SELECT l_suppkey, section, items, text FROM s")
def doc_assemble_sections(spark, d):
    return sections(spark, d)


SQL_FULL = SQL_SECTIONS + """,
d AS (SELECT l_suppkey, count(*) AS sections, s_name || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY list_position(['Skills', 'Knowledge', 'Abilities'], section)) AS text
  FROM s JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_suppkey, s_name)"""


def full(spark, d):
    named = sections(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    return D.full_documents(named, ["l_suppkey", "s_name"], "section", list(LIMITS), F.col("s_name")).drop("s_name")


@reg.add("doc_assemble_full", SQL_FULL + " SELECT l_suppkey, sections, text FROM d")
def doc_assemble_full(spark, d):
    return full(spark, d)


@reg.add("doc_nested", """
WITH k AS (SELECT l_suppkey, p_name, 'order ' || l_orderkey AS act, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey),
o AS (SELECT * FROM (SELECT l_suppkey, p_name, row_number() OVER (PARTITION BY l_suppkey ORDER BY p_name) AS r FROM (SELECT DISTINCT l_suppkey, p_name FROM k)) WHERE r <= 35),
i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_name ORDER BY l_orderkey) AS n FROM (SELECT DISTINCT k.*, o.r FROM k JOIN o USING (l_suppkey, p_name))) WHERE n <= 8),
b AS (SELECT l_suppkey, r, count(*) AS inner_items, '- ' || p_name || chr(10) || string_agg('  - ' || act, chr(10) ORDER BY n) AS block FROM i GROUP BY l_suppkey, p_name, r)
SELECT l_suppkey, string_agg(block, chr(10) ORDER BY r) AS text, count(*) AS outer_items, CAST(sum(inner_items) AS BIGINT) AS inner_items FROM b GROUP BY 1""")
def doc_nested(spark, d):
    links = named_facts(spark, d).select("l_suppkey", "p_name", F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("act"), "l_orderkey")
    return D.nested_documents(links, "l_suppkey", "p_name", "act", ["p_name"], ["l_orderkey"])


@reg.add("doc_aliases", """
WITH a AS (SELECT p_brand, p_name AS alias, 1 AS kind FROM part UNION ALL SELECT p_brand, p_type || ' ' || p_name, 2 FROM part),
o AS (SELECT p_brand, alias, min(kind) AS kind FROM a GROUP BY p_brand, alias),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY kind, alias) AS rank, count(*) OVER (PARTITION BY p_brand) AS n FROM o)
SELECT p_brand, count(*) AS items, 'Aliases of ' || p_brand || chr(10) || string_agg('- ' || alias, chr(10) ORDER BY rank) || CASE WHEN max(n) > 60 THEN chr(10) || '- ' || (max(n) - 60) || ' more not shown' ELSE '' END AS text FROM r WHERE rank <= 60 GROUP BY 1""")
def doc_aliases(spark, d):
    part = table(spark, d, "part")
    rows = part.select("p_brand", F.col("p_name").alias("alias"), F.lit(1).alias("kind")).unionByName(
        part.select("p_brand", F.concat_ws(" ", "p_type", "p_name").alias("alias"), F.lit(2).alias("kind")))
    return D.list_documents(rows.groupBy("p_brand", "alias").agg(F.min("kind").alias("kind")), ["p_brand"], "alias",
                            [F.col("kind"), F.col("alias")], F.concat(F.lit("Aliases of "), F.col("p_brand")), 60)


@reg.add("doc_related", """
WITH e AS (SELECT s_nationkey AS source, c_nationkey AS target, count(*) AS relatedness FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
t AS (SELECT a.n_name AS source_title, b.n_name || CASE WHEN relatedness >= 120 THEN ' (Primary)' ELSE ' (Supplemental)' END AS item, relatedness FROM e JOIN nation a ON source = a.n_nationkey JOIN nation b ON target = b.n_nationkey),
r AS (SELECT *, row_number() OVER (PARTITION BY source_title ORDER BY relatedness DESC, item) AS rank, count(*) OVER (PARTITION BY source_title) AS n FROM t)
SELECT source_title, count(*) AS items, 'Related to ' || source_title || chr(10) || string_agg('- ' || item, chr(10) ORDER BY rank) || CASE WHEN max(n) > 10 THEN chr(10) || '- ' || (max(n) - 10) || ' more not shown' ELSE '' END AS text FROM r WHERE rank <= 10 GROUP BY 1""")
def doc_related(spark, d):
    from dossierspark.plans.core import reg as core
    named = core.queries["join_self_related"](spark, d).filter("source_title <> target_title")
    tier = F.when(F.col("relatedness") >= 120, F.lit(" (Primary)")).otherwise(F.lit(" (Supplemental)"))
    rows = named.withColumn("item", F.concat("target_title", tier))
    return D.list_documents(rows, ["source_title"], "item", [F.col("relatedness").desc(), F.col("item")],
                            F.concat(F.lit("Related to "), F.col("source_title")), 10)


@reg.add("doc_linkage", """
WITH k AS (SELECT DISTINCT source, kind, p_name AS target_name FROM (SELECT l_suppkey AS source, 'returned' AS kind, l_partkey AS target FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_suppkey, 'accepted', l_partkey FROM lineitem WHERE l_returnflag = 'A') JOIN part ON target = p_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY target_name) AS rank, count(*) OVER (PARTITION BY source, kind) AS n FROM k)
SELECT source, kind, count(*) AS items, 'Linked by ' || kind || chr(10) || string_agg('- ' || target_name, chr(10) ORDER BY rank) || CASE WHEN max(n) > 20 THEN chr(10) || '- ' || (max(n) - 20) || ' more not shown' ELSE '' END AS text FROM r WHERE rank <= 20 GROUP BY source, kind""")
def doc_linkage(spark, d):
    links = J.linkage(_link_tables(spark, d), table(spark, d, "part"), "p_partkey", "p_name")
    return D.list_documents(links, ["source", "kind"], "target_name", [F.col("target_name")], F.concat(F.lit("Linked by "), F.col("kind")), 20)


@reg.add("entity_detail", SQL_LINES + """,
g AS (SELECT l_suppkey, section, string_agg(line, '|' ORDER BY rank) AS v FROM l GROUP BY ALL)
SELECT s_suppkey, s_name, n_name, coalesce(max(CASE WHEN section = 'Skills' THEN v END), '') AS skills, coalesce(max(CASE WHEN section = 'Knowledge' THEN v END), '') AS knowledge, coalesce(max(CASE WHEN section = 'Abilities' THEN v END), '') AS abilities
FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN g ON s_suppkey = l_suppkey GROUP BY ALL""")
def entity_detail(spark, d):
    lists = D.entity_detail(lines(spark, d), ["l_suppkey"], "section", "line", list(LIMITS))
    flat = lists.select(F.col("l_suppkey").alias("s_suppkey"), *[F.array_join(s, "|").alias(s.lower()) for s in LIMITS])
    base = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    out = base.select("s_suppkey", "s_name", "n_name").join(flat, "s_suppkey", "left")
    return out.fillna("", subset=[s.lower() for s in LIMITS])


GERUNDS = {"small": "smalling", "red": "reddening", "blue": "bluing"}
SQL_NARRATIVE = f"""
WITH o AS (SELECT l_suppkey, p_name, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_orderkey), p_name) AS r FROM {FACTS} WHERE l_quantity >= 49 GROUP BY l_suppkey, p_name),
t AS (SELECT l_suppkey, list(p_name ORDER BY r) AS tasks FROM o WHERE r <= 3 GROUP BY 1),
x AS (SELECT l_suppkey, p_type, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, p_type) AS r FROM {FACTS} GROUP BY l_suppkey, p_type),
c AS (SELECT l_suppkey, list(lower(p_type) ORDER BY r) AS ctx FROM x WHERE r <= 2 GROUP BY 1),
p AS (SELECT s_suppkey, s_name, ctx, list_transform(tasks, lambda v: CASE WHEN v LIKE 'small %' THEN 'smalling' || v[6:] WHEN v LIKE 'red %' THEN 'reddening' || v[4:] WHEN v LIKE 'blue %' THEN 'bluing' || v[5:] ELSE v END) AS t
  FROM supplier LEFT JOIN t ON s_suppkey = t.l_suppkey LEFT JOIN c ON s_suppkey = c.l_suppkey)"""


@reg.add("txt_narrative", SQL_NARRATIVE + f"""
SELECT s_suppkey, CASE WHEN t IS NULL THEN '{D.NO_TASKS}' ELSE '{D.OPENING[0]}a ' || s_name || '{D.OPENING[1]}' || t[1] || '. ' ||
  CASE WHEN len(t) >= 3 THEN '{D.THREE_TASKS[0]}' || t[2] || ' and ' || t[3] || '{D.THREE_TASKS[2]}' WHEN len(t) = 2 THEN '{D.TWO_TASKS[0]}' || t[2] || '{D.TWO_TASKS[1]}' ELSE '{D.ONE_TASK}' END || ' ' ||
  CASE WHEN ctx IS NULL THEN '{D.NO_SETTING}' ELSE '{D.SETTING[0]}' || array_to_string(ctx, ' and ') || '{D.SETTING[1]}' END END AS narrative FROM p""")
def txt_narrative(spark, d):
    facts = named_facts(spark, d)
    strong = facts.filter("l_quantity >= 49").groupBy("l_suppkey", "p_name").agg(F.min("l_orderkey").alias("first"))
    tasks = top_n(strong, ["l_suppkey"], [F.col("first"), F.col("p_name")], 3).groupBy("l_suppkey").agg(D.ordered_list("rank", "p_name").alias("tasks"))
    kinds = facts.groupBy("l_suppkey", "p_type").agg(F.count(F.lit(1)).alias("n"))
    ctx = top_n(kinds, ["l_suppkey"], [F.col("n").desc(), F.col("p_type")], 2).groupBy("l_suppkey").agg(D.ordered_list("rank", "p_type").alias("ctx"))
    base = table(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    none = F.array().cast("array<string>")
    joined = base.join(tasks, "l_suppkey", "left").join(ctx, "l_suppkey", "left").withColumns({
        "tasks": F.coalesce("tasks", none), "ctx": F.coalesce("ctx", none)})
    return joined.select(F.col("l_suppkey").alias("s_suppkey"), D.narrative(F.col("s_name"), F.col("tasks"), F.col("ctx"), GERUNDS).alias("narrative"))


@reg.add("txt_report_md", f"""
WITH t AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_BY_VALUE}) AS rank FROM {FACTS})
SELECT l_suppkey, '# Report for supplier ' || l_suppkey || chr(10) || chr(10) || '| Rank | Part | Kind | Quantity |' || chr(10) || '|---|---|---|---|' || chr(10) ||
  string_agg('| ' || rank || ' | ' || p_name || ' | ' || p_type || ' | ' || CAST(l_quantity AS BIGINT) || ' |', chr(10) ORDER BY rank) AS markdown FROM t WHERE rank <= 10 GROUP BY 1""")
def txt_report_md(spark, d):
    top = top_n(named_facts(spark, d), ["l_suppkey"], by_value(), 10)
    made = D.markdown_table(top, ["l_suppkey"], "rank", {
        "Rank": F.col("rank"), "Part": F.col("p_name"), "Kind": F.col("p_type"), "Quantity": F.col("l_quantity").cast("long")})
    head = F.concat(F.lit("# Report for supplier "), F.col("l_suppkey").cast("string"), F.lit("\n\n"))
    return made.select("l_suppkey", F.concat(head, "markdown").alias("markdown"))
