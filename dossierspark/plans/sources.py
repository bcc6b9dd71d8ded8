"""Readers, sinks, incremental ingest and data quality on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierspark.functions import rules as RU
from dossierspark.operators import quality as Q
from dossierspark.operators.evidence import repair_ids
from dossierspark.plans.core import ALL_TABLES, EVENT_TYPES
from dossierspark.plans.documents import LIMITS, SQL_FULL, full
from dossierspark.plans.registry import Registry
from dossierspark.session import scratch_path, table
from dossierspark.sources import catalog, readers, sinks
from dossierspark.streaming import incremental

reg = Registry()

ORDER_SCHEMA = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderpriority", T.StringType()),
                             T.StructField("o_totalprice", T.DoubleType())])


@reg.add("src_jsonl_strict", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def src_jsonl_strict(spark, d):
    path = scratch_path(spark, "jsonl")
    orders = table(spark, d, "orders").select(*ORDER_SCHEMA.names)
    sinks.write_jsonl(orders.filter("o_totalprice < 100000"), path)
    sinks.write_jsonl(orders.filter("o_totalprice >= 100000"), path, append=True)
    return readers.read_jsonl(spark, path, ORDER_SCHEMA)


@reg.add("src_jsonl_quarantine", """
SELECT o_orderkey AS key, o_orderpriority AS payload, 'good' AS status FROM orders WHERE o_orderstatus <> 'F'
UNION ALL SELECT NULL, '{"o_orderkey": ' || o_orderkey || ', broken', 'quarantine' FROM orders WHERE o_orderstatus = 'F'""")
def src_jsonl_quarantine(spark, d):
    path = scratch_path(spark, "mixed")
    orders = table(spark, d, "orders").select(*ORDER_SCHEMA.names, "o_orderstatus")
    broken = F.concat(F.lit('{"o_orderkey": '), F.col("o_orderkey").cast("string"), F.lit(", broken"))
    orders.select(F.when(F.col("o_orderstatus") == "F", broken).otherwise(F.to_json(F.struct(*ORDER_SCHEMA.names)))).write.text(path)
    good, bad = readers.read_jsonl(spark, path, ORDER_SCHEMA, mode="lenient")
    return good.select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("payload"), F.lit("good").alias("status")).unionByName(
        bad.select(F.lit(None).cast("long").alias("key"), F.col(readers.BAD).alias("payload"), F.lit("quarantine").alias("status")))


@reg.add("src_csv_strings", """
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, CASE WHEN p_size > 25 THEN '' ELSE p_brand END AS p_brand, CAST(p_size AS VARCHAR) AS p_size FROM part""")
def src_csv_strings(spark, d):
    path = scratch_path(spark, "tsv")
    brand = F.when(F.col("p_size") > 25, F.lit("")).otherwise(F.col("p_brand")).alias("p_brand")
    part = table(spark, d, "part").select("p_partkey", "p_name", brand, "p_size")
    part.write.option("header", True).option("sep", "\t").csv(path)
    return readers.read_delimited(spark, path, "\t")


@reg.add("src_csv_breaks", """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(coalesce(text, '')) AS text_md5, coalesce(source, '') AS source, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS n_lines FROM documents""")
def src_csv_breaks(spark, d):
    path = scratch_path(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    docs.write.options(header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return readers.read_delimited(spark, path).select(
        "doc_id", F.md5("text").alias("text_md5"), "source", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"))


@reg.add("src_json_shapes", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'click' THEN 'list' WHEN 'view' THEN 'holder' ELSE 'object' END AS shape FROM events""")
def src_json_shapes(spark, d):
    row = F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")))
    kind = F.col("event_type")
    doc = F.when(kind == "click", F.concat(F.lit(" ["), row, F.lit("]"))).when(
        kind == "view", F.concat(F.lit('{"source": "x", "items": ['), row, F.lit("]}"))).otherwise(row)
    shape = F.when(kind == "click", "list").when(kind == "view", "holder").otherwise("object")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("k", T.LongType())])
    docs = table(spark, d, "events").select(doc.alias("doc"), shape.alias("shape"))
    return docs.select("shape", F.explode(readers.json_rows(F.col("doc"), schema, ["items", "rows", "data"])).alias("r")).select("r.*", "shape")


@reg.add("fn_fenced_json", """
SELECT event_id, CASE WHEN event_type <> 'error' THEN TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
  CASE WHEN event_type = 'error' THEN 'quarantine' ELSE 'good' END AS status FROM events""")
def fn_fenced_json(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "click", F.concat(F.lit("Here it is:\n```json\n["), "props", F.lit("]\n```\nDone."))).when(
        kind == "error", F.concat(F.lit('```json\n{"claims": ['), "props")).when(
        kind == "view", F.concat(F.lit('```\n{"claims": ['), "props", F.lit("]}\n```"))).otherwise(F.concat(F.lit("Result: "), "props"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    docs = table(spark, d, "events").select("event_id", raw.alias("raw"))
    rows = docs.select("event_id", readers.json_rows(readers.fenced_json(F.col("raw")), schema, ["claims", "rows"]).alias("rows"))
    flat = rows.select("event_id", F.explode_outer("rows").alias("r"))
    return flat.select("event_id", "r.k", F.when(F.col("r").isNull(), "quarantine").otherwise("good").alias("status"))


@reg.add("src_file_filter", """
SELECT * FROM (VALUES ('release_2024_01_01', true), ('release_2024_02_01', true)) v(release, has_bytes) WHERE (SELECT count(*) FROM orders) > 0""")
def src_file_filter(spark, d):
    root = scratch_path(spark, "files")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    for folder, status in (("release_2024_01_01/data", "F"), ("release_2024_02_01/data", "O"), ("release_2024_03_01/plots", "P")):
        orders.filter(F.col("o_orderstatus") == status).write.csv(f"{root}/{folder}")
    found = readers.find_files(spark, root, [".csv", ".tsv", ".json", ".jsonl", ".parquet"], ["plot", ".png", "/code/"])
    return found.groupBy("release").agg((F.sum("length") > 0).alias("has_bytes"))


@reg.add("src_list_lines", """
SELECT DISTINCT url AS line FROM pages WHERE NOT starts_with(trim(url), '#') AND trim(url) <> ''""")
def src_list_lines(spark, d):
    path = scratch_path(spark, "list")
    urls = table(spark, d, "pages").select("url")
    urls.unionByName(urls.select(F.concat(F.lit("# "), "url").alias("url"))).unionByName(urls.select(F.lit("  ").alias("url"))).write.text(path)
    return readers.list_lines(spark, path).distinct()


@reg.add("sink_summary", """
SELECT o_orderpriority, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY 1""")
def sink_summary(spark, d):
    path = scratch_path(spark, "summary")
    sinks.write_summary(table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), path, ["o_orderpriority", "n"])
    return readers.read_delimited(spark, path)


@reg.add("sink_collection", "SELECT label, count(*) AS n, 64 AS dimension, 'model-b' AS model FROM embeddings GROUP BY 1".replace("64 AS", "CAST(64 AS BIGINT) AS"))
def sink_collection(spark, d):
    path = scratch_path(spark, "collection")
    rows = table(spark, d, "embeddings")
    sinks.replace_collection(rows, path, "model-a", 64)
    try:
        sinks.replace_collection(rows, path, "model-b", 64)
        raise AssertionError("another model was accepted")
    except ValueError:
        sinks.replace_collection(rows, path, "model-b", 64, force=True)
    stored = spark.read.parquet(path)
    return stored.groupBy("label", "model", F.size("embedding").cast("long").alias("dimension")).agg(F.count(F.lit(1)).alias("n")).select(
        "label", "n", "dimension", "model")


@reg.add("cat_load_report")
def cat_load_report(spark, d):
    prefix = "loaded_"
    first = catalog.load_tables(spark, d, [*ALL_TABLES, "absent"], prefix, reimport=True).withColumn("run", F.lit(1))
    again = catalog.load_tables(spark, d, ALL_TABLES, prefix).withColumn("run", F.lit(2))
    counts = None
    for name in ALL_TABLES:
        one = spark.table(prefix + name).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return first.unionByName(again).join(counts, "table_name", "left").select("run", "table_name", "status", "n_rows")


@reg.add("inc_anti_insert", "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS BIGINT) AS batch, o_totalprice FROM orders")
def inc_anti_insert(spark, d):
    store = scratch_path(spark, "store")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    tag = lambda df, n: df.select("o_orderkey", F.lit(n).cast("long").alias("batch"), "o_totalprice")
    incremental.incremental_append(tag(orders.filter("o_orderstatus = 'F'"), 1), store, "o_orderkey", [F.col("o_totalprice"), F.col("batch")])
    incremental.incremental_append(tag(orders.unionByName(orders), 2), store, "o_orderkey", [F.col("o_totalprice"), F.col("batch")])
    return incremental.read_store(spark, store)


@reg.add("stream_incremental", "SELECT event_id, user_id, event_type, value FROM events")
def stream_incremental(spark, d):
    source, store, mark = scratch_path(spark, "drops"), scratch_path(spark, "log"), scratch_path(spark, "mark")
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    events.filter("value < 10").write.parquet(source)
    incremental.ingest_stream(spark, source, events.schema, store, mark, "event_id", [F.col("user_id"), F.col("event_type"), F.col("value")])
    # The second drop repeats a part of the first; the restarted stream inserts only what is new.
    events.filter("value >= 5 OR value IS NULL").write.mode("append").parquet(source)
    incremental.ingest_stream(spark, source, events.schema, store, mark, "event_id", [F.col("user_id"), F.col("event_type"), F.col("value")])
    return incremental.read_store(spark, store)


@reg.add("meta_flatten", """
SELECT vec_id, CASE WHEN label > 4 THEN '' ELSE 'label ' || label END AS title, '[' || label || ',' || (label + 1) || ']' AS pair,
  '{"label":' || label || '}' AS info, CASE WHEN label = 3 THEN NULL ELSE CAST(label AS DOUBLE) / 2 END AS score, label FROM embeddings""")
def meta_flatten(spark, d):
    label = F.col("label")
    rows = table(spark, d, "embeddings").select(
        "vec_id", F.when(label <= 4, F.concat(F.lit(" label \n"), label.cast("string"))).alias("title"), F.array(label, label + 1).alias("pair"),
        F.struct("label").alias("info"), F.when(label == 3, F.lit(float("nan"))).otherwise(label / 2).alias("score"), "label")
    return readers.flat_metadata(rows)


@reg.add("dd_id_repair", """
SELECT l_orderkey, l_partkey, l_extendedprice, l_quantity, CASE WHEN r = 1 THEN id ELSE id || '_' || r END AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY l_partkey, l_extendedprice, l_quantity) AS r FROM (SELECT *, l_orderkey || '-' || l_linenumber AS id FROM lineitem))""")
def dd_id_repair(spark, d):
    rows = table(spark, d, "lineitem").withColumn("id", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    order = [F.col("l_partkey"), F.col("l_extendedprice"), F.col("l_quantity")]
    return repair_ids(rows, "id", order).select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "id")


# ---- quality ---------------------------------------------------------------

@reg.add("dq_violations", """
WITH r AS (SELECT o_custkey AS id, CASE WHEN o_totalprice < 20000 THEN ' ' ELSE o_orderpriority END AS p, o_orderstatus FROM orders)
SELECT id, 'missing priority' AS rule FROM r WHERE trim(p) = '' UNION ALL SELECT id, 'unexpected status' FROM r WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT id, 'repeated id' FROM r GROUP BY 1 HAVING count(*) > 1""")
def dq_violations(spark, d):
    rows = table(spark, d, "orders").select(
        F.col("o_custkey").alias("id"), F.when(F.col("o_totalprice") < 20000, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("priority"),
        F.col("o_orderstatus").alias("status"))
    return Q.violations(rows, "id", required=["priority"], allowed={"status": ["F", "O"]})


@reg.add("dq_presence", """
WITH c AS (SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'returns', count(*) FROM orders WHERE o_orderstatus = 'X')
SELECT e.name, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n = 0 THEN 'empty' ELSE 'present' END AS status FROM (VALUES ('orders'), ('pages'), ('returns'), ('absent')) e(name) LEFT JOIN c ON e.name = c.name""")
def dq_presence(spark, d):
    expected = spark.createDataFrame([("orders",), ("pages",), ("returns",), ("absent",)], "name string")
    return Q.presence(expected, [("orders", table(spark, d, "orders")), ("pages", table(spark, d, "pages")),
                                 ("returns", table(spark, d, "orders").filter("o_orderstatus = 'X'"))])


@reg.add("dq_vector_dim", "SELECT label, len(embedding) AS dimension, count(*) AS n, len(embedding) = 64 AS consistent FROM embeddings GROUP BY ALL")
def dq_vector_dim(spark, d):
    return Q.vector_dimensions(table(spark, d, "embeddings"), "embedding", ["label"], 64)


@reg.add("dq_documents", SQL_FULL + """,
b AS (SELECT l_suppkey, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: starts_with(x, '-')) AS l FROM d),
n AS (SELECT *, list_transform(l, lambda x: trim(regexp_replace(x[3:], ':.*$', ''))) AS names FROM b)
SELECT l_suppkey, len(l) AS items, len(list_distinct(names)) < len(l) AS repeated_names, len(list_filter(l, lambda x: NOT (contains(x, 'ring') OR contains(x, 'bolt')))) = 0 AS only_allowed,
  len(list_filter(l, lambda x: NOT contains(x, ':'))) = 0 AS markers_present, len(regexp_extract_all(text, '\\n{3,}')) AS blank_runs FROM n""")
def dq_documents(spark, d):
    return Q.document_checks(full(spark, d), "l_suppkey", F.col("text"), ":", ["ring", "bolt"])


@reg.add("dq_inputs", """
WITH l AS (SELECT p_partkey, p_type, p_size, CASE WHEN p_size % 7 = 0 THEN '**' || p_name ELSE p_name END AS title FROM part)
SELECT p_partkey AS key, 'level out of range' AS rule FROM l WHERE p_size NOT BETWEEN 1 AND 45 UNION ALL SELECT p_partkey, 'markup in title' FROM l WHERE contains(title, '**')
UNION ALL SELECT event_id, 'value missing' FROM events WHERE value IS NULL OR value < 1
UNION ALL SELECT user_id, 'category count differs' FROM (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY 1) WHERE k <> 5""")
def dq_inputs(spark, d):
    title = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("**"), "p_name")).otherwise(F.col("p_name"))
    part = table(spark, d, "part").select(F.col("p_partkey").alias("key"), "p_size", title.alias("title"))
    events = table(spark, d, "events")
    listing = Q.label_warnings(part, "key", [("level out of range", ~F.col("p_size").between(1, 45)), ("markup in title", F.col("title").contains("**"))])
    answers = Q.label_warnings(events.withColumnRenamed("event_id", "key"), "key", [("value missing", F.col("value").isNull() | (F.col("value") < 1))])
    kinds = events.select("user_id", "event_type").distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("k"))
    groups = Q.label_warnings(kinds.withColumnRenamed("user_id", "key"), "key", [("category count differs", F.col("k") != len(EVENT_TYPES))])
    return listing.unionByName(answers).unionByName(groups).withColumnRenamed("warning_type", "rule")


QUESTION_AREAS = {"Tools": "T", "Ideas": "I", "Arts": "A", "People": "P", "Trade": "R", "Order": "O"}
SQL_AREA = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(QUESTION_AREAS)) + " END"
SQL_CODE = "CASE p_partkey % 6 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(QUESTION_AREAS.values())) + " END"
SQL_QUESTIONS = f"""SELECT (p_partkey - 1) // 60 AS form, (p_partkey - 1) % 60 + 1 AS position,
  CASE WHEN p_size = 7 THEN CAST((p_partkey - 1) % 60 + 2 AS VARCHAR) WHEN p_size = 8 THEN 'x7' ELSE CAST((p_partkey - 1) % 60 + 1 AS VARCHAR) END AS id,
  CASE p_size WHEN 3 THEN ' ' || lower({SQL_AREA}) WHEN 4 THEN {SQL_CODE} WHEN 9 THEN 'Elsewhere' WHEN 10 THEN NULL ELSE {SQL_AREA} END AS area,
  CASE p_size WHEN 3 THEN lower({SQL_CODE}) || ' ' WHEN 11 THEN 'X' ELSE {SQL_CODE} END AS code, CASE p_size WHEN 13 THEN '  ' WHEN 14 THEN NULL ELSE p_name END AS text FROM part"""


@reg.add("dq_questions", f"""
WITH q AS (SELECT *, TRY_CAST(id AS BIGINT) AS n, lower(trim(area)) AS a, upper(trim(code)) AS c FROM ({SQL_QUESTIONS})),
known AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{c}')" for a, c in QUESTION_AREAS.items())}) k(label, want)),
m AS (SELECT q.*, want FROM q LEFT JOIN known ON lower(label) = a OR lower(want) = a)
SELECT form, position, 'missing area' AS rule, '' AS found FROM m WHERE area IS NULL UNION ALL SELECT form, position, 'missing text', '' FROM m WHERE text IS NULL
UNION ALL SELECT form, position, 'id is no whole number', id FROM m WHERE n IS NULL UNION ALL SELECT form, position, 'id out of order', CAST(n AS VARCHAR) FROM m WHERE n <> position
UNION ALL SELECT form, position, 'unknown area', area FROM m WHERE area IS NOT NULL AND want IS NULL UNION ALL SELECT form, position, 'code differs from area', c FROM m WHERE c <> want
UNION ALL SELECT form, position, 'empty text', '' FROM m WHERE trim(text) = ''
UNION ALL SELECT form, NULL, 'number of items', CAST(count(*) AS VARCHAR) FROM m GROUP BY form HAVING count(*) <> 60
UNION ALL SELECT form, NULL, 'repeated ids', CAST(count(*) AS VARCHAR) FROM (SELECT form, n FROM m WHERE n IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY form
UNION ALL SELECT form, NULL, 'number of ' || label, CAST(count(want) AS VARCHAR) FROM (SELECT f.form, k.label, m.want FROM (SELECT DISTINCT form FROM m) f
  JOIN known k ON true LEFT JOIN m ON m.form = f.form AND m.want = k.want) GROUP BY form, label HAVING count(want) <> 10""")
def dq_questions(spark, d):
    size, place = F.col("p_size"), (F.col("p_partkey") - 1) % 60 + 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % 6 + 1).cast("int"))
    label, letter = pick(QUESTION_AREAS), pick(QUESTION_AREAS.values())
    items = table(spark, d, "part").select(
        F.expr("(p_partkey - 1) div 60").alias("form"), place.alias("position"),
        F.when(size == 7, (place + 1).cast("string")).when(size == 8, F.lit("x7")).otherwise(place.cast("string")).alias("id"),
        F.when(size == 3, F.concat(F.lit(" "), F.lower(label))).when(size == 4, letter).when(size == 9, F.lit("Elsewhere")).when(size != 10, label).alias("area"),
        F.when(size == 3, F.concat(F.lower(letter), F.lit(" "))).when(size == 11, F.lit("X")).otherwise(letter).alias("code"),
        F.when(size == 13, F.lit("  ")).when(size != 14, F.col("p_name")).alias("text"))
    return Q.form_checks(items, "form", "position", "id", "area", "code", "text", QUESTION_AREAS)


@reg.add("dq_missing_sections", """
SELECT p_partkey, section AS missing_section FROM part, (VALUES ('returned'), ('accepted'), ('large')) s(section) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey
  AND ((section = 'returned' AND l_returnflag = 'R') OR (section = 'accepted' AND l_returnflag = 'A') OR (section = 'large' AND l_quantity = 50)))""")
def dq_missing_sections(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return Q.missing_sections(table(spark, d, "part"), [("returned", lines.filter("l_returnflag = 'R'")), ("accepted", lines.filter("l_returnflag = 'A'")),
                                                        ("large", lines.filter("l_quantity = 50"))], "p_partkey")


@reg.add("dq_metadata_counts", """
SELECT lang AS value, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id)) AS missing FROM documents GROUP BY 1""")
def dq_metadata_counts(spark, d):
    flags = table(spark, d, "labels").select("doc_id", F.lit(True).alias("known"))
    docs = table(spark, d, "documents").select("doc_id", "lang").join(flags, "doc_id", "left")
    return docs.groupBy(F.col("lang").alias("value")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("known").isNull()).alias("missing"))


@reg.add("dq_report_agrees", """
WITH p AS (SELECT c_custkey, c_mktsegment AS code, c_nationkey AS zone, c_acctbal > 0 AS answered FROM customer),
r AS (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'CHANGED' ELSE c_mktsegment END AS code, CASE WHEN c_nationkey > 20 THEN 0 ELSE c_nationkey END AS zone, CASE WHEN c_acctbal < 1000 THEN 'NEW' ELSE c_mktsegment END AS final FROM customer)
SELECT c_custkey, unnest(list_filter([CASE WHEN r.code <> p.code THEN 'initial code' END, CASE WHEN r.zone <> p.zone THEN 'zone' END, CASE WHEN NOT answered AND final <> p.code THEN 'final code without answer' END], lambda x: x IS NOT NULL)) AS mismatch FROM r JOIN p USING (c_custkey)""")
def dq_report_agrees(spark, d):
    c = table(spark, d, "customer")
    profiles = c.select("c_custkey", F.col("c_mktsegment").alias("code"), F.col("c_nationkey").alias("zone"), (F.col("c_acctbal") > 0).alias("answered"))
    reports = c.select("c_custkey", F.when(F.col("c_nationkey") == 3, "CHANGED").otherwise(F.col("c_mktsegment")).alias("code"),
                       F.when(F.col("c_nationkey") > 20, 0).otherwise(F.col("c_nationkey")).alias("zone"),
                       F.when(F.col("c_acctbal") < 1000, "NEW").otherwise(F.col("c_mktsegment")).alias("final"))
    return Q.report_disagreements(reports, profiles, "c_custkey", [
        ("initial code", "code", "code", None), ("zone", "zone", "zone", None), ("final code without answer", "final", "code", ~F.col("p.answered"))])
