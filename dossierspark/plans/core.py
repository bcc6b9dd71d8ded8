"""Relational core: joins, aggregates, ranks, sorts and set operations on the shared tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierspark.operators import aggregate as A
from dossierspark.operators import joins as J
from dossierspark.operators import ranking as R
from dossierspark.operators import sets as S
from dossierspark.plans.registry import Registry
from dossierspark.session import table

reg = Registry()

LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
SQL_LINE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"
SQL_BY_VALUE = f"l_quantity DESC, p_name, {SQL_LINE_ORDER}"


def by_value():
    return [F.col("l_quantity").desc(), F.col("p_name"), *[F.col(c) for c in LINE_ORDER]]


def named_facts(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size")
    return J.with_label(table(spark, d, "lineitem"), part, F.col("l_partkey") == F.col("p_partkey"))


FACTS = "lineitem JOIN part ON l_partkey = p_partkey"


# ---- ranks -----------------------------------------------------------------

@reg.add("win_topn", f"""
SELECT l_suppkey, CAST(rank AS BIGINT) AS rank, p_name, l_quantity, l_orderkey, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_BY_VALUE}) AS rank FROM {FACTS})
WHERE rank <= 10""")
def win_topn(spark, d):
    top = R.top_n(named_facts(spark, d), ["l_suppkey"], by_value(), 10)
    return top.select("l_suppkey", F.col("rank").cast("long").alias("rank"), "p_name", "l_quantity",
                      "l_orderkey", "l_partkey")


@reg.add("win_prefer", f"""
SELECT l_suppkey, p_name, l_returnflag, l_quantity, l_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_name ORDER BY
    CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_quantity DESC, {SQL_LINE_ORDER}) AS r FROM {FACTS})
WHERE r = 1""")
def win_prefer(spark, d):
    order = [F.col("l_quantity").desc(), *[F.col(c) for c in LINE_ORDER]]
    return R.prefer_variant(named_facts(spark, d), ["l_suppkey", "p_name"], "l_returnflag", ["R", "A"], order).select(
        "l_suppkey", "p_name", "l_returnflag", "l_quantity", "l_orderkey")


@reg.add("win_keep_max", f"""
SELECT l_suppkey, p_type, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_type ORDER BY l_quantity DESC, l_extendedprice DESC) AS r FROM {FACTS})
WHERE r = 1""")
def win_keep_max(spark, d):
    best = named_facts(spark, d).groupBy("l_suppkey", "p_type").agg(
        F.max(F.struct("l_quantity", "l_extendedprice")).alias("m"))
    return best.select("l_suppkey", "p_type", "m.*")


@reg.add("win_best_row", """
SELECT o_custkey, o_orderkey, o_orderpriority, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY
    CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC, o_orderpriority, o_totalprice DESC, o_orderkey) AS r
  FROM orders) WHERE r = 1""")
def win_best_row(spark, d):
    place = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    order = [place.desc(), F.col("o_orderpriority"), F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return R.best_row(table(spark, d, "orders"), ["o_custkey"], order).select(
        "o_custkey", "o_orderkey", "o_orderpriority", "o_totalprice")


@reg.add("win_cap_per_key", f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_name ORDER BY {SQL_BY_VALUE}) AS k FROM {FACTS}),
b AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_BY_VALUE}) AS r FROM a WHERE k <= 2)
SELECT l_suppkey, CAST(r AS BIGINT) AS rank, p_name, l_quantity, l_orderkey FROM b WHERE r <= 10""")
def win_cap_per_key(spark, d):
    return R.cap_per_key(named_facts(spark, d), ["l_suppkey"], ["p_name"], by_value(), 2, 10).select(
        "l_suppkey", F.col("rank").cast("long").alias("rank"), "p_name", "l_quantity", "l_orderkey")


@reg.add("win_ranks", f"""
WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_name ORDER BY {SQL_BY_VALUE}) AS k FROM {FACTS})
SELECT l_suppkey, p_name, p_type,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_BY_VALUE}) AS BIGINT) AS original_rank,
  CAST(row_number() OVER (PARTITION BY l_suppkey, p_type ORDER BY {SQL_BY_VALUE}) AS BIGINT) AS group_rank
FROM a WHERE k = 1""")
def win_ranks(spark, d):
    once = R.best_row(named_facts(spark, d), ["l_suppkey", "p_name"], by_value())
    both = R.ranked(R.ranked(once, ["l_suppkey"], by_value(), "original_rank"),
                    ["l_suppkey", "p_type"], by_value(), "group_rank")
    return both.select("l_suppkey", "p_name", "p_type", "original_rank", "group_rank")


@reg.add("win_remainder", f"""
SELECT l_suppkey, p_type, CAST(rank AS BIGINT) AS rank, p_name, CAST(greatest(n - 5, 0) AS BIGINT) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_type ORDER BY {SQL_BY_VALUE}) AS rank,
    count(*) OVER (PARTITION BY l_suppkey, p_type) AS n FROM {FACTS}) WHERE rank <= 5""")
def win_remainder(spark, d):
    return R.top_n(named_facts(spark, d), ["l_suppkey", "p_type"], by_value(), 5, remainder="more").select(
        "l_suppkey", "p_type", F.col("rank").cast("long").alias("rank"), "p_name", "more")


def _pools(spark, d):
    return named_facts(spark, d).filter(F.col("l_returnflag").isin("A", "R")).withColumn(
        "pool", F.when(F.col("l_returnflag") == "A", 1).otherwise(2))


SQL_TWO_POOL = f"""
WITH f AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END AS pool FROM {FACTS} WHERE l_returnflag IN ('A', 'R')),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, pool, p_name ORDER BY {SQL_BY_VALUE}) AS k FROM f) WHERE k = 1),
p1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_BY_VALUE}) AS pos FROM u WHERE pool = 1) WHERE pos <= 5),
p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_BY_VALUE}) AS pos FROM u
  WHERE pool = 2 AND NOT EXISTS (SELECT 1 FROM p1 WHERE p1.l_suppkey = u.l_suppkey AND p1.p_name = u.p_name)) WHERE pos <= 5),
picked AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY pool, pos) AS rank
  FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2))"""


@reg.add("win_two_pool", SQL_TWO_POOL + """
SELECT l_suppkey, CAST(pool AS BIGINT) AS pool, CAST(rank AS BIGINT) AS rank, p_name, l_quantity FROM picked WHERE rank <= 10""")
def win_two_pool(spark, d):
    return R.two_pool_pick(_pools(spark, d), "l_suppkey", "pool", "p_name", by_value()).select(
        "l_suppkey", F.col("pool").cast("long").alias("pool"), F.col("rank").cast("long").alias("rank"),
        "p_name", "l_quantity")


@reg.add("win_rank_decay", SQL_TWO_POOL + """
SELECT l_suppkey, p_name, round(greatest(0.72, CAST(0.96 AS DOUBLE) - CAST(0.025 AS DOUBLE) * (rank - 1)), 6) AS fit_score FROM picked WHERE rank <= 10""")
def win_rank_decay(spark, d):
    picked = R.two_pool_pick(_pools(spark, d), "l_suppkey", "pool", "p_name", by_value())
    return picked.select("l_suppkey", "p_name", F.round(R.rank_decay(F.col("rank")), 6).alias("fit_score"))


@reg.add("win_seq_ids", """
SELECT o_orderkey, 'claim_' || lpad(CAST(row_number() OVER (ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS VARCHAR), 6, '0') AS claim_id
FROM orders""")
def win_seq_ids(spark, d):
    order = [F.col("o_orderpriority").asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return R.sequence_ids(rows, order, "claim_", name="claim_id").select("o_orderkey", "claim_id")


# ---- sort ------------------------------------------------------------------

def _priority(prefix="o_"):
    status = F.when(F.col("o_orderstatus") == "F", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    urgent = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1).otherwise(0)
    large = F.when(F.col("o_totalprice") >= 300000, 1).otherwise(0)
    return [urgent, status, large, F.month("o_orderdate") == 1, F.col("o_totalprice") > 0,
            F.length("o_orderpriority"), F.year("o_orderdate"), -F.col("o_totalprice")]


@reg.add("sort_priority", """
SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (ORDER BY
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END DESC,
  CASE o_orderstatus WHEN 'F' THEN 3 WHEN 'O' THEN 2 ELSE 1 END DESC,
  CASE WHEN o_totalprice >= 300000 THEN 1 ELSE 0 END DESC, month(o_orderdate) = 1 DESC, o_totalprice > 0 DESC,
  length(o_orderpriority) DESC, year(o_orderdate) DESC, -o_totalprice DESC, o_orderkey) AS BIGINT) AS position FROM orders""")
def sort_priority(spark, d):
    order = [p.desc_nulls_last() for p in _priority()] + [F.col("o_orderkey").asc()]
    placed = R.ranked(table(spark, d, "orders"), [], order, "position")
    return placed.select("o_orderkey", "o_orderpriority", "position").orderBy("position")


@reg.add("topk_global", f"""
SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, {SQL_LINE_ORDER}, l_suppkey LIMIT 100""")
def topk_global(spark, d):
    order = [F.col("l_extendedprice").desc(), *[F.col(c) for c in LINE_ORDER], F.col("l_suppkey")]
    return R.top_k(table(spark, d, "lineitem"), order, 100).select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")


@reg.add("sort_case", """
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name,
  CAST(CASE WHEN s_acctbal < 0 THEN 0 WHEN s_acctbal < 5000 THEN 1 ELSE 2 END AS BIGINT) AS tier
FROM supplier ORDER BY tier, s_name""")
def sort_case(spark, d):
    tier = F.when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") < 5000, "low").otherwise("high")
    return table(spark, d, "supplier").select(
        "s_suppkey", "s_name", R.case_order(tier, ["debt", "low", "high"]).cast("long").alias("tier")
    ).orderBy("tier", "s_name")


# ---- joins -----------------------------------------------------------------

@reg.add("join_inner_dim", f"SELECT l_orderkey, l_linenumber, l_partkey, p_name, l_quantity FROM {FACTS}")
def join_inner_dim(spark, d):
    return named_facts(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "p_name", "l_quantity")


@reg.add("join_left_composite", """
WITH cat AS (SELECT p_type, p_brand, p_size, min(p_name) AS category_description FROM part
  WHERE p_retailprice >= 950 GROUP BY ALL)
SELECT l.l_orderkey, l.l_partkey, p.p_type, p.p_brand, p.p_size, c.category_description
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN cat c ON p.p_type = c.p_type AND p.p_brand = c.p_brand AND p.p_size = c.p_size""")
def join_left_composite(spark, d):
    categories = table(spark, d, "part").filter("p_retailprice >= 950").groupBy("p_type", "p_brand", "p_size").agg(
        F.min("p_name").alias("category_description"))
    return J.with_label(named_facts(spark, d), categories, ["p_type", "p_brand", "p_size"], "left").select(
        "l_orderkey", "l_partkey", "p_type", "p_brand", "p_size", "category_description")


@reg.add("join_label_fallback", """
SELECT c_custkey, coalesce(nullif(trim(r_name), ''), nullif(trim(n_name), ''), nullif(trim(s_name), ''), 'unlabelled') AS label
FROM customer LEFT JOIN (SELECT n_nationkey, min(r_name) AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey
    WHERE r_name IN ('AFRICA', 'ASIA') GROUP BY n_nationkey) a ON c_nationkey = a.n_nationkey
LEFT JOIN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey < 3) b ON c_nationkey = b.n_nationkey
LEFT JOIN (SELECT s_nationkey, min(s_name) AS s_name FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON c_nationkey = s_nationkey""")
def join_label_fallback(spark, d):
    nation = table(spark, d, "nation")
    top = nation.join(table(spark, d, "region").filter(F.col("r_name").isin("AFRICA", "ASIA")),
                      F.col("n_regionkey") == F.col("r_regionkey"))
    chain = [
        (top.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], "r_name"),
        (nation.filter("n_regionkey < 3").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], "n_name"),
        (table(spark, d, "supplier").filter("s_acctbal > 5000").withColumnRenamed("s_nationkey", "c_nationkey"),
         ["c_nationkey"], "s_name"),
    ]
    return J.label_fallback(table(spark, d, "customer"), chain, "label", "unlabelled").select("c_custkey", "label")


@reg.add("join_self_related", """
WITH edges AS (SELECT s_nationkey AS source, c_nationkey AS target, count(*) AS relatedness
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT a.n_name AS source_title, b.n_name AS target_title, relatedness FROM edges
JOIN nation a ON source = a.n_nationkey LEFT JOIN nation b ON target = b.n_nationkey""")
def join_self_related(spark, d):
    sold = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    bought = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    edges = sold.join(bought, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("s_nationkey").alias("source"), F.col("c_nationkey").alias("target")
    ).agg(F.count(F.lit(1)).alias("relatedness"))
    return J.related_titles(edges, table(spark, d, "nation"), "n_nationkey", "n_name", "source", "target", "left").select(
        "source_title", "target_title", "relatedness")


@reg.add("join_first_match", """
SELECT c_custkey, s_name FROM customer LEFT JOIN (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r = 1)
ON c_nationkey = s_nationkey""")
def join_first_match(spark, d):
    ref = table(spark, d, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), "s_name", "s_acctbal", "s_suppkey")
    return J.first_match(table(spark, d, "customer"), ref, ["c_nationkey"],
                         [F.col("s_acctbal").desc(), F.col("s_suppkey")]).select("c_custkey", "s_name")


@reg.add("join_lookup_fill", """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS code,
  CASE WHEN o_orderstatus <> 'O' THEN c_name END AS title FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, coalesce(code, b.c_custkey) AS code, coalesce(title, a.c_name) AS title FROM r
LEFT JOIN customer a ON code = a.c_custkey
LEFT JOIN (SELECT c_name, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) b ON title = b.c_name""")
def join_lookup_fill(spark, d):
    ref = table(spark, d, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("title"))
    rows = table(spark, d, "orders").join(ref, F.col("o_custkey") == F.col("code")).select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("code")).alias("code"),
        F.when(F.col("o_orderstatus") != "O", F.col("title")).alias("title"))
    return J.lookup_fill(rows, ref, "code", "title").select("o_orderkey", "code", "title")


@reg.add("join_evidence_tasks", f"""
WITH e AS (SELECT l_partkey, l_discount, l_quantity, l_orderkey, l_linenumber, l_extendedprice,
  lower(CASE WHEN l_linestatus = 'O' THEN p_name ELSE p_brand END) AS text FROM {FACTS} WHERE l_returnflag = 'R'),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, text ORDER BY l_discount DESC, l_quantity DESC, l_orderkey, l_linenumber, l_extendedprice) AS r FROM e) WHERE r = 1)
SELECT p_partkey, best.l_orderkey, best.l_quantity,
  CASE WHEN best.l_partkey IS NOT NULL THEN 'evidence' WHEN k.l_partkey IS NOT NULL THEN 'text_mismatch' ELSE 'unobserved' END AS evidence_status
FROM part LEFT JOIN best ON p_partkey = best.l_partkey AND lower(p_name) = best.text
LEFT JOIN (SELECT DISTINCT l_partkey FROM e) k ON p_partkey = k.l_partkey""")
def join_evidence_tasks(spark, d):
    tasks = table(spark, d, "part").select(F.col("p_partkey").alias("task_id"), "p_name")
    evidence = named_facts(spark, d).filter("l_returnflag = 'R'").select(
        F.col("l_partkey").alias("task_id"), "l_discount", "l_quantity", "l_orderkey", "l_linenumber", "l_extendedprice",
        F.when(F.col("l_linestatus") == "O", F.col("p_name")).otherwise(F.col("p_brand")).alias("task_text"))
    order = [F.col("l_discount").desc(), F.col("l_quantity").desc(), F.col("l_orderkey"), F.col("l_linenumber"),
             F.col("l_extendedprice")]
    out = J.evidence_for_tasks(tasks, evidence, ["task_id"], F.lower("p_name"), F.lower("task_text"), order)
    return out.select(F.col("task_id").alias("p_partkey"), "l_orderkey", "l_quantity", "evidence_status")


@reg.add("join_semi_cover", """
SELECT 'supplier' AS kind, s_suppkey AS key FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def join_semi_cover(spark, d):
    strong = table(spark, d, "lineitem").filter("l_quantity >= 50")
    covered = table(spark, d, "supplier").join(strong, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi")
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    open_ = table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    return covered.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key")).unionByName(
        open_.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key")))


@reg.add("join_linkage", """
SELECT DISTINCT source, kind, coalesce(p_name, CAST(target AS VARCHAR)) AS target_name FROM (
  SELECT DISTINCT l_suppkey AS source, 'returned' AS kind, l_partkey AS target FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT DISTINCT l_suppkey, 'accepted', l_partkey FROM lineitem WHERE l_returnflag = 'A')
LEFT JOIN part ON target = p_partkey""")
def join_linkage(spark, d):
    return J.linkage(_link_tables(spark, d), table(spark, d, "part"), "p_partkey", "p_name")


def _link_tables(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "l_returnflag")
    return [("returned", lines.filter("l_returnflag = 'R'")), ("accepted", lines.filter("l_returnflag = 'A'"))]


# ---- aggregates ------------------------------------------------------------

@reg.add("agg_value_counts", """
SELECT 'l_returnflag' AS field, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY 2
UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR), count(*) FROM lineitem GROUP BY 2""")
def agg_value_counts(spark, d):
    return A.value_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@reg.add("agg_source_summary", """
SELECT source, count(*) AS raw_rows, count(*) FILTER (quality IS NOT NULL) AS validated,
  count(*) FILTER (quality IS NULL) AS failed, count(*) FILTER (quality = 1 AND toxic = 0) AS kept,
  count(*) FILTER (quality = 0) AS low_quality, count(*) FILTER (toxic = 1) AS excluded,
  count(*) FILTER (lang = 'en') AS lang_en, count(*) FILTER (lang = 'fr') AS lang_fr,
  count(*) FILTER (lang = 'de') AS lang_de, count(*) FILTER (lang = 'es') AS lang_es,
  count(*) FILTER (n_chars < 500) AS short_rows, count(*) FILTER (n_chars >= 5000) AS long_rows,
  count(*) FILTER (quality IS NOT NULL AND n_chars < 500) AS recovered
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def agg_source_summary(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars").join(
        table(spark, d, "labels"), "doc_id", "left")
    q, t, n = F.col("quality"), F.col("toxic"), F.col("n_chars")
    return A.conditional_counts(rows, ["source"], {
        "raw_rows": F.lit(True), "validated": q.isNotNull(), "failed": q.isNull(), "kept": (q == 1) & (t == 0),
        "low_quality": q == 0, "excluded": t == 1, "lang_en": F.col("lang") == "en", "lang_fr": F.col("lang") == "fr",
        "lang_de": F.col("lang") == "de", "lang_es": F.col("lang") == "es", "short_rows": n < 500,
        "long_rows": n >= 5000, "recovered": q.isNotNull() & (n < 500)})


@reg.add("agg_chunk_summary", """
SELECT c_custkey, coalesce(claims, 0) AS claims, coalesce(valid, 0) AS valid, coalesce(open_rows, 0) AS open_rows FROM customer LEFT JOIN (
  SELECT o_custkey, count(*) AS claims, count(*) FILTER (o_orderstatus = 'F') AS valid, count(*) FILTER (o_orderstatus = 'O') AS open_rows
  FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def agg_chunk_summary(spark, d):
    base = table(spark, d, "customer").select("c_custkey")
    rows = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return A.counts_including_empty(base, rows, "c_custkey", {
        "claims": F.lit(True), "valid": F.col("o_orderstatus") == "F", "open_rows": F.col("o_orderstatus") == "O"})


@reg.add("agg_max_metric", """
SELECT user_id, max(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS best_metric FROM events WHERE event_type <> 'error' GROUP BY 1""")
def agg_max_metric(spark, d):
    metric = F.get_json_object("props", "$.k").try_cast("double")
    return table(spark, d, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.max(metric).alias("best_metric"))


SQL_SIGNAL_HITS = f"""
WITH hits AS (
  SELECT p_name AS title, CAST(2.0 AS DOUBLE) * l_tax AS weight, l_discount AS score, l_suppkey AS source_id, l_orderkey AS seq FROM {FACTS} WHERE l_returnflag = 'A'
  UNION ALL SELECT p_name, l_tax, l_discount, l_suppkey, l_orderkey FROM {FACTS} WHERE l_returnflag = 'R')"""


def _signal_hits(spark, d):
    f = named_facts(spark, d)
    hit = lambda flag, w: f.filter(F.col("l_returnflag") == flag).select(
        F.col("p_name").alias("title"), (F.lit(w) * F.col("l_tax")).alias("weight"), F.col("l_discount").alias("score"),
        F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("seq"))
    return S.union_all(hit("A", 2.0), hit("R", 1.0))


@reg.add("agg_weighted_signal", SQL_SIGNAL_HITS + """,
f AS (SELECT title, source_id, min(seq) AS first FROM hits GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY first, source_id) AS r FROM f)
SELECT title, round(signal, 6) AS signal, source_ids
FROM (SELECT title, sum(weight * score) / sum(weight) AS signal FROM hits GROUP BY 1)
JOIN (SELECT title, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY r) AS source_ids FROM t WHERE r <= 4 GROUP BY 1) USING (title)""")
def agg_weighted_signal(spark, d):
    out = A.weighted_signal(_signal_hits(spark, d), "title", "score", "weight", "source_id", "seq")
    return out.select("title", F.round("signal", 6).alias("signal"), "source_ids")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@reg.add("agg_pivot_scores", "SELECT user_id, " + ", ".join(
    f"count(*) FILTER (event_type = '{t}') AS \"{t}\"" for t in EVENT_TYPES) + " FROM events GROUP BY 1")
def agg_pivot_scores(spark, d):
    return A.pivot_scores(table(spark, d, "events"), "user_id", "event_type", EVENT_TYPES)


SQL_ORIGINAL = """
WITH original AS (SELECT * FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS position
  FROM events GROUP BY user_id, event_type) WHERE position <= 3),
votes AS (SELECT user_id, event_type, sum(CASE WHEN value >= 20 THEN CAST(1.0 AS DOUBLE) WHEN value >= 5 THEN 0.6 ELSE 0.3 END) AS votes FROM events GROUP BY ALL)"""


def original_types(spark, d):
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return R.top_n(counts, ["user_id"], [F.col("n").desc(), F.col("event_type")], 3, "position").drop("n")


def event_votes(spark, d):
    weight = F.when(F.col("value") >= 20, 1.0).when(F.col("value") >= 5, 0.6).otherwise(0.3)
    return table(spark, d, "events").select("user_id", "event_type", weight.alias("weight"))


@reg.add("agg_weighted_votes", SQL_ORIGINAL + """,
r AS (SELECT user_id, event_type, round(coalesce(votes, 0), 4) AS votes, row_number() OVER (PARTITION BY user_id ORDER BY round(coalesce(votes, 0), 4) DESC, position) AS refined_rank
  FROM original LEFT JOIN votes USING (user_id, event_type))
SELECT user_id, string_agg(event_type, '>' ORDER BY refined_rank) AS refined_code, max(votes) AS top_votes FROM r GROUP BY 1""")
def agg_weighted_votes(spark, d):
    votes = event_votes(spark, d).groupBy("user_id", "event_type").agg(F.round(F.sum("weight"), 4).alias("weight"))
    out = A.weighted_votes(votes, original_types(spark, d), "user_id", "event_type", "weight", "position")
    return out.groupBy("user_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("refined_rank", "event_type"))),
                                 lambda s: s["event_type"]), ">").alias("refined_code"),
        F.max("votes").alias("top_votes"))


@reg.add("agg_doc_stats", """
SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS total_chars, round(avg(length(text)), 4) AS mean_chars FROM documents GROUP BY 1""")
def agg_doc_stats(spark, d):
    out = A.text_stats(table(spark, d, "documents"), ["lang"], "text")
    return out.withColumn("mean_chars", F.round("mean_chars", 4))


@reg.add("agg_distinct", "SELECT DISTINCT p_brand, p_type, p_name FROM part")
def agg_distinct(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type", "p_name").distinct()


@reg.add("agg_coverage", """
SELECT key, count(*) AS tables_covered, string_agg(t, ',' ORDER BY t) AS table_names FROM (
  SELECT DISTINCT p_partkey AS key, 'part' AS t FROM part UNION ALL SELECT DISTINCT l_partkey, 'lineitem' FROM lineitem
  UNION ALL SELECT DISTINCT o_custkey, 'orders' FROM orders UNION ALL SELECT DISTINCT c_custkey, 'customer' FROM customer) GROUP BY 1""")
def agg_coverage(spark, d):
    pick = lambda t, c: (t, table(spark, d, t).select(F.col(c).alias("key")))
    return A.coverage([pick("part", "p_partkey"), pick("lineitem", "l_partkey"), pick("orders", "o_custkey"),
                       pick("customer", "c_custkey")], "key")


@reg.add("agg_leading_entity", f"""
WITH h AS (SELECT l_suppkey, p_name, l_orderkey AS rank FROM {FACTS}),
p AS (SELECT l_suppkey, p_name, count(*) AS n, min(rank) AS first FROM h GROUP BY ALL)
SELECT l_suppkey, max(CASE WHEN a = 1 THEN p_name END) AS first_entity, max(CASE WHEN b = 1 THEN p_name END) AS frequent_entity, max(n) AS frequent_count FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY first, p_name) AS a,
    row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, first, p_name DESC) AS b FROM p) GROUP BY 1""")
def agg_leading_entity(spark, d):
    hits = named_facts(spark, d).select("l_suppkey", "p_name", F.col("l_orderkey").alias("rank"))
    return A.leading_entity(hits, "l_suppkey", "p_name", "rank")


@reg.add("agg_latest", """
SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def agg_latest(spark, d):
    return A.latest(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], ["event_id", "value"])


@reg.add("agg_core_items", f"""
SELECT l_suppkey, CAST(place AS BIGINT) AS place, p_name FROM (SELECT l_suppkey, p_name, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_orderkey), p_name) AS place
  FROM {FACTS} GROUP BY l_suppkey, p_name) WHERE place <= 10""")
def agg_core_items(spark, d):
    return A.core_items(named_facts(spark, d), "l_suppkey", "p_name", "l_orderkey").select(
        "l_suppkey", F.col("place").cast("long").alias("place"), "p_name")


@reg.add("agg_first_seen_id", f"""
WITH f AS (SELECT l_suppkey, p_name, p_type, min({{'a': l_orderkey, 'b': l_linenumber, 'c': l_extendedprice}}) AS m FROM {FACTS} GROUP BY ALL)
SELECT l_suppkey, p_name, p_type, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY m, p_name, p_type) AS BIGINT) AS citation_id FROM f""")
def agg_first_seen_id(spark, d):
    facts = named_facts(spark, d)
    seq = ["l_orderkey", "l_linenumber", "l_extendedprice"]
    return A.first_seen_ids(facts, "l_suppkey", ["p_name", "p_type"], seq).select(
        "l_suppkey", "p_name", "p_type", "citation_id")


ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
              "embeddings", "pages", "benchmark", "labels", "conversations"]


@reg.add("agg_table_profile")
def agg_table_profile(spark, d):
    return A.table_profile(spark, [(t, table(spark, d, t)) for t in ALL_TABLES])


# ---- sets ------------------------------------------------------------------

@reg.add("set_union_all", """
SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def set_union_all(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"),
                                           F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return S.union_all(a, b)


@reg.add("set_union_distinct", """
SELECT l_partkey AS id FROM lineitem WHERE l_returnflag = 'R' UNION SELECT p_partkey FROM part WHERE p_size > 10 UNION SELECT o_custkey FROM orders""")
def set_union_distinct(spark, d):
    return S.union_distinct(
        table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("id")),
        table(spark, d, "part").filter("p_size > 10").select(F.col("p_partkey").alias("id")),
        table(spark, d, "orders").select(F.col("o_custkey").alias("id")))


@reg.add("set_merge_first", f"""
WITH s AS (SELECT 0 AS set_no, l_suppkey, p_name, l_quantity, {SQL_LINE_ORDER} FROM {FACTS} WHERE l_returnflag = 'R' AND l_quantity >= 40
  UNION ALL SELECT 1, l_suppkey, p_name, l_quantity, {SQL_LINE_ORDER} FROM {FACTS} WHERE l_returnflag = 'A')
SELECT l_suppkey, p_name, CAST(set_no AS BIGINT) AS set_no, l_quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_name ORDER BY set_no, {SQL_BY_VALUE}) AS r FROM s) WHERE r = 1""")
def set_merge_first(spark, d):
    f = named_facts(spark, d)
    out = S.merge_first([f.filter("l_returnflag = 'R' AND l_quantity >= 40"), f.filter("l_returnflag = 'A'")],
                        ["l_suppkey", "p_name"], by_value())
    return out.select("l_suppkey", "p_name", F.col("set_no").cast("long").alias("set_no"), "l_quantity")


@reg.add("set_jaccard", """
WITH t AS (SELECT conv_id, turn, list_distinct(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ')) AS tok FROM conversations)
SELECT a.conv_id, a.turn, round(len(list_intersect(a.tok, b.tok)) / CAST(len(list_distinct(list_concat(a.tok, b.tok))) AS DOUBLE), 6) AS similarity
FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn""")
def set_jaccard(spark, d):
    tok = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " "))
    t = table(spark, d, "conversations").select("conv_id", "turn", tok.alias("tok"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tok").alias("next_tok"))
    return t.join(nxt, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.round(S.jaccard(F.col("tok"), F.col("next_tok")), 6).alias("similarity"))
