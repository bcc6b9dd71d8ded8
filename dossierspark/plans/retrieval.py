"""Vector search: every vector whose id is divisible by 20 is a query, all vectors are the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierspark.functions import rules as RU
from dossierspark.functions import text as X
from dossierspark.operators import documents as D
from dossierspark.operators import retrieval as R
from dossierspark.operators.evidence import exact_dedupe
from dossierspark.operators.groups import greedy_ranked
from dossierspark.operators.ranking import best_row, top_n
from dossierspark.plans import sql_text as Q
from dossierspark.plans.core import FACTS, named_facts
from dossierspark.plans.registry import Registry
from dossierspark.session import table

reg = Registry()

LEVEL = {"en": 3, "fr": 4, "de": 2}


def queries(spark, d):
    return table(spark, d, "embeddings").filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("qid"), F.col("label").alias("own"), "embedding")


def with_own(spark, d, hits):
    """Hits with the label of their query."""
    return hits.join(queries(spark, d).select("qid", "own"), "qid")


def corpus(spark, d):
    return table(spark, d, "embeddings")


def meta(spark, d):
    """Text and metadata of a vector: the document of the same number."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang", "source", "n_chars")


SQL_HITS = """
WITH q AS (SELECT vec_id AS qid, label AS own, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
h AS (SELECT qid, own, vec_id, label, pow(list_distance(v, CAST(embedding AS DOUBLE[])), 2) AS distance, 1 / (1 + pow(list_distance(v, CAST(embedding AS DOUBLE[])), 2)) AS score FROM q, embeddings),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM h)"""


def _shape(df, *extra):
    return df.select(F.col("qid").cast("long").alias("qid"), "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"), *extra)


_COLS = "CAST(qid AS BIGINT) AS qid, vec_id, rank, round(score, 6) AS score"


@reg.add("knn_exact", SQL_HITS + f" SELECT {_COLS}, round(distance, 6) AS distance FROM s WHERE rank <= 10")
def knn_exact(spark, d):
    return _shape(R.knn(queries(spark, d), corpus(spark, d), "qid", "vec_id", "embedding", 10), F.round("distance", 6).alias("distance"))


@reg.add("knn_cosine", """
WITH q AS (SELECT vec_id AS qid, label AS own, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
h AS (SELECT qid, vec_id, list_cosine_distance(v, CAST(embedding AS DOUBLE[])) AS distance FROM q, embeddings),
s AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM h WHERE distance > 0.0001)
SELECT CAST(qid AS BIGINT) AS qid, vec_id, round(distance, 6) AS distance FROM s WHERE rank <= 9""")
def knn_cosine(spark, d):
    hits = R.knn(queries(spark, d), corpus(spark, d), "qid", "vec_id", "embedding", 10, metric="cosine").filter("distance > 0.0001")
    return top_n(hits.drop("rank"), ["qid"], [F.col("distance"), F.col("vec_id")], 9).select(
        F.col("qid").cast("long").alias("qid"), "vec_id", F.round("distance", 6).alias("distance"))


@reg.add("knn_filtered", SQL_HITS.replace("FROM q, embeddings", "FROM q, embeddings WHERE label IN (1, 3, 5)") + f" SELECT {_COLS} FROM s WHERE rank <= 5")
def knn_filtered(spark, d):
    where = RU.build_filter({"label": {"$in": [1, 3, 5]}})
    return _shape(R.knn(queries(spark, d), corpus(spark, d), "qid", "vec_id", "embedding", 5, where=where))


_MULTI = SQL_HITS + """,
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, label < 5 ORDER BY distance, vec_id) AS r FROM h) WHERE r <= 8),
m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS place FROM a)"""


@reg.add("knn_multi", _MULTI + " SELECT CAST(qid AS BIGINT) AS qid, vec_id, label < 5 AS first_collection, place FROM m WHERE place <= 8")
def knn_multi(spark, d):
    q, c = queries(spark, d), corpus(spark, d)
    sets = [R.knn(q, c, "qid", "vec_id", "embedding", 8, where=cond).withColumn("first_collection", F.lit(first))
            for cond, first in ((F.col("label") < 5, True), (F.col("label") >= 5, False))]
    return R.best_of(sets, "qid", "vec_id", 8).select(F.col("qid").cast("long").alias("qid"), "vec_id", "first_collection", F.col("place").cast("long").alias("place"))


@reg.add("knn_in_entity", SQL_HITS.replace("FROM q, embeddings", "FROM q JOIN embeddings ON label = own") + f" SELECT {_COLS} FROM s WHERE rank <= 10")
def knn_in_entity(spark, d):
    q = queries(spark, d).withColumn("label", F.col("own"))
    return _shape(R.knn(q, corpus(spark, d), "qid", "vec_id", "embedding", 10, within="label"))


@reg.add("knn_doc_type", SQL_HITS.replace("FROM q, embeddings", "FROM q, embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'fr'") + f" SELECT {_COLS} FROM s WHERE rank <= 5")
def knn_doc_type(spark, d):
    typed = corpus(spark, d).join(meta(spark, d).select("vec_id", "lang"), "vec_id")
    return _shape(R.knn(queries(spark, d), typed, "qid", "vec_id", "embedding", 5, where=RU.build_filter({"lang": "fr"})))


_ROUTED = SQL_HITS + """,
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS r FROM h JOIN documents ON vec_id = doc_id WHERE h.label = own AND lang = CASE WHEN own % 2 = 0 THEN 'en' ELSE 'es' END) WHERE r <= 8),
top AS (SELECT * FROM s WHERE rank <= 16),
u AS (SELECT qid, vec_id, score, 0 AS set_no FROM own UNION ALL SELECT qid, vec_id, score, 1 FROM top),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY set_no) AS k FROM u),
m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY set_no, score DESC, vec_id) AS place FROM o WHERE k = 1)"""


@reg.add("knn_routed", _ROUTED + " SELECT CAST(qid AS BIGINT) AS qid, vec_id, CAST(set_no AS BIGINT) AS set_no, place FROM m WHERE place <= 8")
def knn_routed(spark, d):
    # The route is data: each query's section is a column, so the section search is one equi-join.
    route = F.concat_ws("|", F.col("own").cast("string"), F.when(F.col("own") % 2 == 0, "en").otherwise("es"))
    q = queries(spark, d).withColumn("section", route)
    c = corpus(spark, d).join(meta(spark, d).select("vec_id", "lang"), "vec_id").withColumn("section", F.concat_ws("|", F.col("label").cast("string"), "lang"))
    own = R.knn(q, c, "qid", "vec_id", "embedding", 8, within="section")
    fallback = R.knn(q, corpus(spark, d), "qid", "vec_id", "embedding", 16)
    merged = R.merge_sets([own, fallback], "qid", "vec_id", [F.col("score").desc(), F.col("vec_id")], 8)
    return merged.select(F.col("qid").cast("long").alias("qid"), "vec_id", F.col("set_no").cast("long").alias("set_no"), F.col("place").cast("long").alias("place"))


_RERANK = SQL_HITS + """,
c1 AS (SELECT qid, own, vec_id, score, 0 AS set_no FROM s WHERE rank <= 64),
c2 AS (SELECT qid, own, vec_id, score, 1 AS set_no FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS r FROM h WHERE label = own) WHERE r <= 32),
c3 AS (SELECT qid, own, vec_id, score, 2 AS set_no FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS r FROM h WHERE label = own + 1) WHERE r <= 24),
u AS (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY set_no) AS k FROM (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3)),
x AS (SELECT u.qid, u.own, u.vec_id, u.score, e.label, lang, source, n_chars, text FROM u JOIN embeddings e USING (vec_id) LEFT JOIN documents ON vec_id = doc_id WHERE k = 1),
b AS (SELECT *, score + CASE WHEN label = own THEN 3.0 ELSE 0 END + CASE WHEN label = own + 1 THEN 2.0 ELSE 0 END + CASE WHEN lang = 'en' THEN 1.2 ELSE 0 END + CASE WHEN source IN ('src1', 'src2', 'src3') THEN 1.0 ELSE 0 END
  + CASE WHEN n_chars > 1000 THEN 0.8 ELSE 0 END AS reranked, count(*) FILTER (label = own) OVER (PARTITION BY qid) AS n_exact,
  concat_ws(',', CASE WHEN label = own THEN 'exact_code' END, CASE WHEN label = own + 1 THEN 'exact_title' END, CASE WHEN lang = 'en' THEN 'task_level' END, CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'task_metric' END, CASE WHEN n_chars > 1000 THEN 'numeric_metric' END) AS reasons FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY reranked DESC, vec_id) AS place FROM b WHERE n_exact < 8 OR label = own)"""


def reranked(spark, d):
    q, c = queries(spark, d), corpus(spark, d)
    own, title = q.withColumn("label", F.col("own")), q.withColumn("label", F.col("own") + 1)
    sets = [R.knn(q, c, "qid", "vec_id", "embedding", 64), R.knn(own, c, "qid", "vec_id", "embedding", 32, within="label"),
            R.knn(title, c, "qid", "vec_id", "embedding", 24, within="label")]
    hits = R.merge_sets(sets, "qid", "vec_id", [F.col("vec_id")]).drop("set_no", "rank")
    rows = with_own(spark, d, hits.join(c.select("vec_id", "label"), "vec_id").join(meta(spark, d), "vec_id", "left"))
    boosts = [("exact_code", F.col("label") == F.col("own"), 3.0), ("exact_title", F.col("label") == F.col("own") + 1, 2.0),
              ("task_level", F.col("lang") == "en", 1.2), ("task_metric", F.col("source").isin("src1", "src2", "src3"), 1.0),
              ("numeric_metric", F.col("n_chars") > 1000, 0.8)]
    return R.rerank(rows, boosts, "qid", "vec_id", F.col("label") == F.col("own"), 8)


@reg.add("knn_rerank", _RERANK + " SELECT CAST(qid AS BIGINT) AS qid, vec_id, place, round(reranked, 6) AS reranked, reasons FROM f")
def knn_rerank(spark, d):
    return reranked(spark, d).select(F.col("qid").cast("long").alias("qid"), "vec_id", F.col("place").cast("long").alias("place"),
                                     F.round("reranked", 6).alias("reranked"), F.array_join("reasons", ",").alias("reasons"))


@reg.add("dd_ranked_greedy")
def dd_ranked_greedy(spark, d):
    hits = reranked(spark, d).withColumns({"tokens": X.tokens(F.coalesce("text", F.lit("")), (), 1), "norm": X.normalize_text(F.col("text"))}).drop("reasons")
    keys = [("id", F.col("vec_id").cast("string")), ("claim", F.md5("norm")), ("task", F.when(F.col("lang") == "en", F.concat_ws("|", "source", "lang", F.col("n_chars").cast("string")))),
            ("source_metric", F.concat_ws("|", "source", "lang", "label", F.floor(F.col("n_chars") / 100).cast("string")))]
    out = greedy_ranked(hits, "qid", [F.col("place")], keys, "tokens", 8)
    return out.select(F.col("qid").cast("long").alias("qid"), F.col("rank").cast("long").alias("rank"), "vec_id", F.round("reranked", 6).alias("reranked"))


@reg.add("knn_claims", SQL_HITS + """,
c AS (SELECT s.*, lang FROM s JOIN documents ON vec_id = doc_id WHERE rank <= 48 AND lang <> 'de'),
p AS (SELECT *, score + CASE WHEN lang = 'en' THEN 0.03 ELSE 0 END AS preferred FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY preferred DESC, vec_id) AS place FROM p)
SELECT CAST(qid AS BIGINT) AS qid, vec_id, place, round(preferred, 6) AS score FROM r WHERE place <= 8""")
def knn_claims(spark, d):
    return claims(spark, d).select(F.col("qid").cast("long").alias("qid"), "vec_id", F.col("place").cast("long").alias("place"), F.round("preferred", 6).alias("score"))


def claims(spark, d, k=8):
    hits = R.knn(queries(spark, d), corpus(spark, d), "qid", "vec_id", "embedding", max(6 * k, k + 20)).join(meta(spark, d), "vec_id")
    kept = hits.filter(F.col("lang") != "de").withColumn("preferred", F.col("score") + F.when(F.col("lang") == "en", 0.03).otherwise(0.0))
    return top_n(kept, ["qid"], [F.col("preferred").desc(), F.col("vec_id")], k, "place")


_METHODS = """
m0 AS (SELECT s.*, left({norm}, 200) AS fp, source FROM s JOIN documents ON vec_id = doc_id WHERE rank <= 20),
m1 AS (SELECT *, row_number() OVER (PARTITION BY qid, fp ORDER BY score DESC, vec_id) AS k FROM m0),
m2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS place FROM m1 WHERE k = 1)""".format(norm=Q.normalize_text("text"))


@reg.add("knn_methods", SQL_HITS + "," + _METHODS + " SELECT CAST(qid AS BIGINT) AS qid, vec_id, place FROM m2 WHERE place <= 4")
def knn_methods(spark, d):
    return methods(spark, d).select(F.col("qid").cast("long").alias("qid"), "vec_id", F.col("place").cast("long").alias("place"))


def methods(spark, d, k=4):
    hits = R.knn(queries(spark, d), corpus(spark, d), "qid", "vec_id", "embedding", max(4 * k, 20)).join(meta(spark, d), "vec_id")
    order = [F.col("score").desc(), F.col("vec_id")]
    once = best_row(hits.withColumn("_fp", F.left(X.normalize_text(F.col("text")), F.lit(200))), ["qid", "_fp"], order)
    return top_n(once, ["qid"], order, k, "place").drop("_fp")


@reg.add("knn_fusion", SQL_HITS + """,
b AS (SELECT own % 5 AS request, vec_id, max(score) AS score FROM s WHERE rank <= 20 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, vec_id) AS place FROM b)
SELECT CAST(request AS BIGINT) AS request, vec_id, place, round(score, 6) AS score FROM r WHERE place <= 10""")
def knn_fusion(spark, d):
    hits = with_own(spark, d, R.knn(queries(spark, d), corpus(spark, d), "qid", "vec_id", "embedding", 20)).withColumn("request", (F.col("own") % 5).cast("long"))
    return R.fuse(hits, "request", "vec_id", "score", 10).select("request", "vec_id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@reg.add("query_variants", f"""
WITH t AS (SELECT l_suppkey, p_name, row_number() OVER (PARTITION BY l_suppkey ORDER BY min(l_orderkey), p_name) AS r FROM {FACTS} GROUP BY l_suppkey, p_name),
l AS (SELECT s_suppkey, list_concat([s_name, s_name || ' tasks', s_name || ' skills', upper(s_name)], list(s_name || ' ' || p_name ORDER BY r) FILTER (r <= 12)) AS v FROM supplier JOIN t ON s_suppkey = l_suppkey GROUP BY s_suppkey, s_name),
u AS (SELECT s_suppkey, list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i)[1:14] AS v FROM l)
SELECT s_suppkey, generate_subscripts(v, 1) - 1 AS variant_no, unnest(v) AS variant FROM u""")
def query_variants(spark, d):
    firsts = named_facts(spark, d).groupBy("l_suppkey", "p_name").agg(F.min("l_orderkey").alias("first"))
    tasks = top_n(firsts, ["l_suppkey"], [F.col("first"), F.col("p_name")], 12).groupBy("l_suppkey").agg(D.ordered_list("rank", "p_name").alias("tasks"))
    name = F.col("s_name")
    rows = table(spark, d, "supplier").join(tasks, F.col("s_suppkey") == F.col("l_suppkey"))
    made = F.concat(F.array(name, F.concat_ws(" ", name, F.lit("tasks")), F.concat_ws(" ", name, F.lit("skills")), F.upper(name)),
                    F.transform("tasks", lambda t: F.concat_ws(" ", name, t)))
    out = rows.select("s_suppkey", F.posexplode(F.slice(X.dedupe_list(made), 1, 14)).alias("variant_no", "variant"))
    return out.withColumn("variant_no", F.col("variant_no").cast("long"))


TERMS = ["thth", "elle", "keit", "tion", "ment"]
_SEM = SQL_HITS + f""",
z AS (SELECT s.qid, s.vec_id, s.label, score, source, text, {' + '.join(f"CAST(contains(lower(text), '{t}') AS INT)" for t in TERMS)} AS overlap,
  CASE lang WHEN 'en' THEN 3 WHEN 'fr' THEN 4 WHEN 'de' THEN 2 END AS level, CASE WHEN own % 2 = 0 THEN CAST(1.0 AS DOUBLE) ELSE 0.8 END AS weight, [3, 2 + qid % 3] AS allowed FROM s JOIN documents ON vec_id = doc_id WHERE rank <= 40),
a AS (SELECT *, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), score + least(CAST(0.22 AS DOUBLE), overlap * CAST(0.035 AS DOUBLE)) + CASE WHEN level IS NULL THEN CAST(0 AS DOUBLE) WHEN list_contains(allowed, level) THEN CAST(0.08 AS DOUBLE) ELSE CAST(-0.24 AS DOUBLE) END)) AS adjusted FROM z)"""


def semantic(spark, d):
    hits = with_own(spark, d, R.knn(queries(spark, d), corpus(spark, d), "qid", "vec_id", "embedding", 40))
    rows = hits.join(meta(spark, d), "vec_id").join(corpus(spark, d).select("vec_id", "label"), "vec_id")
    low = F.lower("text")
    rows = rows.withColumns({
        "overlap": RU.count_substrings(low, TERMS), "level": RU.first_rule([(F.col("lang") == k, v) for k, v in LEVEL.items()], F.lit(None).cast("int")),
        "weight": F.when(F.col("own") % 2 == 0, 1.0).otherwise(0.8), "allowed": F.array(F.lit(3), 2 + F.col("qid") % 3)})
    adjusted, _ = R.semantic_score(F.col("score"), F.col("overlap"), F.col("level"), F.col("allowed"), F.col("weight"))
    return rows.withColumn("adjusted", adjusted).withColumn("rank_score", F.col("adjusted") * F.col("weight"))


@reg.add("semantic_score", _SEM + " SELECT CAST(qid AS BIGINT) AS qid, vec_id, CAST(overlap AS BIGINT) AS overlap, round(adjusted, 6) AS adjusted, round(adjusted * weight, 6) AS rank_score FROM a")
def semantic_score(spark, d):
    return semantic(spark, d).select(F.col("qid").cast("long").alias("qid"), "vec_id", F.col("overlap").cast("long").alias("overlap"),
                                     F.round("adjusted", 6).alias("adjusted"), F.round("rank_score", 6).alias("rank_score"))


_TIER_ORDER = "round(adjusted * weight, 9) DESC, overlap DESC, vec_id"
_TIERED = _SEM + f""",
t AS (SELECT *, CASE WHEN level IS NULL THEN 1 WHEN list_contains(allowed, level) THEN 0 ELSE 2 END AS tier, CASE WHEN label < 5 THEN 'a' ELSE 'b' END AS collection FROM a),
"""


def _select_tiered(rows, k):
    tier = F.when(F.col("level").isNull(), 1).when(F.array_contains("allowed", F.col("level")), 0).otherwise(2)
    order = [F.round("rank_score", 9).desc(), F.col("overlap").desc(), F.col("vec_id")]
    return R.tiered_select(rows, "qid", ["vec_id"], "source", tier, order, k)


@reg.add("dd_tiered_select", _TIERED + f"""
c AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY tier, {_TIER_ORDER}) AS k FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY tier, {_TIER_ORDER}) AS rank FROM c WHERE k <= 2)
SELECT CAST(qid AS BIGINT) AS qid, vec_id, CAST(tier AS BIGINT) AS tier, rank FROM r WHERE rank <= 8""")
def dd_tiered_select(spark, d):
    return _select_tiered(semantic(spark, d), 8).select(F.col("qid").cast("long").alias("qid"), "vec_id", F.col("tier").cast("long").alias("tier"),
                                                        F.col("rank").cast("long").alias("rank"))


@reg.add("semantic_report", _TIERED + f"""
c AS (SELECT *, row_number() OVER (PARTITION BY qid, collection, source ORDER BY tier, {_TIER_ORDER}) AS k FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, collection ORDER BY tier, {_TIER_ORDER}) AS rank FROM c WHERE k <= 2),
w AS (SELECT qid, source AS title, sum(weight * CASE collection WHEN 'a' THEN 2 ELSE 1 END * adjusted) / sum(weight * CASE collection WHEN 'a' THEN 2 ELSE 1 END) AS signal, count(*) AS n FROM r WHERE rank <= 8 GROUP BY qid, source),
o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(signal, 9) DESC, title) AS place FROM w)
SELECT CAST(qid AS BIGINT) AS qid, place, title, round(signal, 6) AS signal, n FROM o WHERE place <= 8""")
def semantic_report(spark, d):
    rows = semantic(spark, d)
    parts = [_select_tiered(rows.filter(cond), 8).withColumn("w", F.col("weight") * share)
             for cond, share in ((F.col("label") < 5, 2.0), (F.col("label") >= 5, 1.0))]
    signal = parts[0].unionByName(parts[1]).groupBy("qid", F.col("source").alias("title")).agg(
        (F.sum(F.col("w") * F.col("adjusted")) / F.sum("w")).alias("signal"), F.count(F.lit(1)).alias("n"))
    top = top_n(signal, ["qid"], [F.round("signal", 9).desc(), F.col("title")], 8, "place")
    return top.select(F.col("qid").cast("long").alias("qid"), F.col("place").cast("long").alias("place"), "title", F.round("signal", 6).alias("signal"), "n")


@reg.add("evidence_groups", SQL_HITS + """,
g AS (SELECT qid, vec_id, score, 0 AS set_no FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS r FROM h WHERE label = own + 1) WHERE r <= 4
  UNION ALL SELECT qid, vec_id, score, 1 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS r FROM h WHERE label = own) WHERE r <= 4 UNION ALL SELECT qid, vec_id, score, 2 FROM s WHERE rank <= 8),
m AS (SELECT *, max(score) OVER (PARTITION BY qid, set_no) AS best FROM g),
o AS (SELECT *, row_number() OVER (PARTITION BY qid, vec_id ORDER BY set_no) AS k FROM m WHERE set_no > 0 OR best >= 0.56), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY set_no, score DESC, vec_id) AS place FROM o WHERE k = 1)
SELECT CAST(qid AS BIGINT) AS qid, vec_id, CAST(set_no AS BIGINT) AS set_no, place FROM r WHERE place <= 10""")
def evidence_groups(spark, d):
    q, c = queries(spark, d), corpus(spark, d)
    alias = R.knn(q.withColumn("label", F.col("own") + 1), c, "qid", "vec_id", "embedding", 4, within="label")
    own = R.knn(q.withColumn("label", F.col("own")), c, "qid", "vec_id", "embedding", 4, within="label")
    overview = R.knn(q, c, "qid", "vec_id", "embedding", 8)
    out = R.gated_groups([alias, own, overview], "qid", "vec_id", 0.56, {0}, 10)
    return out.select(F.col("qid").cast("long").alias("qid"), "vec_id", F.col("set_no").cast("long").alias("set_no"), F.col("place").cast("long").alias("place"))


_PACK_ROWS = _RERANK + "," + _METHODS + """,
c0 AS (SELECT s.*, lang, source FROM s JOIN documents ON vec_id = doc_id WHERE rank <= 48 AND lang <> 'de'),
cp AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score + CASE WHEN lang = 'en' THEN 0.03 ELSE 0 END DESC, vec_id) AS place, score + CASE WHEN lang = 'en' THEN 0.03 ELSE 0 END AS preferred FROM c0),
pk AS (SELECT qid, vec_id, 'evidence' AS collection, 3 AS role, reranked AS score, coalesce(source, 'none') AS source FROM f WHERE place <= 40 UNION ALL SELECT qid, vec_id, 'claims', 2, preferred, source FROM cp WHERE place <= 8
  UNION ALL SELECT qid, vec_id, 'methods', 1, score, source FROM m2 WHERE place <= 4 UNION ALL SELECT qid, vec_id, 'claims', 2, preferred - 0.01, source FROM cp WHERE place <= 8),
pb AS (SELECT *, row_number() OVER (PARTITION BY qid, collection, vec_id ORDER BY score DESC) AS b FROM pk),
pc AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY role DESC, score DESC, vec_id) AS k FROM pb WHERE b = 1),
pr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY role DESC, score DESC, vec_id) AS place FROM pc WHERE k <= CASE collection WHEN 'evidence' THEN 8 ELSE 5 END)"""


def pack(spark, d):
    shape = lambda df, name, role, score: df.select(
        "qid", "vec_id", F.lit(name).alias("collection"), F.lit(role).alias("role"), F.col(score).alias("score"), F.coalesce("source", F.lit("none")).alias("source"))
    c = claims(spark, d)
    parts = [shape(reranked(spark, d).filter("place <= 40"), "evidence", 3, "reranked"), shape(c, "claims", 2, "preferred"),
             shape(methods(spark, d), "methods", 1, "score"), shape(c.withColumn("preferred", F.col("preferred") - 0.01), "claims", 2, "preferred")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    cap = F.when(F.col("collection") == "evidence", 8).otherwise(5)
    return R.evidence_pack(rows, "qid", ["collection", "vec_id"], F.col("role"), "score", "source", cap, 8, 40, [F.col("vec_id")])


@reg.add("evidence_pack", _PACK_ROWS + " SELECT CAST(qid AS BIGINT) AS qid, collection, vec_id, place, round(score, 6) AS score FROM pr WHERE place <= 40")
def evidence_pack(spark, d):
    return pack(spark, d).select(F.col("qid").cast("long").alias("qid"), "collection", "vec_id", F.col("rank").cast("long").alias("place"), F.round("score", 6).alias("score"))


@reg.add("dd_evidence_pack", f"""
WITH k AS (SELECT doc_id, lang, source, n_chars, {Q.normalize_text('text')} AS key FROM documents),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, key ORDER BY n_chars DESC, doc_id) AS b, CASE lang WHEN 'en' THEN 5 WHEN 'fr' THEN 4 WHEN 'de' THEN 3 ELSE 1 END AS role FROM k),
c AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY role DESC, n_chars DESC, doc_id) AS k FROM b WHERE b = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY role DESC, n_chars DESC, doc_id) AS place FROM c WHERE k <= CASE WHEN source IN ('src1', 'src2') THEN 8 ELSE 5 END)
SELECT lang, doc_id, place FROM r WHERE place <= 40""")
def dd_evidence_pack(spark, d):
    rows = table(spark, d, "documents").withColumn("key", F.md5(X.normalize_text(F.col("text")))).drop("text")
    role = RU.first_rule([(F.col("lang") == k, v) for k, v in (("en", 5), ("fr", 4), ("de", 3))], 1)
    cap = F.when(F.col("source").isin("src1", "src2"), 8).otherwise(5)
    out = R.evidence_pack(rows, "lang", ["key"], role, "n_chars", "source", cap, 8, 40, [F.col("doc_id")])
    return out.select("lang", "doc_id", F.col("rank").cast("long").alias("place"))


@reg.add("dd_fingerprint", f"""
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY left({Q.normalize_text('text')}, 200) ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dd_fingerprint(spark, d):
    # The fingerprint is the opening of the normalised text by definition.
    key = F.left(X.normalize_text(F.col("text")), F.lit(200))
    return exact_dedupe(table(spark, d, "documents").select("doc_id", "text"), {"opening": key}, [F.col("doc_id")]).select("doc_id")


@reg.add("knn_every", SQL_HITS.replace(" WHERE vec_id % 20 = 0", "") + f" SELECT {_COLS} FROM s WHERE rank <= 5")
def knn_every(spark, d):
    """Every vector as a query."""
    every = corpus(spark, d).select(F.col("vec_id").alias("qid"), "embedding")
    return _shape(R.knn(every, corpus(spark, d), "qid", "vec_id", "embedding", 5))


@reg.add("knn_lsh_recall")
def knn_lsh_recall(spark, d):
    """Recall of the approximate search against the exact one, per query and over all queries."""
    q, c = queries(spark, d), corpus(spark, d)
    found = R.recall_of(R.approximate_knn(q, c, "qid", "vec_id", "embedding", 10), R.knn(q, c, "qid", "vec_id", "embedding", 10), "qid", "vec_id")
    total = found.agg((F.sum("found") / F.sum("exact_hits")).alias("recall_of_all"))
    return found.crossJoin(F.broadcast(total))  # one row
