"""Deduplication, entity matching and quotes on documents, parts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierspark.functions import fixed_terms as V
from dossierspark.functions import text as X
from dossierspark.operators import groups as G
from dossierspark.operators import matching as M
from dossierspark.operators import quotes as QU
from dossierspark.operators import similarity as S
from dossierspark.operators.evidence import exact_dedupe
from dossierspark.operators.ranking import best_row
from dossierspark.plans import sql_text as Q
from dossierspark.plans.registry import Registry
from dossierspark.session import durable, spread, table

reg = Registry()

NORM = Q.normalize_text("text")


@reg.add("dd_exact_first", f"""
SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang, {NORM} ORDER BY doc_id) AS r FROM documents) WHERE r = 1""")
def dd_exact_first(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    keys = {"lang": F.col("lang"), "text": F.sha2(X.normalize_text(F.col("text")), 256)}
    return exact_dedupe(docs, keys, [F.col("doc_id")]).select("doc_id", "lang")


@reg.add("dd_exact_best", f"""
SELECT doc_id, lang, coalesce(quality, -1) AS quality FROM (SELECT d.doc_id, lang, quality, row_number() OVER (PARTITION BY lang, {NORM} ORDER BY coalesce(quality, -1) DESC, coalesce(toxic, 2), n_chars DESC, d.doc_id) AS r
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE r = 1""")
def dd_exact_best(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    keys = {"lang": F.col("lang"), "text": F.sha2(X.normalize_text(F.col("text")), 256)}
    quality = F.coalesce("quality", F.lit(-1))
    order = [quality.desc(), F.coalesce("toxic", F.lit(2)), F.col("n_chars").desc(), F.col("doc_id")]
    return exact_dedupe(docs, keys, order).select("doc_id", "lang", quality.alias("quality"))


@reg.add("dd_first_id", """
SELECT id, source FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source) AS r FROM (SELECT o_custkey AS id, 1 AS source FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 2 FROM customer)) WHERE r = 1""")
def dd_first_id(spark, d):
    first = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit(1).alias("source"))
    both = first.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.lit(2).alias("source")))
    return best_row(both, ["id"], [F.col("source")])


def doc_tokens(spark, d):
    return spread(table(spark, d, "documents")).select(
        "doc_id", "lang", "n_chars", X.normalize_text(F.col("text")).alias("norm")).withColumn("tokens", F.array_distinct(F.split("norm", " ")))


_SETS = f"""
WITH t AS (SELECT doc_id, lang, {NORM} AS norm, list_sort(list_distinct(string_split({NORM}, ' '))) AS tok FROM documents),
g AS (SELECT lang, array_to_string(tok, ' ') AS key, any_value(tok) AS tok, min(doc_id) AS rep FROM t GROUP BY ALL)"""


@reg.add("dd_jaccard_pairs", _SETS.replace("any_value(tok) AS tok, ", "").replace("GROUP BY ALL", "GROUP BY lang, array_to_string(tok, ' ')") + """,
r AS (SELECT t.* FROM t JOIN g ON t.doc_id = g.rep), p AS (SELECT a.lang, a.doc_id AS id_a, b.doc_id AS id_b, len(list_intersect(a.tok, b.tok)) AS c, len(a.tok) AS x, len(b.tok) AS y
  FROM r a JOIN r b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.tok), len(b.tok)) >= 0.94 * greatest(len(a.tok), len(b.tok)) - 1e-9)
SELECT lang, id_a, id_b, round(c / CAST(x + y - c AS DOUBLE), 6) AS similarity FROM p WHERE c >= 0.94 * (x + y - c)
UNION ALL SELECT t.lang, g.rep, t.doc_id, 1.0 FROM t JOIN g ON t.lang = g.lang AND array_to_string(t.tok, ' ') = g.key WHERE t.doc_id <> g.rep""")
def dd_jaccard_pairs(spark, d):
    return S.jaccard_pairs(doc_tokens(spark, d), "doc_id", "lang", "tokens", 0.94).withColumn("similarity", F.round("similarity", 6))


@reg.add("dd_vector_pairs", """
WITH k AS (SELECT label, embedding AS key, min(vec_id) AS rep FROM embeddings GROUP BY ALL), r AS (SELECT e.* FROM embeddings e JOIN k ON vec_id = rep)
SELECT a.label, a.vec_id AS id_a, b.vec_id AS id_b, round(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM r a JOIN r b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.25
UNION ALL SELECT e.label, rep, vec_id, 1.0 FROM embeddings e JOIN k ON e.label = k.label AND e.embedding = k.key WHERE vec_id <> rep""")
def dd_vector_pairs(spark, d):
    # The shared vectors hold no pair at 0.94, so the check runs at a threshold with hits.
    return S.vector_pairs(table(spark, d, "embeddings"), "vec_id", "label", "embedding", 0.25).withColumn("similarity", F.round("similarity", 6))


#: The fold as a recursive statement: row after row of a group, with the groups so far as a list of (first, leader, priority, members).
_FOLD = """
linked AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY block ORDER BY id) AS pos, coalesce(near, []) AS links FROM rows LEFT JOIN (SELECT x, list(y) AS near FROM linked GROUP BY x) ON id = x),
f(block, pos, gs) AS (
  SELECT DISTINCT block, CAST(0 AS BIGINT), CAST([] AS STRUCT(first BIGINT, leader BIGINT, priority BIGINT, members BIGINT)[]) FROM rows
  UNION ALL
  SELECT block, pos + 1, CASE WHEN home IS NULL THEN list_append(gs, struct_pack(first := id, leader := id, priority := priority, members := CAST(1 AS BIGINT)))
    ELSE list_transform(gs, lambda g: CASE WHEN g.first <> home THEN g WHEN priority > g.priority THEN struct_pack(first := g.first, leader := id, priority := priority, members := g.members + 1)
      ELSE struct_pack(first := g.first, leader := g.leader, priority := g.priority, members := g.members + 1) END) END
  FROM (SELECT f.block, f.pos, f.gs, o.id, o.priority, list_filter(f.gs, lambda g: list_contains(o.links, g.leader))[1].first AS home
    FROM f JOIN o ON o.block = f.block AND o.pos = f.pos + 1)),
e AS (SELECT unnest(gs) AS g FROM (SELECT arg_max(gs, pos) AS gs FROM f GROUP BY block))
SELECT g.leader AS doc_id, g.first AS leader_seq, g.members AS members FROM e"""
_TOKENS = f"t AS MATERIALIZED (SELECT doc_id AS id, lang AS block, n_chars, {NORM} AS norm, list_sort(list_distinct(string_split({NORM}, ' '))) AS tok FROM documents)"
_PAIRS = " pairs AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.block = b.block AND a.id < b.id AND "
_NEAR = ("(least(len(a.tok), len(b.tok)) >= {t} * greatest(len(a.tok), len(b.tok)) - 1e-9 AND "
         "len(list_intersect(a.tok, b.tok)) >= {t} * (len(a.tok) + len(b.tok) - len(list_intersect(a.tok, b.tok))))")


@reg.add("dd_near_dedupe", f"WITH RECURSIVE {_TOKENS}, rows AS (SELECT id, block, -n_chars AS priority FROM t),{_PAIRS}{_NEAR.format(t=0.94)}),{_FOLD}")
def dd_near_dedupe(spark, d):
    rows = doc_tokens(spark, d)
    pairs = S.jaccard_pairs(rows, "doc_id", "lang", "tokens", 0.94)
    return G.leader_dedupe(rows, [G.hubs_of(pairs)], "doc_id", [-F.col("n_chars")], F.col("doc_id"))


@reg.add("dd_near_vectors", f"""WITH RECURSIVE {_TOKENS}, v AS (SELECT t.*, CAST(embedding AS DOUBLE[]) AS v FROM t JOIN embeddings ON vec_id = id), rows AS (SELECT id, block, -n_chars AS priority FROM t),
pairs AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM t a JOIN t b ON a.block = b.block AND a.id < b.id AND {_NEAR.format(t=0.94)}
  UNION SELECT a.id, b.id FROM v a JOIN v b ON a.block = b.block AND a.id < b.id AND list_inner_product(a.v, b.v) >= 0.4),{_FOLD}""")
def dd_near_vectors(spark, d):
    """Links by tokens or by vectors of the same number; the shared vectors hold few pairs beyond 0.4."""
    rows = doc_tokens(spark, d)
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(rows.select("doc_id", "lang"), "doc_id")
    relations = [G.hubs_of(S.jaccard_pairs(rows, "doc_id", "lang", "tokens", 0.94)), G.hubs_of(S.vector_pairs(vectors, "doc_id", "lang", "embedding", 0.4))]
    return G.leader_dedupe(rows, relations, "doc_id", [-F.col("n_chars")], F.col("doc_id"))


def sentence_claims(spark, d):
    s = spread(table(spark, d, "documents")).select("doc_id", "source", "n_chars", F.posexplode(X.sentences(F.col("text"))).alias("position", "claim"))
    return s.withColumn("key", X.text_key(F.col("claim"))).filter("key <> ''")


@reg.add("dd_claims_exact", f"""
WITH s AS (SELECT doc_id, source, n_chars, generate_subscripts(l, 1) - 1 AS position, {Q.text_key('unnest(l)')} AS key FROM (SELECT doc_id, source, n_chars, {Q.sentences('text')} AS l FROM documents))
SELECT source, doc_id, position FROM (SELECT *, row_number() OVER (PARTITION BY source, key ORDER BY n_chars DESC, doc_id, position) AS r FROM s WHERE key <> '') WHERE r = 1""")
def dd_claims_exact(spark, d):
    order = [F.col("n_chars").desc(), F.col("doc_id"), F.col("position")]
    return best_row(sentence_claims(spark, d), ["source", "key"], order).select("source", "doc_id", F.col("position").cast("long").alias("position"))


@reg.add("dd_claims_jaccard", _SETS.replace("any_value(tok) AS tok, ", "").replace("GROUP BY ALL", "GROUP BY lang, array_to_string(tok, ' ')") + """,
r AS (SELECT t.* FROM t JOIN g ON t.doc_id = g.rep WHERE len(tok) >= 6), x AS (SELECT lang, norm, min(doc_id) AS doc_id FROM t WHERE length(norm) >= 40 GROUP BY lang, norm)
SELECT 'jaccard' AS kind, lang, id_a, id_b FROM (SELECT a.lang, a.doc_id AS id_a, b.doc_id AS id_b, len(list_intersect(a.tok, b.tok)) AS c, len(a.tok) AS x, len(b.tok) AS y
  FROM r a JOIN r b ON a.lang = b.lang AND a.doc_id < b.doc_id AND least(len(a.tok), len(b.tok)) >= 0.92 * greatest(len(a.tok), len(b.tok)) - 1e-9) WHERE c >= 0.92 * (x + y - c)
UNION ALL SELECT 'jaccard', t.lang, g.rep, t.doc_id FROM t JOIN g ON t.lang = g.lang AND array_to_string(t.tok, ' ') = g.key WHERE t.doc_id <> g.rep AND len(t.tok) >= 6
UNION ALL SELECT 'contained', a.lang, least(a.doc_id, b.doc_id), greatest(a.doc_id, b.doc_id) FROM x a JOIN x b ON a.lang = b.lang AND length(a.norm) < length(b.norm) AND length(a.norm) + 1e-9 >= 0.9 * length(b.norm) AND contains(b.norm, a.norm)""")
def dd_claims_jaccard(spark, d):
    rows = doc_tokens(spark, d)
    near = S.jaccard_pairs(rows, "doc_id", "lang", "tokens", 0.92, least_tokens=6).select(F.lit("jaccard").alias("kind"), "lang", "id_a", "id_b")
    inside = S.containment_pairs(rows, "doc_id", "lang", "norm").select(F.lit("contained").alias("kind"), "lang", "id_a", "id_b")
    return near.unionByName(inside)


@reg.add("dd_claims_greedy", f"""WITH RECURSIVE {_TOKENS}, rows AS (SELECT id, block, n_chars AS priority FROM t),{_PAIRS}(a.norm = b.norm
  OR (least(length(a.norm), length(b.norm)) >= 40 AND least(length(a.norm), length(b.norm)) >= 0.9 * greatest(length(a.norm), length(b.norm)) AND (contains(a.norm, b.norm) OR contains(b.norm, a.norm)))
  OR (least(len(a.tok), len(b.tok)) >= 6 AND {_NEAR.format(t=0.92)}))),{_FOLD}""")
def dd_claims_greedy(spark, d):
    rows = doc_tokens(spark, d)
    near = S.jaccard_pairs(rows, "doc_id", "lang", "tokens", 0.92, least_tokens=6)
    copies = G.copies_of(rows, "doc_id", [F.col("lang"), F.unhex(F.sha2("norm", 256))])
    relations = [G.hubs_of(near), G.text_hubs(copies, S.containment_pairs(rows, "doc_id", "lang", "norm"))]
    return G.leader_dedupe(rows, relations, "doc_id", [F.col("n_chars")], F.col("doc_id"))


def turn_claims(spark, d):
    """Each turn as a claim of its conversation; every second one comes back with one word changed."""
    t = spread(table(spark, d, "conversations"))
    base = t.select("conv_id", (F.col("conv_id") * 100000 + F.col("turn") * 10).alias("id"), "role", "text")
    edited = base.withColumns({"id": F.col("id") + 1, "text": F.concat(F.col("text"), F.lit(" again"))})
    both = base.unionByName(edited)
    claim = F.array_join(F.array_except(F.split(X.text_key(F.col("text")), " "), F.array(*[F.lit(w) for w in V.STOP_WORDS])), " ")
    return both.select("conv_id", "id", "role", claim.alias("claim"), X.text_key(F.get(X.sentences(F.col("text")), 0)).alias("quote"), F.length("text").alias("n"))


@reg.add("dd_claims")
def dd_claims(spark, d):
    # Written once: links by ratio, links by quote and the groups read the rows, each several times.
    rows = durable(turn_claims(spark, d))
    near = S.ratio_pairs(rows, "id", "conv_id", "claim", 0.90)
    same_quote = G.copies_of(rows.filter("quote <> ''"), "id", [F.col("conv_id"), F.col("quote")])
    role = F.when(F.col("role") == "assistant", 2).when(F.col("role") == "user", 1).otherwise(0)
    return G.member_groups(rows, [G.hubs_of(near), same_quote], "id", [role, F.col("n")], F.col("id"))


# ---- matching --------------------------------------------------------------

_ROWS = """
WITH ref AS (SELECT p_brand AS g, p_partkey AS item, lower(p_name || ' ' || p_type) AS t FROM part),
r AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN p_brand ELSE 'Brand#none' END AS g, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN p_partkey ELSE -1 END AS item,
  CASE WHEN o_totalprice > 100000 THEN lower(p_name || ' ' || p_type) ELSE '' END AS t FROM orders JOIN part ON p_partkey = o_custkey)"""


def match_inputs(spark, d, typo: bool = False):
    part = table(spark, d, "part")
    text = F.lower(F.concat_ws(" ", "p_name", "p_type"))
    ref = part.select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("item"), text.alias("t"))
    rows = table(spark, d, "orders").join(part, F.col("p_partkey") == F.col("o_custkey"))
    shown = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("a "), F.regexp_replace(text, "e", "ee"))).otherwise(text) if typo else text
    return rows.select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("p_brand")).otherwise(F.lit("Brand#none")).alias("g"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.col("p_partkey")).otherwise(F.lit(-1).cast("long")).alias("item"),
        F.when(F.col("o_totalprice") > 100000, shown).otherwise(F.lit("")).alias("t")), ref


@reg.add("match_exact_stages", _ROWS + """,
a AS (SELECT g, item FROM ref GROUP BY ALL), b AS (SELECT g, t, min(item) AS item FROM ref GROUP BY g, t), c AS (SELECT t, min(item) AS item FROM ref GROUP BY t), cg AS (SELECT c.t, c.item, ref.g FROM c JOIN ref ON c.item = ref.item)
SELECT r.o_orderkey, coalesce(a.item, b.item, cg.item) AS matched_item, CASE WHEN a.item IS NOT NULL OR b.item IS NOT NULL THEN r.g ELSE cg.g END AS matched_group,
  CAST(CASE WHEN a.item IS NOT NULL THEN 1 WHEN b.item IS NOT NULL THEN 2 WHEN cg.item IS NOT NULL THEN 3 END AS BIGINT) AS stage,
  CASE WHEN a.item IS NOT NULL OR b.item IS NOT NULL THEN 'high' WHEN cg.item IS NOT NULL THEN 'medium' END AS confidence
FROM r LEFT JOIN a ON r.g = a.g AND r.item = a.item LEFT JOIN b ON r.g = b.g AND r.t = b.t AND r.t <> '' LEFT JOIN cg ON r.t = cg.t AND r.t <> ''""")
def match_exact_stages(spark, d):
    rows, ref = match_inputs(spark, d)
    out = M.exact_stages(rows, ref, "o_orderkey", "g", "item", "t", ["item"])
    return out.select("o_orderkey", "matched_item", "matched_group", F.col("stage").cast("long").alias("stage"), "confidence")


@reg.add("match_staged")
def match_staged(spark, d):
    rows, ref = match_inputs(spark, d, typo=True)
    out, warnings = M.staged_match(rows, ref, "o_orderkey", "g", "item", "t", ["item"])
    return out.join(warnings, "o_orderkey", "left").select("o_orderkey", "matched_item", "stage", "confidence", F.round("similarity", 4).alias("similarity"), "warning")


@reg.add("fuzzy_best")
def fuzzy_best(spark, d):
    rows, ref = match_inputs(spark, d, typo=True)
    return M.fuzzy_best(rows, ref, "o_orderkey", "g", "t", "item").withColumn("similarity", F.round("similarity", 6))


def titles(spark, d):
    part = table(spark, d, "part")
    official = part.select(F.col("p_name").alias("entity"), F.col("p_name").alias("name"), F.lit(True).alias("official")).distinct()
    aliases = part.select(F.col("p_name").alias("entity"), F.concat_ws(" ", "p_type", "p_name").alias("name"), F.lit(False).alias("official")).distinct()
    return official.unionByName(aliases).withColumn("place", F.col("entity"))


def requests(spark, d):
    """Names as users write them: plural, with a kind, with a typing error, as a part of a longer text."""
    size = F.col("p_size") % 5
    name, kind = F.col("p_name"), F.col("p_type")
    text = (F.when(size == 0, F.concat(F.upper(name), F.lit("s"))).when(size == 1, F.concat_ws(" & ", kind, name))
            .when(size == 2, F.concat_ws(" ", kind, F.concat(name, F.lit("s")))).when(size == 3, F.concat(F.lit("senior "), name, F.lit(" lead")))
            .otherwise(F.regexp_replace(name, "^(.)(.)", "$2$1")))
    return table(spark, d, "part").select(text.alias("request")).distinct()


_VARIANTS = """list_distinct([key, head || CASE WHEN w LIKE '%ies' AND length(w) > 3 THEN w[:-4] || 'y' WHEN w LIKE '%ses' THEN w[:-3] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END,
  head || CASE WHEN w LIKE '%y' AND length(w) > 1 THEN w[:-2] || 'ies' WHEN w LIKE '%s' THEN w ELSE w || 's' END])"""


def _variants(source):
    return f"SELECT *, unnest({_VARIANTS}) AS variant FROM (SELECT *, regexp_replace(key, '[^ ]+$', '') AS head, regexp_extract(key, '([^ ]+)$', 1) AS w FROM {source})"


@reg.add("alias_exact", f"""
WITH req AS (SELECT DISTINCT CASE p_size % 5 WHEN 0 THEN upper(p_name) || 's' WHEN 1 THEN p_type || ' & ' || p_name WHEN 2 THEN p_type || ' ' || p_name || 's' WHEN 3 THEN 'senior ' || p_name || ' lead' ELSE regexp_replace(p_name, '^(.)(.)', '\\2\\1') END AS request FROM part),
rk AS (SELECT request, {Q.text_key("replace(lower(request), '&', ' and ')")} AS key FROM req), rv AS ({_variants('rk')}),
n AS (SELECT DISTINCT p_name AS entity, {Q.text_key('p_name')} AS key, true AS official FROM part UNION ALL SELECT DISTINCT p_name, {Q.text_key("p_type || ' ' || p_name")}, false FROM part), nv AS ({_variants('n')}),
o AS (SELECT request, min(entity) AS entity FROM rv JOIN nv USING (variant) WHERE official GROUP BY 1), a AS (SELECT request, min(entity) AS entity FROM rv JOIN nv USING (variant) WHERE NOT official GROUP BY 1)
SELECT request, coalesce(o.entity, a.entity) AS entity, CASE WHEN o.entity IS NOT NULL THEN 'official_title_exact' ELSE 'alias_exact' END AS method FROM req LEFT JOIN o USING (request) LEFT JOIN a USING (request) WHERE coalesce(o.entity, a.entity) IS NOT NULL""")
def alias_exact(spark, d):
    asked, names = requests(spark, d), titles(spark, d)
    official = M.by_variant(asked, names.filter("official"), "request").withColumnRenamed("entity", "o")
    alias = M.by_variant(asked, names.filter("NOT official"), "request").withColumnRenamed("entity", "a")
    both = asked.join(official, "request", "left").join(alias, "request", "left").filter("o IS NOT NULL OR a IS NOT NULL")
    return both.select("request", F.coalesce("o", "a").alias("entity"),
                       F.when(F.col("o").isNotNull(), "official_title_exact").otherwise("alias_exact").alias("method"))


@reg.add("alias_resolve")
def alias_resolve(spark, d):
    return M.resolve_aliases(requests(spark, d), titles(spark, d), "request")


@reg.add("join_containment", f"""
WITH need AS (SELECT DISTINCT unnest(list_concat(string_split(p_name, ' '), [p_name || 's', p_name[2:-2], left(p_type, 2)])) AS needle FROM part), t AS (SELECT DISTINCT p_name AS title FROM part UNION SELECT DISTINCT lower(p_type) FROM part)
SELECT needle, title FROM (SELECT needle, title, row_number() OVER (PARTITION BY needle ORDER BY title) AS r FROM (SELECT DISTINCT lower(needle) AS needle FROM need WHERE needle <> '') JOIN t ON contains(title, needle) OR contains(needle, title)) WHERE r = 1""")
def join_containment(spark, d):
    part = table(spark, d, "part")
    name = F.col("p_name")
    made = F.concat(F.split(name, " "), F.array(F.concat(name, F.lit("s")), F.substr(name, F.lit(2), F.length(name) - 2), F.substring("p_type", 1, 2)))
    needles = part.select(F.explode(made).alias("needle")).select(F.lower("needle").alias("needle")).distinct()
    names = part.select(name.alias("title")).union(part.select(F.lower("p_type"))).distinct()
    return M.containment_join(needles, names, "needle", "title", [F.col("title")]).select("needle", "title")


@reg.add("join_jaccard", """
WITH t AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name || ' ' || p_type || ' band' || CAST(p_size // 10 AS VARCHAR)), ' ')) AS tok FROM part),
p AS (SELECT a.p_partkey, b.p_partkey AS ref_id, len(list_intersect(a.tok, b.tok)) AS c, len(a.tok) AS x, len(b.tok) AS y FROM t a JOIN t b ON a.p_brand = b.p_brand),
s AS (SELECT *, c / CAST(x + y - c AS DOUBLE) AS similarity FROM p WHERE c >= 0.58 * (x + y - c)), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY similarity DESC, ref_id) AS place FROM s)
SELECT p_partkey, ref_id, round(similarity, 6) AS similarity, place FROM r WHERE place <= 4""")
def join_jaccard(spark, d):
    band = F.concat(F.lit("band"), F.floor(F.col("p_size") / 10).cast("string"))
    rows = table(spark, d, "part").select("p_partkey", "p_brand", F.split(F.lower(F.concat_ws(" ", "p_name", "p_type", band)), " ").alias("tok"))
    out = M.jaccard_best(rows, rows.withColumnRenamed("p_partkey", "ref_id"), "p_partkey", "p_brand", "tok", "ref_id")
    return out.select("p_partkey", "ref_id", F.round("similarity", 6).alias("similarity"), F.col("place").cast("long").alias("place"))


# ---- quotes ----------------------------------------------------------------

@reg.add("quote_exact", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_exact(spark, d):
    quotes = table(spark, d, "benchmark").withColumnRenamed("text", "quote")
    return QU.find_quotes(quotes, table(spark, d, "documents"), "item_id", "quote", "doc_id", "text")


@reg.add("quote_validate")
def quote_validate(spark, d):
    """A sentence of every turn, written differently by role and turn, against the turn it comes from."""
    t = table(spark, d, "conversations")
    s = F.coalesce(F.get(X.sentences(F.col("text")), 1), F.lit(""))
    quote = (F.when(F.col("turn") % 5 == 0, s).when(F.col("turn") % 5 == 1, F.regexp_replace(s, " ", "  "))
             .when(F.col("turn") % 5 == 2, F.concat_ws("...", F.substring(F.upper(s), 1, 12), F.substr(s, F.lit(25))))
             .when(F.col("turn") % 5 == 3, F.regexp_replace(s, "e", "ee")).otherwise(F.reverse(s)))
    rows = t.select("conv_id", "turn", quote.alias("quote"), F.col("text").alias("chunk"))
    valid, failed = QU.validate_quotes(rows, "quote", "chunk", ["conv_id", "turn"], {end: end for end in QU.LOOSE_ENDS})
    return valid.unionByName(failed).select("conv_id", "turn", "status", "score", "detail")
