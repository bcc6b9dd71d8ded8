"""Rule labels, filters and label cleaning. Term lists are parameters: here words of the shared texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossierspark.functions import rules as RU
from dossierspark.functions import text as X
from dossierspark.operators import evidence as E
from dossierspark.operators import labels as L
from dossierspark.plans import sql_text as Q
from dossierspark.plans.core import FACTS, named_facts
from dossierspark.plans.registry import Registry
from dossierspark.session import spread, table

reg = Registry()

TYPES = {"src0": "llm_exposure", "src1": "job_loss", "src2": "wage_effect", "src3": "task_displacement",
         "src4": "worker_vulnerability", "src5": "employment_effect", "src6": "unlisted", "src7": "skill_change",
         "src8": "unlisted", "src9": "human_advantage", "src10": "task_transformation"}
DIRECTIONS = {"src0": "negative", "src1": "negative", "src2": "uncertain", "src3": "uncertain", "src4": "positive",
              "src5": "mixed", "src6": "unlisted", "src7": "negative"}
AFFECTED = {"en": "worker_group", "fr": "task", "de": "occupation"}
TERMS = {
    "legacy_exposure_labels": ["llm_exposure"], "bias": ["thth"], "surveillance": ["thhe", "thbe"], "safety": ["thha"],
    "ethics": ["thed"], "transition": ["ther", "than", "thsh"], "occupational_transition": ["ther"], "declining": ["than"],
    "rising": ["thes", "then"], "stranded": ["thin", "from"], "worker": ["with"], "slow": ["was"],
    "exposure_patterns": ["thea", "th[ ]+is", "de[ ]+la"], "automation": ["that", "for"], "risk": ["this", "are"],
    "training": ["les", "une", "thor"], "inequality": ["del"], "vulnerability": ["it", "zu"],
    "loss_patterns": ["die[^\n]*[^a-z0-9_]und", "los"], "creation_patterns": ["tion[^\n]*[^a-z0-9_]en"],
    "wage": ["der", "el", "la"], "skill": ["sich"], "task_loss": ["que"], "task_change": ["le"],
    "productivity": ["of", "en"], "job_roles": ["of[ ]+the"],
}
D_TERMS = {"negative": ["th", "das", "des", "st"], "positive": ["nd", "und", "que", "as"], "uncertain": ["is", "en", "de", "to"],
           "transition_harm": ["thin", "st"], "limiting": ["he", "or"]}
STRONG = ["worker_vulnerability", "job_loss", "skill_change", "wage_effect"]
VALID = STRONG + ["task_displacement", "employment_effect", "human_advantage", "task_transformation"]


def _map_sql(c, pairs, default):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE '{default}' END"


def _map_col(c, pairs, default):
    return RU.first_rule([(F.col(c) == k, v) for k, v in pairs.items()], default)


SQL_CLAIMS = f"""
WITH s AS (SELECT doc_id, source, lang, generate_subscripts(l, 1) - 1 AS position, unnest(l) AS claim, l[1] AS quote FROM (SELECT doc_id, source, lang, {Q.sentences('text')} AS l FROM documents)),
c AS (SELECT doc_id, position, {_map_sql('source', TYPES, 'augmentation_potential')} AS original, {_map_sql('source', DIRECTIONS, 'positive')} AS direction,
  {_map_sql('lang', AFFECTED, 'general_labor_market')} AS affected, source AS entity, claim AS claim_text,
  lower(trim(claim) || ' ' || source) AS claim, lower(quote) AS quote, lower(trim(claim) || ' ' || source || ' ' || quote) AS text FROM s)"""


def claims(spark, d):
    """Every sentence of the documents as a claim; its quote is the first sentence of the document."""
    s = spread(table(spark, d, "documents")).select("doc_id", "source", "lang", X.sentences(F.col("text")).alias("l"))
    # The quote is brought to its forms once a document. An inner posexplode would be given a filter that splits the text once more.
    s = L.quote_texts(s.withColumn("evidence_quote", F.get("l", 0)))
    rows = s.select("doc_id", "source", "lang", "evidence_quote", "_quote", "_quote_words", F.posexplode_outer("l").alias("position", "claim_text")).filter("position IS NOT NULL")
    return rows.select(
        "doc_id", F.col("position").cast("long").alias("position"), "claim_text", "evidence_quote", "_quote", "_quote_words",
        F.col("source").alias("affected_entity_text"), F.lit(None).cast("array<string>").alias("mentions"),
        _map_col("source", TYPES, "augmentation_potential").alias("impact_type"),
        _map_col("source", DIRECTIONS, "positive").alias("impact_direction"),
        _map_col("lang", AFFECTED, "general_labor_market").alias("affected_entity_type"))


PATTERNS = {"direct_ai": ["thnt", "keit"], "direct_ai_words": ["thou"], "automation_or_technology": ["ereau", "lich", "ndth"],
            "indirect_labor_context": ["que"], "indirect_labor_context_words": ["the", "die"]}
SQL_RELEVANCE = f"""CASE WHEN {Q.sub('text', 'thnt', 'keit')} OR {Q.word('text', 'thou')} THEN 'direct_ai' WHEN {Q.sub('text', 'ereau', 'lich', 'ndth')} THEN 'automation_or_technology'
  WHEN contains(text, 'que') OR {Q.word('text', 'the', 'die')} THEN 'indirect_labor_context' ELSE 'non_ai_context' END"""


def related_claims(spark, d):
    c = L.claim_texts(claims(spark, d))
    return c.withColumn("ai_relevance", L.relevance_class(F.col("_text"), F.col("_text_words"), PATTERNS))


@reg.add("relevance_class", SQL_CLAIMS + f" SELECT doc_id, position, {SQL_RELEVANCE} AS ai_relevance FROM c")
def relevance_class(spark, d):
    return related_claims(spark, d).select("doc_id", "position", "ai_relevance")


def _w(k, c="claim"):
    if k in ("exposure_patterns", "loss_patterns", "creation_patterns", "job_roles"):
        return f"regexp_matches({c}, '(?:^|[^a-z0-9_])(?:{'|'.join(TERMS[k])})(?:[^a-z0-9_]|$)')"
    return Q.word(c, *TERMS[k])


def _in(values):
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


SQL_IMPACT = SQL_CLAIMS + f""",
r AS (SELECT *, {SQL_RELEVANCE} AS ai_relevance, {_w('transition')} AS moving, {_w('automation')} AND {_w('risk')} AS risky, {_w('exposure_patterns')} AS exposed FROM c),
i AS (SELECT *, CASE WHEN original = 'llm_exposure' THEN 'automation_exposure' WHEN {_w('bias')} THEN 'bias_concern' WHEN {_w('surveillance')} THEN 'surveillance_concern'
  WHEN {_w('safety')} THEN 'safety_concern' WHEN {_w('ethics')} THEN 'ethical_concern'
  WHEN moving AND ({_w('stranded')} OR ({_w('worker')} AND {_w('slow')})) THEN 'worker_vulnerability'
  WHEN moving AND {_w('declining')} AND {_w('rising')} THEN 'task_transformation' WHEN moving AND {_w('occupational_transition')} THEN 'employment_effect'
  WHEN moving AND original IN ('task_displacement', 'task_transformation') THEN 'task_transformation' WHEN moving AND original = 'employment_effect' THEN original
  WHEN risky AND original IN ('job_loss', 'worker_vulnerability', 'employment_effect') THEN original WHEN risky THEN 'automation_risk'
  WHEN exposed THEN 'automation_exposure' WHEN {_w('training')} AND original IN {_in(STRONG)} THEN original WHEN {_w('training')} THEN 'education_or_training_need'
  WHEN {_w('inequality')} THEN 'inequality_or_polarization' WHEN {_w('vulnerability')} AND (affected = 'worker_group' OR original = 'worker_vulnerability') THEN 'worker_vulnerability'
  WHEN {_w('loss_patterns')} AND original = 'wage_effect' AND {_w('wage')} THEN 'wage_effect' WHEN {_w('loss_patterns')} THEN 'job_loss'
  WHEN {_w('creation_patterns')} THEN 'job_creation' WHEN {_w('wage')} THEN 'wage_effect' WHEN affected = 'skill' OR {_w('skill')} THEN 'skill_change'
  WHEN affected = 'task' AND {_w('task_loss')} THEN 'task_displacement' WHEN affected = 'task' AND {_w('task_change')} THEN 'task_transformation'
  WHEN {_w('productivity')} AND NOT {_w('job_roles')} THEN 'productivity_effect' WHEN original IN {_in(VALID)} THEN original
  WHEN {_w('productivity', 'quote')} AND NOT {_w('job_roles', 'quote')} THEN 'productivity_effect' WHEN ai_relevance = 'indirect_labor_context' THEN 'labor_market_context' ELSE 'other' END AS impact_clean FROM r)"""


#: Sentences of this binding: the rule's own name.
WHY = {rule: rule for rule in L.IMPACT_RULES}
WHY_DIRECTION = {rule: rule for rule in L.DIRECTION_RULES}


@reg.add("impact_clean", SQL_IMPACT + " SELECT doc_id, position, impact_clean FROM i")
def impact_clean(spark, d):
    out = L.impact_type(related_claims(spark, d), WHY, TERMS, STRONG, VALID)
    return out.select("doc_id", "position", F.col("impact_type_clean").alias("impact_clean"))


def _any(words, c):
    return Q.word(c, *words)


def _first_words(words, *texts):
    one = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {Q.word(c, w)} THEN '''{w}''' END" for w in words) + "], lambda x: x IS NOT NULL)"
    pick = one(texts[-1]) if len(texts) == 1 else f"CASE WHEN {_any(words, texts[0])} THEN {one(texts[0])} ELSE {one(texts[1])} END"
    return f"array_to_string(({pick})[1:3], ', ')"


_NEG, _POS, _UNC = D_TERMS["negative"], D_TERMS["positive"], D_TERMS["uncertain"]
_ANYNEG = f"({_any(_NEG, 'claim')} OR {_any(_NEG, 'text')})"
_REASON_NEG = _first_words(_NEG, "claim", "text")


@reg.add("direction_clean", SQL_IMPACT + f""",
x AS (SELECT doc_id, position, CASE
  WHEN moving AND {_any(D_TERMS['transition_harm'], 'claim')} THEN 'negative|harm ' || {_first_words(D_TERMS['transition_harm'], 'claim')}
  WHEN moving AND {_w('declining')} AND {_w('rising')} THEN 'mixed|shift' WHEN moving AND {_w('occupational_transition')} THEN 'uncertain|occupational'
  WHEN impact_clean = 'automation_exposure' AND NOT {_any(_NEG, 'text')} THEN 'uncertain|exposure'
  WHEN direction = 'uncertain' AND {_any(_UNC, 'text')} AND {_any(_NEG, 'claim')} AND {_any(_POS, 'claim')} THEN 'mixed|both_uncertain'
  WHEN direction = 'uncertain' AND {_any(_UNC, 'text')} THEN 'uncertain|uncertain ' || {_first_words(_UNC, 'text')}
  WHEN direction = 'negative' AND {_ANYNEG} AND {_any(_POS, 'claim')} AND NOT {_any(D_TERMS['limiting'], 'claim')} THEN 'mixed|both ' || {_REASON_NEG}
  WHEN direction = 'negative' AND {_ANYNEG} THEN 'negative|negative ' || {_REASON_NEG}
  WHEN direction = 'negative' AND exposed THEN 'uncertain|potential' WHEN direction = 'negative' THEN 'negative|kept negative'
  WHEN {_ANYNEG} AND {_any(_POS, 'claim')} THEN 'mixed|both ' || {_REASON_NEG} WHEN {_ANYNEG} THEN 'negative|negative ' || {_REASON_NEG}
  WHEN {_any(_POS, 'claim')} OR {_any(_POS, 'text')} THEN 'positive|positive ' || {_first_words(_POS, 'claim', 'text')}
  WHEN {_any(_UNC, 'text')} THEN 'uncertain|uncertain ' || {_first_words(_UNC, 'text')}
  WHEN direction IN ('positive', 'negative', 'mixed', 'uncertain') THEN direction || '|kept ' || direction ELSE 'uncertain|fallback' END AS r FROM i)
SELECT doc_id, position, split_part(r, '|', 1) AS direction_clean, split_part(r, '|', 2) AS reason FROM x""")
def direction_clean(spark, d):
    out = L.impact_direction(L.impact_type(related_claims(spark, d), WHY, TERMS, STRONG, VALID), WHY_DIRECTION, D_TERMS)
    return out.select("doc_id", "position", F.col("impact_direction_clean").alias("direction_clean"),
                      F.col("impact_direction_reason").alias("reason"))


@reg.add("use_scope", SQL_CLAIMS + f"""
SELECT doc_id, position, CASE WHEN {SQL_RELEVANCE} = 'non_ai_context' THEN 'exclude' WHEN affected = 'occupation' AND entity NOT IN ('src1', 'src2') THEN 'job_specific'
  WHEN affected IN ('task', 'skill') THEN 'task_or_skill_linkable' ELSE 'background_context' END AS generator_use_scope FROM c""")
def use_scope(spark, d):
    c = related_claims(spark, d)
    scope = L.use_scope(F.col("ai_relevance"), F.col("affected_entity_type"), F.col("affected_entity_text"), ["src1", "src2"])
    return c.select("doc_id", "position", scope.alias("generator_use_scope"))


_SCOPE = (f"CASE WHEN {SQL_RELEVANCE} = 'non_ai_context' THEN 'exclude' WHEN affected = 'occupation' AND entity NOT IN ('src1', 'src2') THEN 'job_specific' "
          "WHEN affected IN ('task', 'skill') THEN 'task_or_skill_linkable' ELSE 'background_context' END")


@reg.add("claim_filters", SQL_IMPACT + f""",
sc AS (SELECT *, {_SCOPE} AS scope, CASE WHEN position % 7 = 3 THEN 'failed' WHEN position % 7 = 4 THEN NULL ELSE 'exact_match' END AS quote_status FROM i)
SELECT doc_id, position, scope, impact_clean FROM sc
WHERE coalesce(quote_status, '') <> 'failed' AND scope <> 'exclude' AND scope IN ('job_specific', 'task_or_skill_linkable') AND impact_clean IN {_in(sorted(VALID))}""")
def claim_filters(spark, d):
    c = L.impact_type(related_claims(spark, d), WHY, TERMS, STRONG, VALID)
    c = c.withColumn("scope", L.use_scope(F.col("ai_relevance"), F.col("affected_entity_type"), F.col("affected_entity_text"), ["src1", "src2"]))
    status = F.when(F.col("position") % 7 == 3, "failed").when(F.col("position") % 7 != 4, "exact_match")
    checks = [(F.col("ai_relevance"), None), (F.col("scope"), ["job_specific", "task_or_skill_linkable", " "]), (F.col("impact_type_clean"), sorted(VALID))]
    return L.where_computed(c, L.claim_filter(status, F.col("scope"), checks)).select("doc_id", "position", "scope", F.col("impact_type_clean").alias("impact_clean"))


@reg.add("dq_label_warnings", SQL_IMPACT + f"""
SELECT doc_id, position, unnest(list_filter([CASE WHEN direction = 'negative' AND impact_clean = 'productivity_effect' THEN 'negative_to_productivity' END,
  CASE WHEN original = 'worker_vulnerability' AND impact_clean = 'productivity_effect' THEN 'vulnerability_to_productivity' END,
  CASE WHEN original = 'job_loss' AND impact_clean = 'job_creation' THEN 'loss_to_creation' END, CASE WHEN original = 'wage_effect' AND impact_clean = 'job_loss' THEN 'wage_to_loss' END,
  CASE WHEN {Q.word('claim', 'st', 'th')} AND direction = 'positive' THEN 'loss_words_positive' END, CASE WHEN {Q.word('claim', 'was')} AND direction = 'positive' THEN 'slow_words_positive' END,
  CASE WHEN {Q.word('claim', 'thin')} AND impact_clean = 'productivity_effect' THEN 'vulnerable_words_productivity' END, CASE WHEN moving AND direction = 'positive' THEN 'transition_positive' END], lambda x: x IS NOT NULL)) AS warning_type FROM i""")
def dq_label_warnings(spark, d):
    from dossierspark.operators.quality import label_warnings
    c = L.impact_type(related_claims(spark, d), WHY, TERMS, STRONG, VALID).withColumn("key", F.struct("doc_id", "position"))
    new, old, way, claim = F.col("impact_type_clean"), F.col("impact_type"), F.col("impact_direction"), F.col("_claim_words")
    rules = [
        ("negative_to_productivity", (way == "negative") & (new == "productivity_effect")),
        ("vulnerability_to_productivity", (old == "worker_vulnerability") & (new == "productivity_effect")),
        ("loss_to_creation", (old == "job_loss") & (new == "job_creation")),
        ("wage_to_loss", (old == "wage_effect") & (new == "job_loss")),
        ("loss_words_positive", RU.any_word(claim, ["st", "th"]) & (way == "positive")),
        ("slow_words_positive", RU.any_word(claim, ["was"]) & (way == "positive")),
        ("vulnerable_words_productivity", RU.any_word(claim, ["thin"]) & (new == "productivity_effect")),
        ("transition_positive", F.col("_has_transition") & (way == "positive")),
    ]
    return label_warnings(c, "key", rules).select("key.*", "warning_type")


# ---- filters and choices ---------------------------------------------------

@reg.add("filter_dsl", "SELECT p_partkey, p_brand, p_type FROM part WHERE p_type = 'SMALL' AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#17') AND p_size = 20 OR (p_type = 'ECONOMY' AND p_brand IN ('Brand#4'))")
def filter_dsl(spark, d):
    part = table(spark, d, "part")
    small = RU.build_filter({"$and": [{"p_type": "SMALL"}, {"p_brand": {"$in": ["Brand#1", "Brand#2", "Brand#17"]}}, {"p_size": 20}]})
    economy = RU.build_filter({"p_type": {"$eq": "ECONOMY"}, "p_brand": {"$in": ["Brand#4"]}})
    return part.filter(small | economy).select("p_partkey", "p_brand", "p_type")


@reg.add("policy_filter", """
SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE source IN ('src1', 'src3', 'src5') AND quality = 1 AND toxic = 0 AND lang <> 'de'""")
def policy_filter(spark, d):
    allowed = F.col("source").isin("src1", "src3", "src5") & (F.col("lang") != "de")
    flags = table(spark, d, "labels").filter("quality = 1 AND toxic = 0")
    return table(spark, d, "documents").filter(allowed).join(flags, "doc_id", "left_semi").select("doc_id", "source")


@reg.add("term_filter", f"SELECT doc_id, n_chars FROM documents WHERE {Q.sub('lower(text)', 'copyright', 'password', 'keit')} AND length({Q.one_line('text')}) > 80")
def term_filter(spark, d):
    t = F.col("text")
    keep = RU.any_substring(F.lower(t), ["copyright", "password", "keit"]) & (F.length(X.one_line(t)) > 80)
    return table(spark, d, "documents").filter(keep).select("doc_id", "n_chars")


_FOUND = ["thth", "keit", "les", "de la", "of the"]


@reg.add("term_matches", f"""
WITH m AS (SELECT doc_id, list_filter([{', '.join(f"CASE WHEN {Q.word('lower(text)', w)} THEN '''{w}''' END" for w in _FOUND)}], lambda x: x IS NOT NULL) AS m FROM documents)
SELECT doc_id, len(m) AS n_terms, array_to_string(m[1:3], ', ') AS reason FROM m WHERE len(m) > 0""")
def term_matches(spark, d):
    # One literal pattern drops rows without any term before the words are taken apart.
    low = F.lower(X.one_line(F.col("text")))
    hits = table(spark, d, "documents").filter(low.rlike(RU.word_pattern(_FOUND)))
    words = hits.select("doc_id", RU.word_text(low).alias("w"))
    m = words.select("doc_id", RU.matched_words(F.col("w"), _FOUND).alias("m"))
    return m.select("doc_id", F.size("m").cast("long").alias("n_terms"), RU.reason(F.col("m")).alias("reason"))


@reg.add("coalesce_keys", """
SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderstatus = 'F' THEN '  ' WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderpriority END), ''), nullif(trim(c_name), ''), 'none') AS title
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey""")
def coalesce_keys(spark, d):
    status = F.col("o_orderstatus")
    first = F.when(status == "F", F.lit("  ")).when(status == "O", F.lit(None)).otherwise(F.col("o_orderpriority"))
    rows = table(spark, d, "orders").join(table(spark, d, "customer").filter("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", RU.first_non_empty(first, F.col("c_name"), F.lit("none")).alias("title"))


@reg.add("choice_coerce", """
SELECT event_id, CASE WHEN lower(trim(event_type)) IN ('click', 'view') THEN lower(trim(event_type)) ELSE 'other' END AS choice,
  CASE WHEN event_type = 'error' THEN '' WHEN event_type = 'view' THEN 'a|b' ELSE event_type END AS mentions FROM events""")
def choice_coerce(spark, d):
    kind = F.col("event_type")
    raw = F.when(kind == "error", F.lit(" ")).when(kind == "view", F.lit('["a", " ", " b"]')).otherwise(kind)
    shout = F.concat(F.lit(" "), F.upper(kind), F.lit(" "))
    return table(spark, d, "events").select(
        "event_id", RU.coerce_choice(shout, ["click", "view"], "other").alias("choice"),
        F.array_join(RU.coerce_list(raw), "|").alias("mentions"))


_PREFS = {"tools": ["keit", "thth"], "people": ["que", "elle"], "stability": ["der", "und"], "data": ["tion"]}


@reg.add("pref_labels", f"""
SELECT conv_id, turn, array_to_string(list_filter([{', '.join(f"CASE WHEN {Q.sub('lower(text)', *w)} THEN '{k}' END" for k, w in _PREFS.items())}], lambda x: x IS NOT NULL)[1:12], '|') AS labels FROM conversations WHERE role = 'user'""")
def pref_labels(spark, d):
    return table(spark, d, "conversations").filter("role = 'user'").select(
        "conv_id", "turn", F.array_join(L.preference_labels(F.col("text"), _PREFS), "|").alias("labels"))


@reg.add("pref_groups", f"""
SELECT p_partkey, CASE WHEN {Q.sub('lower(p_name)', 'ring', 'bolt')} THEN 'Tasks and tools' WHEN {Q.sub('lower(p_name)', 'small', 'large')} THEN 'Work style'
  WHEN contains(lower(p_name), 'red') THEN 'People and setting' ELSE 'Other' END AS preference_group FROM part""")
def pref_groups(spark, d):
    groups = [("Tasks and tools", ["ring", "bolt"]), ("Work style", ["small", "large"]), ("People and setting", ["red"])]
    return table(spark, d, "part").select("p_partkey", L.preference_group(F.col("p_name"), groups).alias("preference_group"))


_SHARE_SQL = """
WITH s AS (SELECT p_brand, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS r,
  CASE WHEN contains(lower(p_type), 'promo') THEN 'master' WHEN contains(lower(p_type), 'standard') OR contains(lower(p_type), 'small') THEN 'bachelor' WHEN contains(lower(p_type), 'large') THEN 'doctoral' ELSE 'other' END AS level FROM s)"""


@reg.add("degree_level", _SHARE_SQL + """
SELECT p_brand, max(CASE WHEN r = 1 THEN level END) AS top_level, max(CASE WHEN r = 2 THEN level END) AS second_level,
  CASE WHEN max(CASE WHEN r = 1 THEN level END) = 'other' THEN 'Most rows point to ' || lower(max(CASE WHEN r = 1 THEN p_type END)) || '.' ELSE 'Most rows point to ' || max(CASE WHEN r = 1 THEN level END) || ' level.' END AS summary
FROM t WHERE r <= 2 GROUP BY 1""")
def degree_level(spark, d):
    from dossierspark.operators.ranking import top_n
    levels = [("master", ["promo"]), ("bachelor", ["standard", "small"]), ("doctoral", ["large"])]
    shares = named_facts(spark, d).groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    two = top_n(shares, ["p_brand"], [F.col("n").desc(), F.col("p_type")], 2).withColumn("level", L.degree_level(F.col("p_type"), levels))
    pick = lambda c, r: F.max(F.when(F.col("rank") == r, F.col(c)))
    named = F.when(pick("level", 1) == "other", F.concat(F.lit("Most rows point to "), F.lower(pick("p_type", 1)), F.lit("."))).otherwise(
        F.concat(F.lit("Most rows point to "), pick("level", 1), F.lit(" level.")))
    return two.groupBy("p_brand").agg(pick("level", 1).alias("top_level"), pick("level", 2).alias("second_level"), named.alias("summary"))


@reg.add("score_bands", """
WITH s AS (SELECT l_suppkey, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount * 10 END AS score FROM lineitem),
b AS (SELECT l_suppkey, score, CASE WHEN score IS NULL THEN 'Not observed' WHEN score >= 0.67 THEN 'High' WHEN score >= 0.34 THEN 'Medium' ELSE 'Low' END AS level,
  CASE WHEN score >= 0.9 THEN 'Strong fit' WHEN score >= 0.8 THEN 'Good fit' ELSE 'Possible fit' END AS fit FROM s)
SELECT l_suppkey, CASE max(CASE level WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END) WHEN 3 THEN 'High' WHEN 2 THEN 'Medium' WHEN 1 THEN 'Low' ELSE 'Unavailable' END AS overall,
  count(*) FILTER (level = 'Low') AS low_rows, count(*) FILTER (level = 'Not observed') AS open_rows, count(*) FILTER (fit = 'Strong fit') AS strong_rows FROM b GROUP BY 1""")
def score_bands(spark, d):
    score = F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10)
    b = table(spark, d, "lineitem").select("l_suppkey", L.automation_level(score).alias("level"), L.fit_label(score).alias("fit"))
    return b.groupBy("l_suppkey").agg(
        L.highest_level(F.col("level")).alias("overall"), F.count_if(F.col("level") == "Low").alias("low_rows"),
        F.count_if(F.col("level") == "Not observed").alias("open_rows"), F.count_if(F.col("fit") == "Strong fit").alias("strong_rows"))


CAUTIONS = ("A share of zero is the indexed value and does not show the absence of impact.", "The source labels this row as no exposure.",
            "Use the metric only in its source scope.")


@reg.add("metric_caution", """
WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount, CASE l_returnflag WHEN 'A' THEN 'task_penetration' WHEN 'R' THEN 'no_exposure' ELSE 'usage' END AS impact, CASE WHEN l_linestatus = 'F' THEN ' count ' ELSE '' END AS unit FROM lineitem),
u AS (SELECT *, coalesce(nullif(trim(unit), ''), CASE WHEN contains(impact, 'penetration') OR contains(impact, 'exposure') THEN 'share' ELSE '' END) AS shown FROM m)
SELECT l_orderkey, l_linenumber, l_partkey, shown AS metric_unit, CASE WHEN l_discount = 0 AND shown = 'share' THEN 'A share of zero is the indexed value and does not show the absence of impact.'
  WHEN impact = 'no_exposure' THEN 'The source labels this row as no exposure.' ELSE 'Use the metric only in its source scope.' END AS caution FROM u""")
def metric_caution(spark, d):
    flag = F.col("l_returnflag")
    impact = F.when(flag == "A", F.lit("task_penetration")).when(flag == "R", F.lit("no_exposure")).otherwise(F.lit("usage"))
    unit = F.when(F.col("l_linestatus") == "F", F.lit(" count ")).otherwise(F.lit(""))
    rows = table(spark, d, "lineitem").withColumn("impact", impact).withColumn("metric_unit", L.metric_unit(unit, F.lit(""), F.col("impact")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "metric_unit",
                       L.metric_caution(F.col("l_discount"), F.col("metric_unit"), F.col("impact"), *CAUTIONS).alias("caution"))


POLICY_RULES = [(["example.com/fr", "/de/"], {"source_id": "study_a", "statistics_allowed": True, "chunks_allowed": True, "usage": "statistics_methodology"}),
                (["example.org"], {"source_id": "study_b", "statistics_allowed": True, "chunks_allowed": False, "usage": "statistics_methodology"})]
POLICY_DEFAULT = {"source_id": "", "statistics_allowed": False, "chunks_allowed": True, "usage": "inference_only"}


@reg.add("source_policy", f"""
WITH p AS (SELECT page_id, CASE WHEN {Q.sub('lower(url)', 'example.com/fr', '/de/')} THEN 1 WHEN contains(lower(url), 'example.org') THEN 2 ELSE 0 END AS k FROM pages)
SELECT page_id, CASE k WHEN 1 THEN 'study_a' WHEN 2 THEN 'study_b' ELSE '' END AS source_id, k > 0 AS statistics_allowed, k <> 2 AS chunks_allowed,
  CASE WHEN k > 0 THEN 'statistics_methodology' ELSE 'inference_only' END AS usage FROM p""")
def source_policy(spark, d):
    p = L.source_policy(F.col("url"), F.lit(""), POLICY_RULES, POLICY_DEFAULT)
    return table(spark, d, "pages").select("page_id", p.alias("p")).select("page_id", "p.*")


@reg.add("source_type", r"""
WITH p AS (SELECT page_id, lower(url) AS url, lower(regexp_extract(url, '([^?#]*)', 1)) || CASE page_id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.htm' WHEN 2 THEN '.jsonl' ELSE '' END AS path, CASE WHEN page_id % 2 = 0 THEN 'text/html' ELSE '' END AS kind FROM pages)
SELECT page_id, CASE WHEN contains(url, 'm.thth') THEN 'dataset' WHEN path LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(path, '\.(html|htm|txt)$') THEN 'html' WHEN regexp_matches(path, '\.(csv|json|jsonl|parquet)$') THEN 'dataset'
  WHEN contains(kind, 'html') THEN 'html' ELSE 'unknown' END AS source_type FROM p""")
def source_type(spark, d):
    ending = F.col("page_id") % 5
    path = F.concat(F.regexp_extract("url", "([^?#]*)", 1), F.when(ending == 0, ".pdf").when(ending == 1, ".htm").when(ending == 2, ".jsonl").otherwise(""))
    kind = F.when(F.col("page_id") % 2 == 0, "text/html").otherwise("")
    return table(spark, d, "pages").select("page_id", L.source_type(F.col("url"), path, kind, ["m.thth"]).alias("source_type"))


# ---- queries ---------------------------------------------------------------

_TYPE_RULES = [("technology_career", ["keit"]), ("education", ["thth", "elle"]), ("tasks", ["mente"])]
_SUPPLEMENTAL = [("alternatives", "related_occupations", ["ndth"]), ("aliases", "occupation_aliases", ["lich", "erer"])]
_HINTS = [("und", "Hint One"), ("eau", "Hint Two")]


@reg.add("query_intent", f"""
WITH q AS (SELECT conv_id, turn, {Q.one_line('text')} AS q FROM conversations WHERE role = 'user'),
k AS (SELECT *, lower(q) AS low, CASE WHEN contains(lower(q), 'keit') THEN 'technology_career' WHEN {Q.sub('lower(q)', 'thth', 'elle')} THEN 'education' WHEN contains(lower(q), 'mente') THEN 'tasks'
  WHEN contains(lower(q), 'ing the') OR (contains(lower(q), 'tion') AND NOT contains(lower(q), 'tion en')) THEN 'software' WHEN contains(lower(q), 'que') THEN 'skills' ELSE 'general' END AS query_type FROM q),
r AS (SELECT *, CASE WHEN contains(low, 'ndth') THEN 'alternatives' WHEN {Q.sub('low', 'lich', 'erer')} THEN 'aliases' WHEN query_type IN ('technology_career', 'tasks', 'interests') THEN 'occupation_info'
  WHEN query_type IN ('skills', 'software', 'education', 'day_in_life') THEN query_type ELSE 'general' END AS intent,
  CASE WHEN contains(low, 'ndth') THEN 'related_occupations' WHEN {Q.sub('low', 'lich', 'erer')} THEN 'occupation_aliases' END AS doc_type,
  CASE WHEN contains(low, 'und') THEN 'Hint One' WHEN contains(low, 'eau') THEN 'Hint Two' END AS hint FROM k)
SELECT conv_id, turn, query_type, intent, doc_type, hint, 1 + CAST(hint IS NOT NULL AS BIGINT) + CAST(doc_type IS NOT NULL AS BIGINT) AS n_variants,
  md5(concat_ws('|', q, hint || ' ' || q, q || ' ' || replace(doc_type, '_', ' '))) AS variants_md5 FROM r""")
def query_intent(spark, d):
    users = table(spark, d, "conversations").filter("role = 'user'").withColumn("q", X.one_line(F.col("text")))
    out = L.query_plan(users, "q", _TYPE_RULES, ["ing the"], ["tion en"], ["que"], _SUPPLEMENTAL, _HINTS)
    return out.select("conv_id", "turn", "query_type", "intent", F.col("supplemental_doc_type").alias("doc_type"),
                      F.col("entity_hint").alias("hint"), F.size("variants").cast("long").alias("n_variants"),
                      F.md5(F.array_join("variants", "|")).alias("variants_md5"))


# ---- guards on generated text ----------------------------------------------

@reg.add("text_guards", r"""
WITH a AS (SELECT conv_id, turn, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM (SELECT conv_id, turn,
  string_split(regexp_replace('Main tasks' || chr(10) || text || chr(10) || 'Future Outlook' || chr(10) || '- ' || text || chr(10) || 'Sources' || chr(10) || '[1] thble ' || conv_id || chr(10) || '[2] other', '(?i)the by', 'THE/BY', 'g'), chr(10)) AS l FROM conversations WHERE role = 'assistant')),
h AS (SELECT *, regexp_replace(lower(trim(s)), '[^a-z]', '', 'g') AS k FROM a),
o AS (SELECT *, last_value(CASE WHEN k IN ('maintasks', 'futureoutlook', 'sources') THEN k END IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i) = 'futureoutlook' AS open, min(CASE WHEN k = 'sources' THEN i END) OVER (PARTITION BY conv_id, turn) AS src FROM h),
g AS (SELECT *, CASE WHEN open AND regexp_matches(lower(s), '(?:^|[^a-z])(?:the|que|der)(?:[^a-z]|$)') AND regexp_matches(lower(s), 'tion|ment') THEN regexp_extract(s, '^([ \t]*(?:[-*][ \t]*)?)', 1) || 'No forecast.' ELSE s END AS line FROM o),
b AS (SELECT *, regexp_matches(lower(string_agg(CASE WHEN i < src THEN line END, chr(10) ORDER BY i) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), 'thble') AS used FROM g)
SELECT conv_id, turn, md5(string_agg(line, chr(10) ORDER BY i) FILTER (used OR i <= src OR NOT contains(lower(line), 'thble'))) AS answer_md5 FROM b GROUP BY ALL""")
def text_guards(spark, d):
    answer = F.concat(F.lit("Main tasks\n"), "text", F.lit("\nFuture Outlook\n- "), "text", F.lit("\nSources\n[1] thble "),
                      F.col("conv_id").cast("string"), F.lit("\n[2] other"))
    guarded = L.guard_text(answer, [("the by", "THE/BY")], ["maintasks", "futureoutlook", "sources"], "futureoutlook",
                           r"(?:^|[^a-z])(?:the|que|der)(?:[^a-z]|$)", "tion|ment", "No forecast.", "sources", "thble", "thble")
    return table(spark, d, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.md5(guarded).alias("answer_md5"))


# ---- metric evidence -------------------------------------------------------

METRICS = {"l_quantity": "usage_count", "l_extendedprice": "exposure_value", "l_discount": "automation_share", "l_tax": "feedback_rate"}
SENTENCES = ({"automation": "A share of automated use.", "observed_usage": "A count of observed use."}, {"ai_task_impact": "About one task."}, "About the whole table.")
IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "task_text", "match_confidence"]
_METRIC_SQL = """
WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linestatus = 'O' THEN p_name ELSE '' END AS task_text, CASE l_returnflag WHEN 'A' THEN 'high' WHEN 'R' THEN 'medium' ELSE 'low' END AS mc,
  l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem JOIN part ON l_partkey = p_partkey),
u AS (SELECT *, 'usage_count' AS metric_name, l_quantity AS metric_value, 'observed_usage' AS impact_type, 'count' AS metric_unit FROM w
  UNION ALL SELECT *, 'exposure_value', l_extendedprice, 'exposure', NULL FROM w UNION ALL SELECT *, 'automation_share', l_discount, 'automation', 'percent' FROM w UNION ALL SELECT *, 'feedback_rate', l_tax, 'augmentation', 'percent' FROM w),
e AS (SELECT *, CASE WHEN task_text <> '' THEN 'ai_task_impact' ELSE 'ai_occupation_impact' END AS doc_type FROM u)"""


def metric_rows(spark, d):
    flag = F.col("l_returnflag")
    wide = named_facts(spark, d).withColumns({
        "task_text": F.when(F.col("l_linestatus") == "O", F.col("p_name")).otherwise(F.lit("")),
        "match_confidence": F.when(flag == "A", "high").when(flag == "R", "medium").otherwise("low")})
    return E.unpivot_metrics(wide, IDS, METRICS, code="l_suppkey", task="task_text", sentences=SENTENCES)


@reg.add("evidence_unpivot", _METRIC_SQL + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, metric_name, metric_value FROM e")
def evidence_unpivot(spark, d):
    evidence, _ = metric_rows(spark, d)
    return evidence.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "metric_name", "metric_value")


@reg.add("rule_labels", _METRIC_SQL + """
SELECT metric_name, impact_type, doc_type, metric_unit, CASE WHEN doc_type = 'ai_task_impact' AND mc IN ('high', 'medium') THEN mc ELSE 'medium' END AS confidence, count(*) AS n, max(metric_value) AS top_value FROM e GROUP BY ALL""")
def rule_labels(spark, d):
    evidence, _ = metric_rows(spark, d)
    return evidence.groupBy("metric_name", "impact_type", "doc_type", "metric_unit", "confidence").agg(
        F.count(F.lit(1)).alias("n"), F.max("metric_value").alias("top_value"))


@reg.add("metric_errors", """
SELECT event_id, 'value_text' AS column_name, 'no number in: ' || event_type AS error_message FROM events WHERE event_type = 'error'""")
def metric_errors(spark, d):
    text = F.when(F.col("event_type") == "error", F.col("event_type")).when(F.col("event_type") == "view", F.lit(" ")).otherwise(F.col("value").cast("string"))
    rows = table(spark, d, "events").withColumns({"value_text": text, "task_text": F.lit(""), "match_confidence": F.lit("low")})
    _, errors = E.unpivot_metrics(rows, ["event_id", "user_id", "task_text", "match_confidence"], {"value_text": "value_text"}, "user_id", "task_text", SENTENCES)
    return errors.select("event_id", "column_name", "error_message")


@reg.add("metric_columns", """
SELECT * FROM (VALUES ('l_orderkey', false, true, false), ('l_partkey', false, true, false), ('l_suppkey', false, true, false), ('l_linenumber', false, true, false), ('usage_count', true, true, true),
  ('exposure_value', true, true, true), ('automation_share', true, true, true), ('l_tax', false, true, false), ('l_returnflag', false, false, false), ('score_flag', true, false, false), ('l_shipdate', false, true, false)) t(column_name, name_fits, has_numbers, is_metric)
WHERE (SELECT count(*) FROM lineitem) > 0""")
def metric_columns(spark, d):
    renamed = table(spark, d, "lineitem").withColumnsRenamed({
        "l_quantity": "usage_count", "l_extendedprice": "exposure_value", "l_discount": "automation_share", "l_linestatus": "score_flag"})
    return E.metric_candidates(renamed)


@reg.add("col_resolve", "SELECT p_partkey AS task_id, p_name AS task_text, p_type AS category FROM part")
def col_resolve(spark, d):
    part = table(spark, d, "part").withColumnsRenamed({"p_partkey": "Task_ID", "p_name": "Task Text", "p_type": "CATEGORY"})
    roles = {"task_id": ["task_id", "task_number"], "task_text": ["task", "task_text"], "category": ["cluster", "category"]}
    return part.select(*[F.col(f"`{RU.resolve_column(part.columns, c)}`").alias(role) for role, c in roles.items()])


@reg.add("sentence_labels", f"""
WITH s AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS position, lower(unnest(l)) AS s FROM (SELECT conv_id, turn, {Q.sentences('text')} AS l FROM conversations))
SELECT conv_id, turn, position, CASE WHEN contains(s, 'thth') THEN 'firm' WHEN {Q.sub('s', 'keit', 'heit')} THEN 'core' WHEN contains(s, 'elle') THEN 'occupation' WHEN contains(s, 'the') THEN 'task' ELSE 'methodology' END AS doc_type,
  CASE WHEN {Q.sub('s', 'der', 'que')} AND NOT contains(s, 'und') THEN 'direct_exposure' WHEN contains(s, 'und') THEN 'indirect_exposure' WHEN contains(s, 'ment') OR regexp_matches(s, '[0-9]') THEN 'exposure' ELSE 'methodology' END AS impact_type FROM s""")
def sentence_labels(spark, d):
    s = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(X.sentences(F.col("text"))).alias("position", "s"))
    low = F.lower("s")
    doc = RU.first_rule([(low.contains("thth"), "firm"), (RU.any_substring(low, ["keit", "heit"]), "core"), (low.contains("elle"), "occupation"), (low.contains("the"), "task")], "methodology")
    impact = RU.first_rule([(RU.any_substring(low, ["der", "que"]) & ~low.contains("und"), "direct_exposure"), (low.contains("und"), "indirect_exposure"),
                            (low.contains("ment") | low.rlike("[0-9]"), "exposure")], "methodology")
    return s.select("conv_id", "turn", F.col("position").cast("long").alias("position"), doc.alias("doc_type"), impact.alias("impact_type"))


# ---- nested claims ---------------------------------------------------------

def nested_claims(spark, d):
    """Each turn with a nested array of claims made from its own sentences."""
    way = lambda s: F.when(s.contains("the"), F.lit(" POSITIVE")).when(s.contains("que"), F.lit("negative")).otherwise(F.lit("unlisted"))
    made = F.transform(X.sentences(F.col("text")), lambda s, i: F.struct(
        F.when(F.length(s) > 60, s).otherwise(F.lit("  ")).alias("claim_text"), way(s).alias("impact_direction"),
        F.when(i > 1, i + 1).alias("raw_claim_index")))
    return table(spark, d, "conversations").select("conv_id", "turn", "role", made.alias("claims"))


def sanitise(claims):
    return F.transform(claims, lambda c, i: F.struct(
        F.coalesce(c["raw_claim_index"], i + 1).cast("long").alias("raw_claim_index"), F.trim(c["claim_text"]).alias("claim_text"),
        RU.coerce_choice(c["impact_direction"], ["positive", "negative", "mixed", "uncertain"], "uncertain").alias("impact_direction"),
        F.when(F.trim(c["claim_text"]) == "", F.lit("failed")).otherwise(F.lit("exact_match")).alias("quote_validation")))


_NESTED_SQL = f"""
WITH s AS (SELECT conv_id, turn, role, generate_subscripts(l, 1) AS i, unnest(l) AS s FROM (SELECT conv_id, turn, role, {Q.sentences('text')} AS l FROM conversations)),
c AS (SELECT conv_id, turn, role, i AS raw_claim_index, CASE WHEN length(s) > 60 THEN s ELSE '' END AS claim_text,
  CASE WHEN contains(s, 'the') THEN 'positive' WHEN contains(s, 'que') THEN 'negative' ELSE 'uncertain' END AS impact_direction FROM s)"""


@reg.add("nested_sanitise", _NESTED_SQL + """
SELECT v.conv_id, v.turn, count(c.i) AS num_raw, count(c.i) FILTER (claim_text <> '') AS num_validated, count(c.i) FILTER (claim_text = '') AS num_failed, count(c.i) FILTER (impact_direction = 'uncertain') AS num_uncertain
FROM conversations v LEFT JOIN (SELECT *, raw_claim_index AS i FROM c) c ON v.conv_id = c.conv_id AND v.turn = c.turn GROUP BY ALL""")
def nested_sanitise(spark, d):
    rows = nested_claims(spark, d).withColumn("claims", sanitise(F.col("claims")))
    n = lambda cond: F.size(F.filter("claims", cond)).cast("long")
    return rows.select("conv_id", "turn", F.size("claims").cast("long").alias("num_raw"),
                       n(lambda c: c["quote_validation"] != "failed").alias("num_validated"),
                       n(lambda c: c["quote_validation"] == "failed").alias("num_failed"),
                       n(lambda c: c["impact_direction"] == "uncertain").alias("num_uncertain"))


@reg.add("nested_flatten", _NESTED_SQL + """
SELECT v.conv_id, v.turn, v.role, c.raw_claim_index, md5(claim_text) AS claim_md5, impact_direction FROM conversations v LEFT JOIN c ON v.conv_id = c.conv_id AND v.turn = c.turn""")
def nested_flatten(spark, d):
    rows = nested_claims(spark, d).withColumn("claims", sanitise(F.col("claims")))
    flat = rows.select("conv_id", "turn", "role", F.posexplode_outer("claims").alias("position", "c"))
    return flat.select("conv_id", "turn", "role", "c.raw_claim_index", F.md5("c.claim_text").alias("claim_md5"), "c.impact_direction")
