"""Users as profiles: event types are interests, parts are listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from dossierspark.functions import text as X
from dossierspark.operators import aggregate as A
from dossierspark.operators import documents as D
from dossierspark.operators import joins as J
from dossierspark.operators import profiles as P
from dossierspark.operators.ranking import top_n, two_pool_pick
from dossierspark.plans.core import EVENT_TYPES, FACTS, SQL_BY_VALUE, SQL_TWO_POOL, _pools, by_value, event_votes, named_facts
from dossierspark.plans.registry import Registry
from dossierspark.session import table

reg = Registry()

CATEGORY = {"click": "ECONOMY", "error": "SMALL", "purchase": "PROMO", "signup": "STANDARD", "view": "LARGE"}
WISH = {"click": "small ring tools", "error": "red bolt repair", "purchase": "large gear economy", "signup": "blue plate widget", "view": "green screw small"}
GROUPS = ["primary_current", "primary_future", "secondary_future", "tertiary_future"]


def _case(c, pairs):
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _lookup(c, pairs):
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), c)


SQL_TOP = """
WITH scores AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
top AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS place FROM scores),
lv AS (SELECT user_id, 1 + count(*) % 5 AS current_level, 1 + CAST(sum(event_id) % 5 AS BIGINT) AS future_level FROM events GROUP BY 1)"""


def scores(spark, d):
    return A.pivot_scores(table(spark, d, "events"), "user_id", "event_type", EVENT_TYPES)


def tops(spark, d):
    return P.top_interests(scores(spark, d), "user_id", EVENT_TYPES)


@reg.add("prof_top_code", SQL_TOP + """
SELECT user_id, string_agg(upper(event_type[1:2]), '' ORDER BY place) AS code, string_agg(event_type, ',' ORDER BY place) AS interests, max(n) AS top_score FROM top WHERE place <= 3 GROUP BY 1""")
def prof_top_code(spark, d):
    t = tops(spark, d)
    return t.groupBy("user_id").agg(
        F.array_join(F.transform(D.ordered_list("place", "area"), lambda a: F.upper(F.substring(a, 1, 2))), "").alias("code"),
        F.array_join(D.ordered_list("place", "area"), ",").alias("interests"), F.max("score").alias("top_score"))


SQL_AMBIGUOUS = SQL_TOP + """,
m AS (SELECT user_id, max(n) AS best FROM scores GROUP BY 1),
amb AS (SELECT user_id, list(event_type ORDER BY event_type) AS near FROM scores JOIN m USING (user_id) WHERE best - n <= 1 GROUP BY 1)"""


@reg.add("prof_ambiguity", SQL_AMBIGUOUS + """
SELECT user_id, len(near) >= 2 AS has_ambiguity, CASE WHEN len(near) >= 2 THEN array_to_string(near, ',') ELSE '' END AS areas FROM amb""")
def prof_ambiguity(spark, d):
    return P.ambiguity(scores(spark, d), "user_id", EVENT_TYPES).withColumn("areas", F.array_join("areas", ","))


SQL_MATCHES = SQL_TOP + f""",
prof AS (SELECT user_id, current_level, future_level, max(CASE WHEN place = 1 THEN {_case('event_type', CATEGORY)} END) AS c1, max(CASE WHEN place = 2 THEN {_case('event_type', CATEGORY)} END) AS c2,
  max(CASE WHEN place = 3 THEN {_case('event_type', CATEGORY)} END) AS c3 FROM top JOIN lv USING (user_id) WHERE place <= 3 GROUP BY ALL),
listing AS (SELECT DISTINCT p_type AS category, CAST(1 + p_size % 5 AS BIGINT) AS level, p_name FROM part),
targets AS (SELECT user_id, 'primary_current' AS match_group, c1 AS category, current_level AS level FROM prof UNION ALL SELECT user_id, 'primary_future', c1, future_level FROM prof
  UNION ALL SELECT user_id, 'secondary_future', c2, future_level FROM prof UNION ALL SELECT user_id, 'tertiary_future', c3, future_level FROM prof),
matches AS (SELECT * FROM targets JOIN listing USING (category, level))"""


def profiles(spark, d):
    levels = table(spark, d, "events").groupBy("user_id").agg(
        (1 + F.count(F.lit(1)) % 5).alias("current_level"), (1 + F.sum("event_id") % 5).alias("future_level"))
    named = tops(spark, d).withColumn("category", _lookup(F.col("area"), CATEGORY))
    pick = lambda i: F.max(F.when(F.col("place") == i, F.col("category"))).alias(f"c{i}")
    return named.groupBy("user_id").agg(pick(1), pick(2), pick(3)).join(levels, "user_id")


def listings(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("category"), (1 + F.col("p_size") % 5).cast("long").alias("level"), "p_name").distinct()


def matches(spark, d):
    now, later = F.col("current_level"), F.col("future_level")
    targets = list(zip(GROUPS, [F.col("c1"), F.col("c1"), F.col("c2"), F.col("c3")], [now, later, later, later]))
    return J.match_listings(profiles(spark, d), listings(spark, d), targets, "category", "level")


@reg.add("match_listings", SQL_MATCHES + " SELECT user_id, match_group, category, level, p_name FROM matches")
def match_listings(spark, d):
    return matches(spark, d).select("user_id", "match_group", "category", "level", "p_name")


@reg.add("match_nearby", SQL_MATCHES + """
SELECT user_id, listing.level AS listing_level, p_name FROM prof JOIN listing ON c1 = category AND level IN (future_level - 1, future_level + 1) AND level BETWEEN 1 AND 5""")
def match_nearby(spark, d):
    rows = profiles(spark, d).select("user_id", F.col("c1").alias("category"), F.col("future_level").alias("level"))
    return J.match_nearby(rows, listings(spark, d), "category", "level").select("user_id", "listing_level", "p_name")


KEYWORDS = {"R": ["keit", "thth"], "I": ["que", "elle", "tion"], "A": ["ment", "eau"], "S": ["und", "der"], "E": ["los", "mente"], "C": ["the", "ing"]}
FALLBACK = {0: "R", 2: "S"}
_SUM = lambda words: " + ".join(f"CAST(contains(low, '{w}') AS INT)" for w in words)


@reg.add("prof_answer_votes", f"""
WITH a AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B\\x00]+', ' ', 'g'))) AS low FROM conversations WHERE role = 'user'),
s AS ({' UNION ALL '.join(f"SELECT conv_id, turn, '{k}' AS letter, {_SUM(w)} AS score FROM a" for k, w in KEYWORDS.items())}),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, letter) AS p, max(score) OVER (PARTITION BY conv_id, turn) AS best FROM s)
SELECT conv_id, turn, coalesce(string_agg(letter, '' ORDER BY p) FILTER (score > 0 AND p <= 3), CASE turn WHEN 0 THEN 'R' WHEN 2 THEN 'S' ELSE 'I' END) AS dominant,
  CASE WHEN max(best) >= 3 THEN 'high' WHEN max(best) >= 1 THEN 'medium' ELSE 'low' END AS confidence FROM r GROUP BY conv_id, turn""")
def prof_answer_votes(spark, d):
    users = table(spark, d, "conversations").filter("role = 'user'")
    out = P.answer_votes(users, ["conv_id", "turn"], "turn", "text", KEYWORDS, FALLBACK)
    return out.withColumn("dominant", F.array_join("dominant", ""))


@reg.add("prof_justified", SQL_AMBIGUOUS + """,
init AS (SELECT user_id, list(event_type ORDER BY place) AS initial FROM top WHERE place <= 3 GROUP BY 1),
v AS (SELECT user_id, event_type, round(sum(CASE WHEN value >= 20 THEN CAST(1.0 AS DOUBLE) WHEN value >= 5 THEN 0.6 ELSE 0.3 END), 4) AS votes FROM events GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) AS p FROM v),
prop AS (SELECT user_id, list(event_type ORDER BY p) FILTER (p <= 3) AS proposed, list(event_type ORDER BY p) FILTER (p <= 2 AND user_id % 2 = 0) AS prio FROM o GROUP BY 1),
j AS (SELECT *, CASE WHEN len(near) >= 2 THEN near ELSE CAST([] AS VARCHAR[]) END AS amb, coalesce(prio, CAST([] AS VARCHAR[])) AS pr FROM init JOIN prop USING (user_id) JOIN amb USING (user_id))
SELECT user_id, CASE WHEN proposed = initial THEN true WHEN len(amb) > 0 AND len(list_filter(proposed, lambda x: NOT list_contains(initial, x) AND NOT list_contains(amb, x))) = 0 THEN len(pr) > 0
  ELSE len(pr) > 0 AND proposed[1:least(len(proposed), len(pr))] = pr[1:least(len(proposed), len(pr))] END AS justified FROM j""")
def prof_justified(spark, d):
    votes = event_votes(spark, d).groupBy("user_id", "event_type").agg(F.round(F.sum("weight"), 4).alias("votes"))
    placed = top_n(votes, ["user_id"], [F.col("votes").desc(), F.col("event_type")], 3, "p")
    none = F.array().cast("array<string>")
    proposed = placed.groupBy("user_id").agg(D.ordered_list("p", "event_type").alias("proposed"))
    initial = tops(spark, d).groupBy("user_id").agg(D.ordered_list("place", "area").alias("initial"))
    amb = P.ambiguity(scores(spark, d), "user_id", EVENT_TYPES)
    rows = initial.join(proposed, "user_id").join(amb, "user_id")
    prio = F.when(F.col("user_id") % 2 == 0, F.slice("proposed", 1, 2)).otherwise(none)
    return rows.select("user_id", P.order_justified(F.col("initial"), F.col("proposed"), F.col("areas"), prio, none).alias("justified"))


_WISH_TOKENS = {k: v.split(" ") for k, v in WISH.items()}
SQL_COMPONENTS = SQL_MATCHES + f""",
wish AS (SELECT user_id, list_distinct(flatten(list(string_split({_case('event_type', WISH)}, ' ')))) AS w FROM top WHERE place <= 3 GROUP BY 1),
once AS (SELECT *, row_number() OVER (PARTITION BY user_id, p_name ORDER BY list_position(['primary_current', 'primary_future', 'secondary_future', 'tertiary_future'], match_group)) AS k FROM matches),
cand AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY list_position(['primary_current', 'primary_future', 'secondary_future', 'tertiary_future'], match_group), p_name) AS original_rank,
  row_number() OVER (PARTITION BY user_id, match_group ORDER BY p_name) AS group_rank FROM once WHERE k = 1),
docs AS (SELECT p_name, p_type, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, p_type) AS r FROM part GROUP BY p_name, p_type),
sig AS (SELECT p_name, list(list_distinct(string_split(lower(p_name || ' ' || p_type), ' '))) AS tasks, list(list_distinct(string_split(lower(p_type), ' '))) AS skills FROM docs WHERE r <= 4 GROUP BY 1),
ctx AS (SELECT p_name, list(list_distinct(string_split(lower(p_name || ' ' || p_brand), ' '))) AS contexts FROM (
  SELECT p_name, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY count(*) DESC, p_brand) AS r FROM part GROUP BY p_name, p_brand) WHERE r <= 4 GROUP BY 1),
expo AS (SELECT p_name, max(l_tax) * 10 AS exposure FROM {FACTS} WHERE l_returnflag = 'R' GROUP BY 1),
base AS (SELECT cand.*, t.n, t.place, w, tasks, skills, contexts, exposure, future_level FROM cand JOIN wish USING (user_id) JOIN sig USING (p_name) JOIN ctx USING (p_name) JOIN prof USING (user_id) LEFT JOIN expo USING (p_name)
  LEFT JOIN (SELECT user_id, {_case('event_type', CATEGORY)} AS category, n, CASE WHEN place <= 3 THEN place END AS place FROM top) t ON t.user_id = cand.user_id AND t.category = cand.category),
comp AS (SELECT user_id, p_name, match_group, original_rank, group_rank, future_level, round(least(1.0, greatest(0.0, CAST(0.55 AS DOUBLE) * CASE WHEN place IS NULL THEN CAST(0.25 AS DOUBLE) ELSE 1 - CAST(0.16 AS DOUBLE) * (place - 1) END + CAST(0.45 AS DOUBLE) * least(CAST(1 AS DOUBLE), n / CAST(40 AS DOUBLE)))), 4) AS interest_fit,
  round(greatest(CAST(0 AS DOUBLE), 1 - abs(level - future_level) / CAST(4 AS DOUBLE)), 4) AS level_fit,
  round(list_max(list_transform(tasks, lambda x: least(CAST(1 AS DOUBLE), len(list_intersect(w, x)) / CAST(greatest(6, least(len(w), len(x))) AS DOUBLE)))), 4) AS task_similarity,
  round(list_max(list_transform(skills, lambda x: least(CAST(1 AS DOUBLE), len(list_intersect(w, x)) / CAST(greatest(6, least(len(w), len(x))) AS DOUBLE)))), 4) AS skill_similarity,
  CASE WHEN list_contains(w, 'repair') AND contains(p_name, 'bolt') THEN CASE WHEN raised > 0 THEN least(raised, CAST(0.35 AS DOUBLE)) ELSE CAST(0.35 AS DOUBLE) END WHEN raised > 0 THEN raised ELSE CAST(0.35 AS DOUBLE) END AS context_fit,
  CASE WHEN NOT list_contains(w, 'tools') AND NOT list_contains(w, 'repair') OR exposure IS NULL THEN CAST(0.5 AS DOUBLE) WHEN list_contains(w, 'repair') THEN greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), 1 - exposure)) ELSE greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), exposure)) END AS exposure_fit FROM (
  SELECT *, greatest(round(list_max(list_transform(contexts, lambda x: least(CAST(1 AS DOUBLE), len(list_intersect(w, x)) / CAST(greatest(6, least(len(w), len(x))) AS DOUBLE)))), 4),
    CASE WHEN list_contains(w, 'tools') AND contains(p_name, 'ring') THEN CAST(0.85 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS raised FROM base))"""


def components(spark, d):
    cand = P.ranked_candidates(matches(spark, d).select("user_id", "match_group", "category", "level", "future_level", "p_name"),
                               "user_id", "match_group", "p_name", GROUPS)
    t = tops(spark, d)
    wish = t.groupBy("user_id").agg(F.array_distinct(F.flatten(F.collect_list(F.split(_lookup(F.col("area"), WISH), " ")))).alias("w"))
    kinds = table(spark, d, "part").groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n"))
    kept = top_n(kinds, ["p_name"], [F.col("n").desc(), F.col("p_type")], 4)
    words = lambda *c: F.array_distinct(F.split(F.lower(F.concat_ws(" ", *c)), " "))
    signals = kept.groupBy("p_name").agg(F.collect_list(words("p_name", "p_type")).alias("tasks"), F.collect_list(words("p_type")).alias("skills"))
    # The surroundings of an entity are described by its most frequent brands.
    brands = table(spark, d, "part").groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    contexts = top_n(brands, ["p_name"], [F.col("n").desc(), F.col("p_brand")], 4).groupBy("p_name").agg(
        F.collect_list(words("p_name", "p_brand")).alias("contexts"))
    exposure = named_facts(spark, d).filter("l_returnflag = 'R'").groupBy("p_name").agg((F.max("l_tax") * 10).alias("exposure"))
    interest = t.select("user_id", _lookup(F.col("area"), CATEGORY).alias("category"), "place", "score")
    # Sides that grow with the users are merged, never broadcast; those by name are bounded by the names.
    rows = (cand.join(wish.hint("merge"), "user_id").join(interest.hint("merge"), ["user_id", "category"], "left")
            .join(signals, "p_name").join(contexts, "p_name").join(exposure, "p_name", "left"))
    w = F.col("w")
    has = lambda word: F.array_contains(w, word)
    raises = [(has("tools") & F.col("p_name").contains("ring"), 0.85)]
    lowers = [(has("repair") & F.col("p_name").contains("bolt"), 0.35)]
    return rows.withColumns({
        "interest_fit": F.round(P.interest_fit(F.col("place"), F.col("score"), 40.0), 4),
        "level_fit": F.round(P.level_fit(F.col("level"), F.col("future_level")), 4),
        "task_similarity": F.round(P.best_overlap(w, F.col("tasks")), 4),
        "skill_similarity": F.round(P.best_overlap(w, F.col("skills")), 4),
        "context_fit": P.context_fit(F.round(P.best_overlap(w, F.col("contexts")), 4), F.size(w) > 0, raises, lowers),
        "exposure_fit": P.exposure_fit(F.col("exposure"), has("tools") | has("repair"), has("repair")),
    }).select("user_id", "p_name", "match_group", "original_rank", "group_rank", "future_level", *P.WEIGHTS)


@reg.add("rank_components", SQL_COMPONENTS + " SELECT user_id, p_name, original_rank, group_rank, interest_fit, level_fit, task_similarity, skill_similarity, context_fit, round(exposure_fit, 4) AS exposure_fit FROM comp")
def rank_components(spark, d):
    return components(spark, d).select("user_id", "p_name", "original_rank", "group_rank", *list(P.WEIGHTS)[:-1], F.round("exposure_fit", 4).alias("exposure_fit"))


SQL_COMPOSITE = SQL_COMPONENTS + """,
sc AS (SELECT *, round(interest_fit * CAST(0.28 AS DOUBLE) + level_fit * CAST(0.18 AS DOUBLE) + task_similarity * CAST(0.22 AS DOUBLE) + skill_similarity * CAST(0.17 AS DOUBLE) + context_fit * CAST(0.10 AS DOUBLE) + exposure_fit * CAST(0.05 AS DOUBLE) + CAST(1e-9 AS DOUBLE), 4) AS score FROM comp),
fr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, original_rank) AS final_rank FROM sc)"""


@reg.add("rank_composite", SQL_COMPOSITE + """
SELECT user_id, p_name, original_rank, final_rank, score, array_to_string(list_filter([CASE WHEN task_similarity >= 0.25 THEN 'tasks matched' END, CASE WHEN skill_similarity >= 0.25 THEN 'skills matched' END, CASE WHEN context_fit >= 0.65 THEN 'context matched' END,
  CASE WHEN level_fit < 0.75 THEN 'level is far from ' || future_level END, CASE WHEN task_similarity < 0.10 AND skill_similarity < 0.10 THEN 'few terms matched' END], lambda x: x IS NOT NULL), '; ') AS effects,
  bool_and(final_rank = original_rank) OVER (PARTITION BY user_id) AS unchanged_order FROM fr""")
def rank_composite(spark, d):
    scored = components(spark, d).withColumn("score", P.composite()).withColumn(
        "effects", F.array_join(P.ranking_effects(F.col("future_level")), "; "))
    return P.composite_rank(scored, "user_id", "original_rank").select(
        "user_id", "p_name", "original_rank", "final_rank", "score", "effects", "unchanged_order")


@reg.add("pick_alternatives", SQL_TWO_POOL + f""",
rest AS (SELECT u.*, row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_BY_VALUE}) AS r FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, p_name ORDER BY {SQL_BY_VALUE}) AS kk FROM f) WHERE kk = 1) u
  WHERE NOT EXISTS (SELECT 1 FROM picked p WHERE p.l_suppkey = u.l_suppkey AND p.p_name = u.p_name))
SELECT l_suppkey, CAST(r AS BIGINT) AS rank, p_name FROM rest WHERE r <= 5""")
def pick_alternatives(spark, d):
    from dossierspark.operators.ranking import best_row
    pools = _pools(spark, d)
    picked = two_pool_pick(pools, "l_suppkey", "pool", "p_name", by_value()).select("l_suppkey", "p_name")
    rest = best_row(pools, ["l_suppkey", "p_name"], by_value()).join(picked, ["l_suppkey", "p_name"], "left_anti")
    return top_n(rest, ["l_suppkey"], by_value(), 5).select("l_suppkey", F.col("rank").cast("long").alias("rank"), "p_name")


INFO, COMPLY, PHYSICAL = ["ring", "gear", "small", "economy"], ["plate", "promo"], ["bolt", "red", "large"]


def _count(words):
    return "(" + " + ".join(f"CAST(contains(lower(task), '{w}') AS INT)" for w in words) + ")"


@reg.add("task_exposure", f"""
WITH t AS (SELECT p_name || ' ' || p_type AS task, max(CASE WHEN l_returnflag = 'R' AND l_discount >= 0.1 AND l_quantity >= 49 THEN 1 ELSE 0 END) AS direct FROM {FACTS} GROUP BY 1),
w AS (SELECT task, direct, list_distinct(string_split(lower(task), ' ')) AS w FROM t),
c AS (SELECT DISTINCT string_split(lower(p_name || ' ' || p_brand), ' ') AS c FROM part),
s AS (SELECT *, EXISTS (SELECT 1 FROM c WHERE len(list_intersect(w.w, c.c)) >= 2) AS sup FROM w),
x AS (SELECT *, {_count(INFO)} + {_count(COMPLY)} - least({_count(PHYSICAL)}, 2) + 3 * direct + CAST(sup AS INT) AS score FROM s)
SELECT task, CAST(score AS BIGINT) AS exposure_score, CASE WHEN score >= 5 THEN 'High' WHEN score >= 3 THEN 'Medium' WHEN score >= 1 THEN 'Low-Medium' ELSE 'Low' END AS applicability,
  CASE WHEN direct = 1 THEN 'direct signal' ELSE 'inferred from task language' END AS basis FROM x""")
def task_exposure(spark, d):
    strong = (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.1) & (F.col("l_quantity") >= 49)
    tasks = named_facts(spark, d).groupBy(F.concat_ws(" ", "p_name", "p_type").alias("task")).agg(F.max(strong).alias("direct"))
    tasks = tasks.withColumn("w", F.array_distinct(F.split(F.lower("task"), " ")))
    chunks = table(spark, d, "part").select(F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("chunk")).distinct()
    supported = P.supported_texts(tasks, "task", "w", chunks.withColumn("c", F.split("chunk", " ")), "chunk", "c").withColumn("supported", F.lit(True))
    rows = tasks.join(supported, "task", "left").fillna(False, subset=["supported"])
    return P.task_exposure(rows, "task", F.col("direct"), F.col("supported"), INFO, COMPLY, PHYSICAL).select(
        "task", "exposure_score", "applicability", "basis")


@reg.add("skill_groups", f"""
WITH l AS (SELECT l_suppkey, p_name, CASE WHEN p_name LIKE 'small%' OR p_name LIKE 'red%' THEN 'foundational' WHEN p_name LIKE '%ring' THEN 'tools' ELSE 'technical' END AS skill_group, min(l_orderkey) AS f FROM {FACTS} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, skill_group ORDER BY f, p_name) AS r FROM l)
SELECT l_suppkey, skill_group, string_agg(p_name, ', ' ORDER BY r) AS skills FROM r WHERE r <= CASE skill_group WHEN 'technical' THEN 10 WHEN 'foundational' THEN 8 ELSE 16 END GROUP BY ALL""")
def skill_groups(spark, d):
    name = F.col("p_name")
    labels = table(spark, d, "part").select("p_name").distinct().withColumn(
        "skill_group", F.when(name.like("small%") | name.like("red%"), "foundational").when(name.like("%ring"), "tools")).filter("skill_group IS NOT NULL")
    skills = named_facts(spark, d).select("l_suppkey", "p_name", "l_orderkey")
    return P.skill_groups(skills, "l_suppkey", "p_name", "l_orderkey", labels, {"technical": 10, "foundational": 8, "tools": 16})


@reg.add("match_reasons", SQL_MATCHES + f""",
wish AS (SELECT user_id, list_distinct(flatten(list(string_split({_case('event_type', WISH)}, ' ')))) AS w FROM top WHERE place <= 3 GROUP BY 1)
SELECT user_id, CASE WHEN list_contains(w, 'tools') OR list_contains(w, 'repair') OR list_contains(w, 'gear') THEN concat_ws(' | ', CASE WHEN list_contains(w, 'tools') THEN 'Works with tools.' END, CASE WHEN list_contains(w, 'repair') THEN 'Solves faults.' END, CASE WHEN list_contains(w, 'gear') THEN 'Larger projects.' END)
  ELSE 'Chosen by ' || c1 || ' and level ' || future_level || '.' END AS reasons FROM prof JOIN wish USING (user_id)""")
def match_reasons(spark, d):
    wish = tops(spark, d).groupBy("user_id").agg(F.flatten(F.collect_list(F.split(_lookup(F.col("area"), WISH), " "))).alias("w"))
    has = lambda word: F.array_contains(F.col("w"), word)
    fallback = F.concat(F.lit("Chosen by "), "c1", F.lit(" and level "), F.col("future_level").cast("string"), F.lit("."))
    rules = [(has("tools"), "Works with tools."), (has("repair"), "Solves faults."), (has("gear"), "Larger projects.")]
    return profiles(spark, d).join(wish, "user_id").select("user_id", F.array_join(P.match_reasons(rules, fallback), " | ").alias("reasons"))


@reg.add("prof_summary", SQL_MATCHES + """,
a AS (SELECT user_id, event_type || '=' || value AS answer, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL),
b AS (SELECT user_id, string_agg(answer, '; ' ORDER BY r) AS answers FROM a WHERE r <= 5 GROUP BY 1)
SELECT user_id, 'Interests: ' || concat_ws(', ', c1, c2, c3) || '. Levels: ' || current_level || ' to ' || future_level || '. Answers: ' || coalesce(answers, 'none') AS summary FROM prof LEFT JOIN b USING (user_id)""")
def prof_summary(spark, d):
    top = top_n(table(spark, d, "events").filter("value IS NOT NULL"), ["user_id"], [F.col("value").desc(), F.col("event_id")], 5)
    answers = top.withColumn("answer", F.concat("event_type", F.lit("="), F.col("value").cast("string"))).groupBy("user_id").agg(
        F.array_join(D.ordered_list("rank", "answer"), "; ").alias("answers"))
    rows = profiles(spark, d).join(answers, "user_id", "left")
    text = F.concat(F.lit("Interests: "), F.concat_ws(", ", "c1", "c2", "c3"), F.lit(". Levels: "), F.col("current_level").cast("string"), F.lit(" to "),
                    F.col("future_level").cast("string"), F.lit(". Answers: "), F.coalesce("answers", F.lit("none")))
    return rows.select("user_id", text.alias("summary"))
