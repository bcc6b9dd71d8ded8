"""Scores, votes and rankings for all profiles at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierspark.functions import fixed_terms as V
from dossierspark.functions import rules as RU
from dossierspark.functions import text as X
from dossierspark.operators.ranking import best_row, ranked, top_n
from dossierspark.session import durable

# Weights of the composite score.
WEIGHTS = {"interest_fit": 0.28, "level_fit": 0.18, "task_similarity": 0.22, "skill_similarity": 0.17,
           "context_fit": 0.10, "exposure_fit": 0.05}


def top_interests(scores: DataFrame, profile: str, areas: list[str], n: int = 3) -> DataFrame:
    """(profile, area, score, place): the n best areas of a score table with one column per area.

    Equal scores keep the order of ``areas``.
    """
    cells = F.array(*[F.struct((-F.col(a)).alias("key"), F.lit(i).alias("i"), F.lit(a).alias("area"), F.col(a).alias("score"))
                      for i, a in enumerate(areas)])
    best = F.slice(F.array_sort(cells), 1, n)
    return scores.select(profile, F.posexplode(best).alias("_p", "c")).select(
        profile, (F.col("_p") + 1).alias("place"), F.col("c.area").alias("area"), F.col("c.score").alias("score"))


def ambiguity(scores: DataFrame, profile: str, areas: list[str], within: int = 1) -> DataFrame:
    top = F.greatest(*[F.col(a) for a in areas])
    near = F.array_compact(F.array(*[F.when(top - F.col(a) <= within, F.lit(a)) for a in areas]))
    tied = F.size(near) >= 2
    return scores.select(profile, tied.alias("has_ambiguity"),
                         F.when(tied, near).otherwise(F.array().cast("array<string>")).alias("areas"))


def answer_votes(answers: DataFrame, keys, question: str, answer: str, keywords=V.INTEREST_KEYWORDS, fallback=None,
                 default: str = "I", n: int = 3) -> DataFrame:
    """Keyword scores per category; up to three dominant letters, a fallback per question, a confidence.

    The six counters live in one row, so no row is multiplied and nothing is shuffled.
    """
    text = F.col("_low")
    low = answers.withColumn("_low", F.lower(X.one_line(F.col(answer))))
    cells = F.array(*[F.struct((-RU.count_substrings(text, words)).alias("key"), F.lit(letter).alias("letter"))
                      for letter, words in keywords.items()])
    scored = low.withColumn("_ranked", F.array_sort(cells))
    hits = F.transform(F.slice(F.filter("_ranked", lambda c: c["key"] < 0), 1, n), lambda c: c["letter"])
    best = -F.get(F.col("_ranked"), 0)["key"]
    other = RU.first_rule([(F.col(question) == q, F.lit(letter)) for q, letter in (fallback or {}).items()], default)
    return scored.select(
        *keys, F.when(best > 0, hits).otherwise(F.array(other)).alias("dominant"),
        RU.first_rule([(best >= 3, "high"), (best >= 1, "medium")], "low").alias("confidence"))


def order_justified(initial: Column, proposed: Column, ambiguous: Column, prioritized: Column, resolved: Column) -> Column:
    """May the proposed order replace the initial one? Unchanged, a resolved tie, or an agreed priority."""
    allowed = F.array_union(initial, ambiguous)
    shorter = F.least(F.size(proposed), F.size(prioritized))
    agrees = (F.size(prioritized) > 0) & (
        F.slice(proposed, F.lit(1), shorter) == F.slice(prioritized, F.lit(1), shorter))
    tie_case = (F.size(ambiguous) > 0) & (F.size(F.array_except(proposed, allowed)) == 0)
    return F.when(proposed == initial, F.lit(True)).when(
        tie_case, (F.size(resolved) > 0) | (F.size(prioritized) > 0)).otherwise(agrees)


def ranked_candidates(matches: DataFrame, profile: str, group: str, title: str, groups: list[str]) -> DataFrame:
    """Distinct titles of the match groups in group order, with a rank overall and inside the group."""
    place = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(group))
    once = best_row(matches.withColumn("_place", place), [profile, title], [F.col("_place"), F.col(title)])
    numbered = ranked(once, [profile], [F.col("_place"), F.col(title)], "original_rank")
    # Inside a group the ranks continue, so the group rank is an offset from the group's first rank.
    starts = numbered.groupBy(profile, group).agg(F.min("original_rank").alias("_start"))
    # As many rows as profiles: written candidates look small to the planner, which would broadcast either side through the driver.
    return numbered.join(starts.hint("merge"), [profile, group]).withColumn(
        "group_rank", F.col("original_rank") - F.col("_start") + 1).drop("_start", "_place")


def interest_fit(place: Column, score: Column, scale: float = 10.0) -> Column:
    """Rank share and score share of the candidate's interest; ``place`` is null outside the target list."""
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / scale))
    rank = F.when(place.isNull(), F.lit(0.25)).otherwise(F.lit(1.0) - F.lit(0.16) * (place - 1))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(0.55) * rank + F.lit(0.45) * raw))


def level_fit(level: Column, target: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(level - target) / F.lit(4.0))


def overlap_score(query: Column, document: Column) -> Column:
    """Shared tokens over max(6, the smaller token count), at most 1."""
    common = F.size(F.array_intersect(query, document))
    smaller = F.least(F.size(query), F.size(document))
    return F.least(F.lit(1.0), common / F.greatest(F.lit(6), smaller))


def best_overlap(query: Column, documents: Column) -> Column:
    """Best overlap over a limited list of token arrays."""
    return F.coalesce(F.array_max(F.transform(documents, lambda d: overlap_score(query, d))), F.lit(0.0))


def context_fit(similarity: Column, has_preferences: Column, raises, lowers) -> Column:
    """Similarity moved by context rules; ``raises``/``lowers`` list (condition, bound)."""
    score = similarity
    for condition, bound in raises:
        score = F.when(condition, F.greatest(score, F.lit(bound))).otherwise(score)
    for condition, bound in lowers:
        score = F.when(condition, F.least(score, F.lit(bound))).otherwise(score)
    return F.when(~has_preferences, F.lit(0.5)).otherwise(F.when(score > 0, F.least(score, F.lit(1.0))).otherwise(F.lit(0.35)))


def exposure_fit(exposure: Column, asks: Column, wants_stability: Column) -> Column:
    clipped = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(~asks | exposure.isNull(), F.lit(0.5)).when(
        wants_stability, clipped(F.lit(1.0) - exposure)).otherwise(clipped(exposure))


def composite(components: dict[str, float] = WEIGHTS) -> Column:
    total = None
    for name, weight in components.items():
        part = F.col(name) * F.lit(weight)
        total = part if total is None else total + part
    # Components have few decimals, so the offset only settles exact halves.
    return F.round(total + F.lit(1e-9), 4)


def ranking_effects(target: Column) -> Column:
    return F.array_compact(F.array(
        F.when(F.col("task_similarity") >= 0.25, F.lit("tasks matched")),
        F.when(F.col("skill_similarity") >= 0.25, F.lit("skills matched")),
        F.when(F.col("context_fit") >= 0.65, F.lit("context matched")),
        F.when(F.col("level_fit") < 0.75, F.concat(F.lit("level is far from "), target.cast("string"))),
        F.when((F.col("task_similarity") < 0.10) & (F.col("skill_similarity") < 0.10), F.lit("few terms matched")),
    ))


def composite_rank(candidates: DataFrame, profile: str, tie: str, score: str = "score") -> DataFrame:
    """Order of the scores per profile, with a flag whether the order stayed the original one.

    The order is unchanged exactly when no row changed its rank.
    """
    placed = ranked(candidates, [profile], [F.col(score).desc(), F.col(tie)], "final_rank")
    moved = placed.groupBy(profile).agg(F.max(F.col("final_rank") != F.col("original_rank")).alias("_moved"))
    return placed.join(moved.hint("merge"), profile).withColumn("unchanged_order", ~F.col("_moved")).drop("_moved")


def task_exposure(tasks: DataFrame, text: str, direct: Column, supported: Column, information=V.INFORMATION_TERMS,
                  compliance=V.COMPLIANCE_TERMS, physical=V.PHYSICAL_TERMS) -> DataFrame:
    """Applicability from term counts, a direct signal (+3) and qualitative support (+1)."""
    low = F.lower(F.col(text))
    score = (RU.count_substrings(low, information) + RU.count_substrings(low, compliance)
             - F.least(RU.count_substrings(low, physical), F.lit(2)) + F.when(direct, 3).otherwise(0) + F.when(supported, 1).otherwise(0))
    scored = tasks.withColumn("exposure_score", score.cast("long"))
    s = F.col("exposure_score")
    return scored.withColumns({
        "applicability": RU.first_rule([(s >= 5, "High"), (s >= 3, "Medium"), (s >= 1, "Low-Medium")], "Low"),
        "basis": F.when(direct, F.lit("direct signal")).otherwise(F.lit("inferred from task language"))})


#: Words whose common occurrence is kept as bits, 64 of them a column.
HEAVY = 256


def supported_texts(tasks: DataFrame, id_: str, task_tokens: str, chunks: DataFrame, chunk_id: str,
                    chunk_tokens: str, heavy: int = HEAVY) -> DataFrame:
    """Ids of tasks that share at least two tokens with one chunk.

    The ``heavy`` words in most chunks never meet by a join: a chunk carries them as bits, and the bits of all chunks with one heavy word
    are one row, so a task with two heavy words needs that row alone. A light word is an inverted list: its chunks and tasks meet with
    their bits, and either the bits share a heavy word or the pair must meet at a second light word. A chunk takes memory in proportion
    to its words. Repeated tokens count once, null tokens not at all.
    """
    columns = range(-(-heavy // 64))
    given = durable(tasks.select(id_, F.explode(task_tokens).alias("word")).dropna().distinct())
    words = given.select("word").distinct()
    spread = durable(chunks.select(chunk_id, F.explode(F.array_distinct(chunk_tokens)).alias("word")).join(words, "word", "left_semi"))
    top = spread.groupBy("word").agg(F.count(F.lit(1)).alias("_f")).orderBy(F.col("_f").desc(), "word").limit(heavy)
    # At most ``heavy`` rows, in any number of chunks.
    numbered = F.broadcast(durable(top.agg(F.sort_array(F.collect_list("word")).alias("_w")).select(F.posexplode("_w").alias("_pos", "word"))))

    def marked(rows: DataFrame, key: str) -> DataFrame:
        """Rows (key, word) with the place of a heavy word and the bits of all heavy words of the key."""
        placed = rows.join(numbered, "word", "left")
        bit = F.expr("shiftleft(1L, _pos % 64)")
        bits = placed.filter("_pos is not null").groupBy(key).agg(
            *[F.bit_or(F.when(F.floor(F.col("_pos") / 64) == c, bit).otherwise(F.lit(0).cast("long"))).alias(f"_b{c}") for c in columns])
        return placed.join(bits, key, "left").fillna(0, subset=[f"_b{c}" for c in columns])

    both = lambda a, b: F.array(*[F.col(f"{a}._b{c}").bitwiseAND(F.col(f"{b}._b{c}")) for c in columns])
    asked = durable(marked(given, id_))
    held = durable(marked(spread, chunk_id))
    # Of each heavy word, the heavy words of any chunk that it stands in; its own bit is taken off before the test.
    seen = held.filter("_pos is not null").groupBy("_pos").agg(*[F.bit_or(f"_b{c}").alias(f"_b{c}") for c in columns])
    own = lambda c: F.when(F.floor(F.col("a._pos") / 64) == c, F.expr("~shiftleft(1L, a._pos % 64)")).otherwise(F.lit(-1).cast("long"))
    by_heavy = asked.alias("a").join(F.broadcast(seen).alias("s"), F.col("a._pos") == F.col("s._pos")).filter(
        F.exists(F.array(*[F.col(f"a._b{c}").bitwiseAND(F.col(f"s._b{c}")).bitwiseAND(own(c)) for c in columns]), lambda x: x != 0)
    ).select(F.col(f"a.{id_}").alias(id_)).distinct()
    rest = asked.filter("_pos is null").join(by_heavy, id_, "left_anti")
    met = rest.alias("a").join(held.filter("_pos is null").alias("h"), F.col("a.word") == F.col("h.word")).select(
        F.col(f"a.{id_}").alias(id_), F.col(f"h.{chunk_id}").alias("_chunk"), F.exists(both("a", "h"), lambda x: x != 0).alias("_heavy"))
    by_light = met.groupBy(id_, "_chunk").agg((F.max("_heavy") | (F.count(F.lit(1)) > 1)).alias("_two")).filter("_two").select(id_)
    return by_heavy.unionByName(by_light).distinct()


def skill_groups(skills: DataFrame, entity: str, skill: str, rank: str, labels: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Skills by label table; every group is limited before it is gathered."""
    labelled = skills.join(labels, skill, "left").fillna(next(iter(limits)), subset=["skill_group"])
    once = labelled.groupBy(entity, "skill_group", skill).agg(F.min(rank).alias("_first"))
    top = top_n(once, [entity, "skill_group"], [F.col("_first"), F.col(skill)], max(limits.values()), "_r")
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    from dossierspark.operators.documents import ordered_list
    kept = top.filter(F.col("_r") <= F.try_element_at(limit, F.col("skill_group")))
    return kept.groupBy(entity, "skill_group").agg(F.array_join(ordered_list("_r", skill), ", ").alias("skills"))


def match_reasons(rules, fallback: Column, limit: int = 4) -> Column:
    """Reasons whose condition holds, or one fallback sentence."""
    found = F.slice(F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in rules])), 1, limit)
    return F.when(F.size(found) == 0, F.array(fallback)).otherwise(found)
