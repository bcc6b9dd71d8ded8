"""Documents and profiles per entity: ranked, limited lists joined into text, for all entities at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierspark.functions import fixed_terms as V
from dossierspark.operators.ranking import best_row, top_n


def ordered_list(order, value: str) -> Column:
    """Aggregate: values in order. Only for groups that a limit has bounded before."""
    keys = [order] if isinstance(order, str) else list(order)
    return F.transform(F.sort_array(F.collect_list(F.struct(*keys, value))), lambda s: s[value])


def limited_lines(facts: DataFrame, entity, section: str, order, limits: dict[str, int]) -> DataFrame:
    """The first rows of every section, one limit per section."""
    top = top_n(facts.filter(F.col(section).isin(*limits)), [*entity, section], order, max(limits.values()))
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return top.filter(F.col("rank") <= F.try_element_at(limit, F.col(section)))


def section_documents(lines: DataFrame, entity, section: str, title: Column, line: str) -> DataFrame:
    """One document per entity and section: a heading and its bullets in rank order."""
    made = lines.groupBy(*entity, section).agg(ordered_list("rank", line).alias("_lines"), F.count(F.lit(1)).alias("items"))
    body = F.array_join(F.transform("_lines", lambda s: F.concat(F.lit("- "), s)), "\n")
    return made.select(*entity, section, "items", F.concat(title, F.lit("\n"), F.col(section), F.lit(":\n"), body).alias("text"))


def full_documents(sections: DataFrame, entity, section: str, order: list[str], title: Column) -> DataFrame:
    """All sections of an entity in the given order, separated by blank lines; absent ones are left out."""
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(section))
    made = sections.withColumn("_place", place).groupBy(*entity).agg(
        ordered_list("_place", "text").alias("_texts"), F.count(F.lit(1)).alias("sections"))
    return made.select(*entity, "sections", F.array_join(F.concat(F.array(title), F.col("_texts")), "\n\n").alias("text"))


def nested_documents(links: DataFrame, entity: str, outer: str, inner: str, outer_order, inner_order,
                     outer_limit: int = 35, inner_limit: int = 8) -> DataFrame:
    """Outer items with their linked inner items below them, both limited before anything is gathered."""
    outers = top_n(links.select(entity, outer, *[c for c in outer_order if c != outer]).distinct(), [entity],
                   [F.col(c) for c in outer_order], outer_limit, "_outer_rank")
    kept = links.join(outers.select(entity, outer, "_outer_rank"), [entity, outer])
    inners = top_n(best_row(kept, [entity, outer, inner], [F.col(c) for c in inner_order]), [entity, outer],
                   [F.col(c) for c in inner_order], inner_limit, "_inner_rank")
    blocks = inners.groupBy(entity, outer, "_outer_rank").agg(ordered_list("_inner_rank", inner).alias("_inner"))
    block = F.concat(F.lit("- "), F.col(outer), F.lit("\n"),
                     F.array_join(F.transform("_inner", lambda s: F.concat(F.lit("  - "), s)), "\n"))
    return blocks.withColumn("_block", block).groupBy(entity).agg(
        F.array_join(ordered_list("_outer_rank", "_block"), "\n").alias("text"), F.count(F.lit(1)).alias("outer_items"),
        F.sum(F.size("_inner")).alias("inner_items"))


def list_documents(rows: DataFrame, entity, item: str, order, heading: Column, limit: int) -> DataFrame:
    """Distinct items in first-seen order under a heading; a last line counts what is not shown."""
    once = best_row(rows, [*entity, item], order)
    shown = top_n(once, entity, order, limit, remainder="_more")
    made = shown.groupBy(*entity).agg(ordered_list("rank", item).alias("_items"), F.max("_more").alias("_more"))
    tail = F.when(F.col("_more") > 0, F.array(F.concat(F.lit("- "), F.col("_more").cast("string"), F.lit(" more not shown")))).otherwise(
        F.array().cast("array<string>"))
    body = F.concat(F.transform("_items", lambda s: F.concat(F.lit("- "), s)), tail)
    return made.select(*entity, F.size("_items").cast("long").alias("items"), F.concat(heading, F.lit("\n"), F.array_join(body, "\n")).alias("text"))


def entity_detail(lines: DataFrame, entity, section: str, line: str, sections: list[str]) -> DataFrame:
    """All limited lists of an entity in one record, one array per section."""
    grouped = lines.groupBy(*entity, section).agg(ordered_list("rank", line).alias("_lines"))
    return grouped.groupBy(*entity).agg(*[
        F.coalesce(F.max(F.when(F.col(section) == s, F.col("_lines"))), F.array().cast("array<string>")).alias(s)
        for s in sections])


def join_natural(items: Column) -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    n = F.size(items)
    return F.when(n == 0, F.lit("")).when(n == 1, F.get(items, 0)).otherwise(
        F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(items, n - 1)))


def activity_phrase(task: Column, gerunds=V.GERUNDS) -> Column:
    """The task with its leading verb as a gerund and a lower-case start."""
    text = F.regexp_replace(F.trim(task), r"[.;: \t\n]+$", "")
    low = F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))
    verb = F.regexp_extract(low, r"^([a-z]+) ", 1)
    lookup = F.create_map(*[F.lit(x) for kv in gerunds.items() for x in kv])
    new = F.try_element_at(lookup, verb)
    return F.when(new.isNotNull(), F.concat(new, F.substr(low, F.length(verb) + 1))).otherwise(low)


# The sentences of the narrative.
NO_TASKS = ("The day-to-day rhythm is hard to pin down from the retrieved rows, so this career deserves more "
            "occupation-specific research before deciding.")
OPENING = ("A typical day as ", " would probably start with sorting out what needs attention first, then spending focused time on ", ".")
THREE_TASKS = ("As the day develops, the work may shift between ", " and ", ", so the role rewards someone who can keep the details connected.")
TWO_TASKS = ("As the day develops, the work may shift toward ", ", so the role rewards steady attention and practical judgment.")
ONE_TASK = ("The work is less about one dramatic moment and more about making sound decisions as similar responsibilities "
            "come up again and again.")
SETTING = ("The setting also points to ", ", which shapes the pace and the kind of communication the day asks for.")
NO_SETTING = ("By the end of the day, the value is in leaving the work clearer, more accurate, and easier for the next "
              "person to act on.")


def narrative(title: Column, tasks: Column, contexts: Column, gerunds=V.GERUNDS) -> Column:
    """Opening, middle and closing sentence from up to three tasks and two contexts."""
    phrase = lambda i: activity_phrase(F.get(tasks, i), gerunds)
    article = F.when(F.lower(F.substring(title, 1, 1)).isin("a", "e", "i", "o", "u"), F.lit("an ")).otherwise(F.lit("a "))
    n = F.size(tasks)
    opening = F.concat(F.lit(OPENING[0]), article, title, F.lit(OPENING[1]), phrase(0), F.lit(OPENING[2]))
    middle = (
        F.when(n >= 3, F.concat(F.lit(THREE_TASKS[0]), phrase(1), F.lit(THREE_TASKS[1]), phrase(2), F.lit(THREE_TASKS[2])))
        .when(n == 2, F.concat(F.lit(TWO_TASKS[0]), phrase(1), F.lit(TWO_TASKS[1]))).otherwise(F.lit(ONE_TASK)))
    setting = join_natural(F.slice(F.transform(contexts, lambda c: F.lower(F.substring_index(c, ":", 1))), 1, 2))
    closing = F.when(setting != "", F.concat(F.lit(SETTING[0]), setting, F.lit(SETTING[1]))).otherwise(F.lit(NO_SETTING))
    return F.when(n == 0, F.lit(NO_TASKS)).otherwise(F.concat_ws(" ", opening, middle, closing))


def markdown_table(rows: DataFrame, report, order: str, columns: dict[str, Column]) -> DataFrame:
    """A pipe table per report; rows must be limited per report before."""
    cell = lambda c: F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("|"), F.lit("/"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in columns.values()]), F.lit(" |"))
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns)
    made = rows.withColumn("_line", line).groupBy(*report).agg(ordered_list(order, "_line").alias("_lines"))
    return made.select(*report, F.concat_ws("\n", F.lit(head), F.array_join("_lines", "\n")).alias("markdown"))


def union_lines(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
