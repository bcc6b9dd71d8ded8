"""Ordered rules, term predicates and filters as plain columns, so Catalyst can push them down."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_rule(rules, default) -> Column:
    """CASE over ``(condition, value)`` pairs in order."""
    out = default if isinstance(default, Column) else F.lit(default)
    for condition, value in reversed(list(rules)):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def any_substring(text: Column, terms) -> Column:
    """Few terms are plain ``contains``, which is faster; many are one pattern, which keeps the generated code small."""
    if 0 < len(terms) <= 4:
        return reduce(lambda a, b: a | b, [text.contains(t) for t in terms])
    return text.rlike("|".join(re.escape(t) for t in terms))


def _spaced(text: str) -> str:
    return " " + " ".join(re.sub(r"([^a-z0-9_\s]+)", r" \1 ", text.lower()).split()) + " "


def word_pattern(terms) -> str:
    """Whole words as one pattern with explicit ASCII boundaries."""
    alternatives = "|".join(re.escape(t).replace(r"\ ", " ") for t in terms)
    return rf"(?<![a-z0-9_])(?:{alternatives})(?![a-z0-9_])"


def word_text(lowered: Column) -> Column:
    """Words and punctuation runs of a lower-case one-line text, each between single spaces.

    A whole-word test is then a plain ``contains``, so a row is tokenised once for all terms.
    """
    apart = F.regexp_replace(lowered, r" *([^a-z0-9_ ]+) *", " $1 ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(apart, r" {2,}", " ")), F.lit(" "))


def any_word(words: Column, terms) -> Column:
    """Whole-word test on a ``word_text`` column."""
    return reduce(lambda a, b: a | b, [words.contains(_spaced(t)) for t in terms])


def any_pattern(text: Column, patterns) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def matched_words(words: Column, terms) -> Column:
    """The terms found in a ``word_text`` column, in list order."""
    return F.array_compact(F.array(*[F.when(any_word(words, [t]), F.lit(t)) for t in terms]))


def reason(matches: Column, limit: int = 3) -> Column:
    return F.array_join(F.transform(F.slice(matches, 1, limit), lambda m: F.concat(F.lit("'"), m, F.lit("'"))), ", ")


def count_substrings(text: Column, terms) -> Column:
    return reduce(lambda a, b: a + b, [F.when(text.contains(t), 1).otherwise(0) for t in terms])


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def coerce_choice(c: Column, allowed, default) -> Column:
    value = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.when(value.isin(*allowed), value).otherwise(default if isinstance(default, Column) else F.lit(default))


def coerce_list(c: Column) -> Column:
    """A JSON list stays a list, any other text becomes a list of one; blanks are dropped."""
    parsed = F.from_json(c, "array<string>")
    text = F.trim(F.coalesce(c, F.lit("")))
    items = F.when(text == "", F.array().cast("array<string>")).when(
        text.startswith("[") & parsed.isNotNull(), parsed).otherwise(F.array(text))
    return F.filter(F.transform(items, lambda s: F.trim(s)), lambda s: s.isNotNull() & (s != ""))


def build_filter(spec: dict) -> Column:
    """``{"a": 1}``, ``{"a": {"$in": [...]}}`` and ``{"$and": [...]}`` to a predicate."""
    parts = []
    for key, value in spec.items():
        if key == "$and":
            parts += [build_filter(s) for s in value]
        elif isinstance(value, dict):
            (op, operand), = value.items()
            parts.append({"$in": lambda: F.col(key).isin(*operand), "$eq": lambda: F.col(key) == operand}[op]())
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts)


def resolve_column(columns, candidates) -> str | None:
    """First candidate among the columns by lower-case name, then with spaces as underscores."""
    by_name = {c.lower(): c for c in columns}
    wanted = [c.lower() for c in candidates]
    for c in wanted:
        if c in by_name:
            return by_name[c]
    return next((c for c in columns if c.lower().replace(" ", "_") in wanted), None)
