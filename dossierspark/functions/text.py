"""Text expressions as native columns. Character classes are ASCII and explicit on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Any white-space run other than one plain space: most words need no replacement.
SPACE = r" *[\t\n\r\f\x0B][ \t\n\r\f\x0B]*| {2,}"
# Written out: tasks that test a class with ranges side by side in one JVM slow each other down (8 tasks: some thirty times, one alone: twice).
LETTERS_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def clean_text(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit(" "))
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def one_line(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\x00"), F.lit(" "))
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalize_text(c: Column) -> Column:
    """Lower case, keeping letters, digits and ``. % $``."""
    return F.trim(F.regexp_replace(F.lower(one_line(c)), f"[^{LETTERS_DIGITS}.%$]+", " "))


def text_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"[^{LETTERS_DIGITS}]+", " "))


def title_key(c: Column) -> Column:
    return text_key(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and ")))


def _strip_underscores(c: Column) -> Column:
    return F.regexp_replace(c, r"^_+|_+$", "")


def slug(c: Column, max_length: int = 80) -> Column:
    s = _strip_underscores(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", "_"))
    s = F.when(s == "", F.lit("source")).otherwise(s)
    return _strip_underscores(F.substring(s, 1, max_length))


def stable_id(prefix: str, *parts: Column) -> Column:
    """Readable slug plus a hash over all parts joined by a separator no text contains."""
    clean = [one_line(p.cast("string")) for p in parts]
    present = F.array_join(F.filter(F.array(*clean), lambda p: p != ""), "_")
    digest = F.substring(F.sha2(F.concat_ws("\x1f", *clean), 256), 1, 10)
    return F.concat(F.lit(prefix + "_"), slug(present), F.lit("_"), digest)


def url_source_base(url: Column) -> Column:
    """Host label, path slug and a short hash of the url."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]+([^?#]*)", 1), r"^/+|/+$", "")
    label = F.substring_index(host, ".", 1)
    page = F.when(path == "", F.lit("homepage")).otherwise(slug(path))
    return slug(F.concat_ws("_", label, page, F.substring(F.sha2(url, 256), 1, 10)))


def classification_code(c: Column, drop=()) -> Column:
    """First code of the shape ``NN-NNNN.NN``; six digits get the suffix ``.00``."""
    text = F.upper(one_line(c))
    for fragment in drop:
        text = F.replace(text, F.lit(fragment), F.lit(""))
    shape = r"([0-9]{2})[- ]?([0-9]{4})(?:[. -]?([0-9]{2}))?"
    major, minor, tail = (F.regexp_extract(text, shape, i) for i in (1, 2, 3))
    return F.when(major == "", F.lit("")).otherwise(
        F.concat(major, F.lit("-"), minor, F.lit("."), F.when(tail == "", F.lit("00")).otherwise(tail)))


def parse_number(c: Column) -> Column:
    digits = F.regexp_extract(F.replace(one_line(c), F.lit(","), F.lit("")), r"[-+]?[0-9]+(?:\.[0-9]+)?", 0)
    return F.nullif(digits, F.lit("")).try_cast("double")


def integer_text(c: Column) -> Column:
    """Identifiers such as ``12.0`` become ``12``; anything else stays one line."""
    n = parse_number(c)
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(whole, n.try_cast("long").cast("string")).otherwise(one_line(c))


def truncate(c: Column, limit: int) -> Column:
    text = one_line(c)
    return F.when(F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit - 3)), F.lit("..."))).otherwise(text)


def truncate_at_word(c: Column, limit: int) -> Column:
    text = one_line(c)
    cut = F.regexp_replace(F.substring(text, 1, limit - 3), r" [^ ]*$", "")
    return F.when(F.length(text) > limit, F.concat(F.rtrim(cut), F.lit("..."))).otherwise(text)


def key_value_text(columns, separator: str = "; ") -> Column:
    """``key: value`` for every non-empty field, in the given order."""
    parts = []
    for name in columns:
        value = one_line(F.col(name).cast("string"))
        parts.append(F.when(value != "", F.concat(F.lit(f"{name}: "), value)))
    return F.concat_ws(separator, *parts)


def tokens(c: Column, stop_words=(), min_length: int = 3) -> Column:
    found = F.array_distinct(F.filter(F.split(text_key(c), " "), lambda t: F.length(t) >= min_length))
    return F.array_except(found, F.array(*[F.lit(w) for w in stop_words])) if stop_words else found


def expand_terms(terms: Column, expansions: dict[str, list[str]]) -> Column:
    """Each term followed by its expansions, first occurrence kept."""
    entries = []
    for key, values in expansions.items():
        entries += [F.lit(key), F.array(*[F.lit(v) for v in values])]
    lookup = F.create_map(*entries)
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(
        terms, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(lookup, t), empty)))))


def page_range(start: Column, end: Column) -> Column:
    s, e = start.cast("string"), end.cast("string")
    return (
        F.when(start.isNull() & end.isNull(), F.lit(""))
        .when(start.isNull(), F.concat(F.lit("p. "), e))
        .when(end.isNull() | (start == end), F.concat(F.lit("p. "), s))
        .otherwise(F.concat(F.lit("pp. "), s, F.lit("-"), e))
    )


def redact_numbers(c: Column, marker: str = "[number omitted]") -> Column:
    return F.regexp_replace(c, r"(?<![A-Za-z])[-+]?[0-9]+(?:[.,][0-9]+)*%?", marker)


def _bound(c: Column, use) -> Column:
    """``use(c)`` with ``c`` computed once, however often it is used: a lambda variable holds its value."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _with_previous(sorted_items: Column, field: str) -> Column:
    """Each element next to the field of the one before it."""
    return _bound(sorted_items, lambda items: F.transform(items, lambda s, i: F.struct(s.alias("s"), F.get(items, i - 1)[field].alias("p"))))


def dedupe_list(items: Column) -> Column:
    """Case-insensitive distinct in first-seen order; sorts by key instead of comparing all pairs."""
    tagged = F.array_sort(F.transform(items, lambda x, i: F.struct(
        F.lower(one_line(x)).alias("k"), i.alias("i"), one_line(x).alias("x"))))
    firsts = F.filter(_with_previous(tagged, "k"), lambda t: (t["s"]["k"] != "") & (
        t["p"].isNull() | (t["s"]["k"] != t["p"])))
    ordered = F.array_sort(F.transform(firsts, lambda t: F.struct(t["s"]["i"].alias("i"), t["s"]["x"].alias("x"))))
    return F.transform(ordered, lambda s: s["x"])


def singular(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 3), F.regexp_replace(word, "ies$", "y"))
        .when(word.endswith("ses"), F.regexp_replace(word, "es$", ""))
        .when(word.endswith("s") & ~word.endswith("ss"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def plural(word: Column) -> Column:
    return (
        F.when(word.endswith("y") & (F.length(word) > 1), F.regexp_replace(word, "y$", "ies"))
        .when(word.endswith("s"), word)
        .otherwise(F.concat(word, F.lit("s")))
    )


def title_variants(c: Column) -> Column:
    """The key of a title and the same with a singular and a plural last word."""
    key = title_key(c)
    head = F.regexp_replace(key, r"[^ ]+$", "")
    last = F.regexp_extract(key, r"([^ ]+)$", 1)
    return F.filter(F.array_distinct(F.array(key, F.concat(head, singular(last)), F.concat(head, plural(last)))),
                    lambda v: v != "")


def sentences(c: Column) -> Column:
    return F.filter(F.split(one_line(c), r"(?<=[.!?]) +"), lambda s: s != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[A-Za-z0-9_]+"))


def lines(c: Column) -> Column:
    return F.split(c, "\n")


def dedupe_lines(text_lines: Column) -> Column:
    """First copy of each content line; blank runs shrink to one; original order kept. Lines hold no line break."""
    stripped = F.transform(text_lines, lambda s: F.btrim(s, F.lit(" \t\r\f\x0B")))
    # A blank line carries a line break and its number, so all blank lines pass where equal ones go.
    numbered = F.transform(stripped, lambda s, i: F.when(s == "", F.concat(F.lit("\n"), i.cast("string"))).otherwise(s))
    blank = lambda s: s.startswith("\n")
    single = _bound(F.array_distinct(numbered), lambda kept: F.filter(kept, lambda s, i: ~blank(s) | (i == 0) | ~blank(F.get(kept, i - 1))))
    return F.transform(single, lambda s: F.when(blank(s), F.lit("")).otherwise(s))


def section(c: Column, heading: str) -> Column:
    """Text between a heading line and the next line of the form ``Name:``; '' when absent."""
    return F.regexp_extract(c, rf"(?s)(?:^|\n){heading}:[ \t]*\n(.*?)(?:\n[A-Z][A-Za-z /&-]*:[ \t]*(?:\n|$)|$)", 1)


def task_lines(c: Column, min_words: int = 4) -> Column:
    """Bullet lines with at least four words, without ``Label:`` lines."""
    bullets = F.filter(F.transform(lines(F.coalesce(c, F.lit(""))), one_line), lambda s: s.startswith("- "))
    bodies = F.transform(bullets, lambda s: F.trim(F.substr(s, F.lit(3))))
    return F.filter(bodies, lambda s: (F.size(F.split(s, " ")) >= min_words) & ~s.rlike(r"^[A-Z][A-Za-z /&-]{2,40}:"))
