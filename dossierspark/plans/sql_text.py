"""SQL fragments shared by the stated results."""


def one_line(c):
    return rf"trim(regexp_replace(coalesce({c}, ''), '[ \t\n\r\f\x0B\x00]+', ' ', 'g'))"


def text_key(c):
    return f"trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g'))"


def normalize_text(c):
    return f"trim(regexp_replace(lower({one_line(c)}), '[^a-z0-9.%$]+', ' ', 'g'))"


def slug(c, n=80):
    s = f"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    s = f"CASE WHEN {s} = '' THEN 'source' ELSE {s} END"
    return f"regexp_replace(left({s}, {n}), '^_+|_+$', '', 'g')"


def word(c, *terms):
    body = "|".join(t.replace(" ", "[ \\t\\n\\r]+") for t in terms)
    return f"regexp_matches({c}, '(?:^|[^a-z0-9_])(?:{body})(?:[^a-z0-9_]|$)')"


def sub(c, *terms):
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def sentences(c):
    return rf"list_filter(string_split(regexp_replace({one_line(c)}, '([.!?]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


def parse_number(c):
    return f"TRY_CAST(nullif(regexp_extract(replace({one_line(c)}, ',', ''), '[-+]?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE)"
