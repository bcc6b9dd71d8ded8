"""Saved web pages to text, title and links with columns only."""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements without readable text.
DROPPED_ELEMENTS = ("script", "style", "nav", "footer", "header", "aside")
#: Named references that end in a semicolon; a no-break space counts as a blank.
NAMED = {name[:-1]: value.replace("\xa0", " ") for name, value in html5.items() if name.endswith(";")}
#: What numbers 128 to 159 stand for, as browsers read them.
WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}


def _character(number: Column) -> Column:
    """The character of a code point, by its UTF-8 bytes; the replacement character for none."""
    part = lambda shift, low, high: F.lpad(F.hex(F.lit(high).bitwiseOR(F.shiftright(number, shift).bitwiseAND(F.lit(low)))), 2, "0")
    text = lambda *p: F.decode(F.unhex(F.concat(*p)), "UTF-8")
    return (F.when((number < 1) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("\ufffd"))
            .when(number == 160, F.lit(" "))
            .when(number.between(128, 159), F.coalesce(F.try_element_at(_literal(WINDOWS), number.cast("int")), text(part(6, 31, 192), part(0, 63, 128))))
            .when(number < 0x80, text(part(0, 127, 0))).when(number < 0x800, text(part(6, 31, 192), part(0, 63, 128)))
            .when(number < 0x10000, text(part(12, 15, 224), part(6, 63, 128), part(0, 63, 128)))
            .otherwise(text(part(18, 7, 240), part(12, 63, 128), part(6, 63, 128), part(0, 63, 128))))


def _literal(table: dict) -> Column:
    return F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values())))


def decode_entities(c: Column) -> Column:
    """Character references decoded once: all names that end in a semicolon, decimal and hexadecimal numbers. Others stay as they are.

    The text is split at ampersands; each piece then starts with its reference, if it has one.
    """
    names = _literal(NAMED)

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^(#[0-9]{1,8}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        rest = F.substr(p, F.length(name) + 2)
        number = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).try_cast("bigint")
        made = F.when(name.startswith("#"), _character(number)).otherwise(F.try_element_at(names, name))
        return F.when((name != "") & made.isNotNull(), F.concat(made, rest)).otherwise(F.concat(F.lit("&"), p))

    pieces = F.split(c, "&", -1)
    decoded = F.concat(F.get(pieces, 0), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.lit(1), F.size(pieces))), piece), ""))
    return F.when(c.contains("&"), decoded).otherwise(c)


def text_nodes(html: Column) -> Column:
    """Array of trimmed, non-empty text nodes."""
    c = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for tag in DROPPED_ELEMENTS:
        c = F.regexp_replace(c, rf"(?is)<{tag}(?:[ \t\r\n][^>]*)?>.*?</{tag}[ \t\r\n]*>", "\n")
    c = decode_entities(F.regexp_replace(c, r"<[^>]*>", "\n"))
    parts = F.transform(F.split(c, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t\r\f\x0B]+", " ")))
    return F.filter(parts, lambda s: s != "")


def html_to_text(html: Column) -> Column:
    return F.array_join(text_nodes(html), "\n")


def html_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.trim(F.regexp_replace(decode_entities(raw), r"[ \t\r\n]+", " "))


def first_link(html: Column, suffix: str) -> Column:
    return F.regexp_extract(html, rf"""(?i)href="([^"]*{suffix})["#?]""", 1)
