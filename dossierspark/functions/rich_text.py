"""Normalisation of extracted text: ligatures, broken encodings, quotes, dashes, hyphen line breaks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossierspark.functions.udfs import nfkc

# Texts that must be replaced for equal results.
LIGATURES = {
    "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl",
    "ï¬\u0081": "fi", "ï¬\u0082": "fl", "ï¬\u0083": "ffi", "ï¬\u0084": "ffl",
}
BROKEN_MARKS = {
    "â€˜": "'", "â€™": "'", "â€œ": '"', "â€\u009d": '"',
    "â€“": "-", "â€”": "-", "â€¦": "...", "…": "...",
}
SINGLE_QUOTES = "‘’‚‛′"
DOUBLE_QUOTES = "“”„‟″"
DASHES = "‐‑‒–—―−"

WHITE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1c-\x1f]"


def strip_white(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{WHITE}+|{WHITE}+$", "")


def normalize_rich(c: Column) -> Column:
    # The compatibility form resolves the ligature characters; the table catches the rest.
    c = nfkc(strip_white(F.coalesce(c, F.lit(""))))
    for old, new in {**LIGATURES, **BROKEN_MARKS}.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    c = F.translate(c, SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + " ",
                    "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " ")
    c = F.regexp_replace(c, rf"(?U)(?<=\w)-{WHITE}*\n{WHITE}*(?=\w)", "")
    return strip_white(F.regexp_replace(c, rf"{WHITE}+", " "))


def relaxed(c: Column, keep_gap: bool = False) -> Column:
    """Punctuation-free lower case; an ellipsis becomes a gap marker or a space."""
    return relaxed_normal(normalize_rich(c), keep_gap)


def relaxed_normal(normal: Column, keep_gap: bool = False) -> Column:
    """``relaxed`` of a text that ``normalize_rich`` made."""
    c = F.regexp_replace(F.lower(normal), r"\.\.\.|\x{2026}", " <gap> " if keep_gap else " ")
    c = F.regexp_replace(c, r"(?U)[^\w\s<>]", " ")
    return F.trim(F.regexp_replace(c, r" +", " "))
