"""Cleaning of extracted text and metadata as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from sedge.operators.predicates import first_match

# Names of the two product languages, and what a language code looks like.
LANGUAGE_NAMES = (("vi", "vi|vie|vi-vn|vi-vt|vietnamese|tiếng việt"), ("en", "en|eng|en-us|en-gb|english"))
# Cells that a translation leaves alone.
PLAIN_CELLS = (
    r"^[0-9.,\-+×·±%eE()\s]*$", r"^\[[0-9,\s–—-]+\]$", r"^\([A-Z][a-zA-Z\s]+,?\s*[0-9]{4}[a-z]?\)$", r"(?i)^https?://(?:dx\.)?doi\.org/10\.[0-9]{4,9}/\S+$",
    r"(?i)^doi\s*:\s*10\.[0-9]{4,9}/\S+$", r"^(?:p|r|β|χ²?|F|t|z)\s*[=<>≤≥]\s*[0-9.]+\s*$", r"^95\s*%\s*CI[\s\[\]0-9.,–—-]*$", r"^\\[a-zA-Z]+(?:\{[^}]*\})*$",
)
# Ligatures, first parts of compounds that keep their hyphen at a line's end, captions of figures and tables.
LIGATURES = (("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))
COMPOUNDS = (
    "co pre post non self anti multi semi sub cross inter intra pro pseudo ex ultra micro macro bio geo eco cyber neuro psycho socio "
    "well ill good bad high low long short full part half first last second third free new old"
).split()
CAPTION = r"(?i)(?:figure|figs?|fig|table|tabs?|hình|bảng)\.?\s*([0-9]+[a-z]?)"


def language_code(x: Column) -> Column:
    """The code of a language's name, or the first part of a code; null where there is none."""
    c = F.lower(F.trim(x))
    first = F.regexp_extract(c, r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    out = F.when(c.isin("", "unknown"), None)
    for code, names in LANGUAGE_NAMES:
        out = out.when(c.isin(names.split("|")), code)
    return out.otherwise(F.nullif(first, F.lit("")))


def plain_cell(x: Column) -> Column:
    """Whether a cell holds nothing to translate: numbers, a citation, a DOI, a statistic, a formula."""
    c = F.trim(x)
    return F.coalesce(F.greatest(*[c.rlike(p) for p in PLAIN_CELLS]), F.lit(True))


def caption_number(x: Column) -> Column:
    """The number in a caption of a figure or table, lower case; empty without one."""
    return F.lower(F.regexp_extract(x, CAPTION, 1))


def without_ligatures(x: Column) -> Column:
    for one, letters in LIGATURES:
        x = F.replace(x, F.lit(one), F.lit(letters))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def reflowed(x: Column) -> Column:
    """The lines of a text as one: words cut at a line's end are joined, without the hyphen unless it is a compound's."""
    lines = F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda line: F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))), lambda line: line != ""), "\n")
    kept = F.regexp_replace(lines, rf"(?i)(?<![a-z])({'|'.join(COMPOUNDS)})-\n(?=\p{{L}})", "$1-")
    return without_ligatures(F.regexp_replace(F.regexp_replace(kept, r"(?<=\p{L})-\n(?=\p{L})", ""), "\n", " "))


def like_case(source: Column, word: Column) -> Column:
    """word in the case of source: all capitals, a capital first, or as it is."""
    first = F.substring(source, 1, 1)
    capital = (first == F.upper(first)) & (first != F.lower(first))
    return first_match_value([((source == F.upper(source)) & (source != F.lower(source)), F.upper(word)), (capital, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word))))], word)


def first_match_value(rules: list[tuple[Column, Column]], otherwise: Column) -> Column:
    out = otherwise
    for holds, value in reversed(rules):
        out = F.when(holds, value).otherwise(out)
    return out


def anchored(text: Column, digest: Column, start: Column, end: Column, quote: Column) -> Column:
    """Whether a text still is the one a quote was taken from, and holds it at its place (characters from 0)."""
    return F.coalesce((F.sha2(text, 256) == digest) & (F.substring(text, start + 1, end - start) == quote), F.lit(False))


def text_or_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def year(x: Column) -> Column:
    """A year between 1000 and 2999 as a number, else null."""
    n = F.trim(x).try_cast("int")
    return F.when(n.between(1000, 2999), n)


def one_of(x: Column, values: list[str], otherwise: str) -> Column:
    c = F.lower(F.trim(x))
    return F.when(c.isin(values), c).otherwise(otherwise)


def signal(text: Column, rules: list[tuple[str, list[str], list[str], list[str]]], otherwise: str) -> Column:
    """The first of the rules (name, all, any, none: patterns) that a text follows."""
    def holds(every, some, none):
        out = F.lit(True)
        for p in every:
            out = out & text.rlike(p)
        if some:
            out = out & text.rlike("|".join(f"(?:{p})" for p in some))
        for p in none:
            out = out & ~text.rlike(p)
        return out

    return first_match([(name, holds(*groups)) for name, *groups in rules], otherwise)
