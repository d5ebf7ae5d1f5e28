"""Whitespace normalisation, token estimates and the Markdown cleaner, as column expressions.

Lengths are UTF-16 code units.  A null text gives an empty text or 0, never null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import ship
from .options import CleanerOptions, NormalizeOptions

# White space, zero-width characters and wide spaces, as regex class members.
WS = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
ZERO_WIDTH = r"\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}"
WIDE_SPACE = r"\x{A0}\x{1680}\x{202F}\x{205F}\x{3000}\x{2000}-\x{200A}"

#: Tokens estimated for a text are multiplied by the factor of the model family.
FAMILY_FACTORS = {"generic": 1.00, "o200k": 1.00, "cl100k": 1.10, "other": 1.00}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(_text(c), "UTF-16LE")) / 2).cast("int")


def trim_ws(c: Column) -> Column:
    """Both ends without Unicode white space."""
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def rtrim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{WS}]+\z", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def count_words(c: Column) -> Column:
    """Runs of anything but white space: one more than the white space between them (a class by exclusion is ten times slower)."""
    between = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    spaced = F.trim(F.regexp_replace(_text(c), f"[{WS}]+", " "))
    return let(spaced, lambda x: F.when(x == "", 0).otherwise(between(x) + 1))


def _factor(family: str | Column) -> Column:
    if isinstance(family, str):
        return F.lit(FAMILY_FACTORS.get(family.lower(), FAMILY_FACTORS["generic"]))
    out = F.lit(1.0)
    for name, value in FAMILY_FACTORS.items():
        out = F.when(F.lower(family) == name, F.lit(value)).otherwise(out)
    return out


def estimate_tokens(c: Column, family: str | Column = "generic") -> Column:
    """ceil(max(length / 4, words * 0.75) * factor), in doubles; 0 for an empty text."""
    n = utf16_length(c)
    return F.when(n == 0, 0).otherwise(
        F.ceil(F.greatest(n / F.lit(4.0), count_words(c) * F.lit(0.75)) * _factor(family))
    ).cast("int")


def estimate_tokens_from_length(n: Column, family: str | Column = "generic") -> Column:
    return F.when(F.coalesce(n, F.lit(0)) <= 0, 0).otherwise(F.ceil(n / F.lit(4.0) * _factor(family))).cast("int")


def line_feeds(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def normalize_text(c: Column, options: NormalizeOptions = NormalizeOptions()) -> Column:
    """Whitespace normalisation.

    All default steps are one chain of expressions; combinations in which the order of spaces and
    line feeds matters run the row-wise machine in an Arrow function.
    """
    if not options.collapse_newlines and options == NormalizeOptions(collapse_newlines=False):
        return _chain(c, None)
    if options == NormalizeOptions(max_newlines=options.max_newlines):
        return _chain(c, max(1, options.max_newlines))

    ship()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: normalize_row(t, options))

    return run(_text(c))


def _chain(c: Column, most: int | None) -> Column:
    x = F.regexp_replace(line_feeds(_text(c)), f"[{ZERO_WIDTH}]", "")
    x = F.regexp_replace(x, rf"[{WIDE_SPACE}\t ]+", " ")
    x = F.regexp_replace(x, " ?\n ?", "\n")
    if most is not None:
        x = F.regexp_replace(x, f"\n{{{most + 1},}}", "\n" * most)
    return F.regexp_replace(x, r"\A[ \n]+|[ \n]+\z", "")


def normalize_row(text: str | None, o: NormalizeOptions) -> str:
    """The normaliser as a machine over segments, for any options."""
    text = re.sub("\r\n?", "\n", text or "")
    if o.unicode_whitespace:
        text = re.sub("[​‌‍⁠﻿]", "", text)
        text = re.sub("[    　 - ]", " ", text)
    if o.convert_tabs:
        text = text.replace("\t", " " * max(0, o.spaces_per_tab))
    gap = (lambda n: " " * min(n, 1)) if o.collapse_spaces else (lambda n: " " * n)
    most = max(1, o.max_newlines) if o.collapse_newlines else None
    out, spaces, feeds = "", 0, 0
    for part in re.findall(r" +|\n|\t|[^ \n\t]+", text):
        if part[0] == " ":
            spaces += len(part)
        elif part == "\n":
            if not o.trim_line_end:
                out += gap(spaces)
            spaces, feeds = 0, feeds + 1
        else:
            if out and feeds:
                out += "\n" * (feeds if most is None else min(feeds, most))
            feeds = 0
            if part == "\t" or out and out[-1] != "\n":
                out += gap(spaces)
            spaces = 0
            out += part
    if not o.trim_block:
        if out and feeds:
            out += "\n" * (feeds if most is None else min(feeds, most))
        if out and out[-1] != "\n":
            out += gap(spaces)
    return out


def normalize_with_metrics(c: Column, options: NormalizeOptions = NormalizeOptions()) -> Column:
    """struct(text, original_chars, result_chars, saved_chars, reduction_pct)."""
    out = normalize_text(c, options)
    before, after = utf16_length(c), utf16_length(out)
    pct = F.when(before == 0, F.lit(0.0)).otherwise((before - after) * F.lit(100.0) / before)
    return F.struct(
        out.alias("text"), before.alias("original_chars"), after.alias("result_chars"),
        (before - after).alias("saved_chars"), pct.alias("reduction_pct")
    )


# The patterns of the cleaner (digits are any decimal digit of Unicode).
PAGE_LINE = r"^[ \t]*p(?:[áa]g(?:ina)?[.:]?|[.:])[ \t]*(\p{Nd}{1,6})(?:[ \t]*(?:de|[/\-])[ \t]*\p{Nd}{1,6})?[ \t]*\.?$"
PRINT_DATE = (
    r"(?:impreso(?:[ \t]+el)?|fecha[ \t]+de[ \t]+impresi[oó]n)?[ \t]*:?[ \t]*\p{Nd}{1,2}[/.\-]\p{Nd}{1,2}[/.\-]\p{Nd}{2,4}"
    r"(?:[ \t]+\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?(?:[ \t]*[ap]\.?[ \t]?m\.?)?)?"
)
COVER = r"\bcar[áa]tula\b"
EMPTY_COMMENT = r"<!--\s*-->"


def strip_noise(line: Column, keywords: tuple[str, ...] = ()) -> Column:
    """A line without print dates, the word for a cover sheet, and further key words."""
    out = F.regexp_replace(line, f"(?iU){PRINT_DATE}", " ")
    out = F.regexp_replace(out, f"(?iU){COVER}", " ")
    words = [re.escape(k.strip()) for k in keywords if k.strip()]
    return F.regexp_replace(out, rf"(?iU)\b(?:{'|'.join(words)})\b", " ") if words else out


def normalize_pagination(c: Column, o: CleanerOptions = CleanerOptions()) -> Column:
    """Lines that hold only a page number become markers; the first line of content has its own."""
    lines = F.split(c, "\n", -1)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(rf"[^{WS}]")), True) - 1

    def convert(line: Column, i: Column) -> Column:
        page = F.regexp_extract(strip_noise(line, o.extra_keywords), f"(?idU){PAGE_LINE}", 1)
        shown = F.when(
            i == first, F.replace(F.lit(o.leading_marker), F.lit("{0}"), page)
        ).otherwise(F.replace(F.lit(o.marker), F.lit("{0}"), page))
        return F.when(line.rlike("[0-9]") & (page != ""), shown).otherwise(line)

    return F.array_join(F.transform(lines, convert), "\n")


def remove_artifacts(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"(?U){EMPTY_COMMENT}", ""), "_{6,}", "")


def compact_blank_lines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?md)^[ \t]+$", ""), "\n{3,}", "\n\n")


def clean_markdown(c: Column, o: CleanerOptions = CleanerOptions()) -> Column:
    """The cleaner: line ends, pagination, artefacts, blank lines, outer line feeds; in this order."""
    x = line_feeds(_text(c))
    x = normalize_pagination(x, o) if o.normalize_pagination else x
    x = remove_artifacts(x) if o.remove_artifacts else x
    x = compact_blank_lines(x) if o.compact_blank_lines else x
    return F.trim(x, F.lit("\n"))
