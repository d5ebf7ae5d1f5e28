"""Markdown helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import WS, rtrim_ws, trim_ws


def escape_inline(c: Column) -> Column:
    """Characters that Markdown reads as formatting get a backslash."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"([\\`*_\[\]<>~])", r"\\$1")


def escape_line_start(c: Column) -> Column:
    """What opens a block at the start of a line gets a backslash, on every line."""

    def one(line: Column) -> Column:
        ordered = F.regexp_replace(line, rf"\A([{WS}]*\p{{Nd}}{{1,9}})([.)])(?=[{WS}]|\z)", r"$1\\$2")
        opens = line.rlike(r"\A[ \t]*(?:>|[#+*\-](?:[ \t]|\z)|-[- \t]*\z|=[= \t]*\z)")
        return F.when(ordered != line, ordered).when(opens, F.regexp_replace(line, r"\A([ \t]*)", r"$1\\")).otherwise(line)

    return F.array_join(F.transform(F.split(c, "\n", -1), one), "\n")


def table_cell(c: Column) -> Column:
    return trim_ws(F.replace(F.regexp_replace(c, "\r\n|\r|\n", "<br>"), F.lit("|"), F.lit("\\|")))


def collapse_whitespace(c: Column) -> Column:
    return trim_ws(F.regexp_replace(c, f"[{WS}]+", " "))


def join_blocks(blocks: DataFrame, doc: str = "doc_id", order: str = "block_ix") -> DataFrame:
    """Assemble blocks (doc, order, text, is_list_item, list_key) into one Markdown text a document.

    Blank blocks go; items of one list follow each other line by line, different lists are
    kept apart by an empty comment, everything else by a blank line.  Orders must be distinct.
    """
    kept = blocks.filter(F.col("text").rlike(f"[^{WS}]")).withColumn("text", rtrim_ws(F.col("text")))
    w = Window.partitionBy(doc).orderBy(order)
    both = F.col("is_list_item") & F.lag("is_list_item").over(w)
    between = F.when(F.row_number().over(w) == 1, "").when(
        both, F.when(F.col("list_key").eqNullSafe(F.lag("list_key").over(w)), "\n").otherwise("\n\n<!-- -->\n\n")
    ).otherwise("\n\n")
    parts = kept.select(doc, order, F.concat(between, "text").alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "part"))), lambda x: x["part"]), "")
    return parts.groupBy(doc).agg(F.concat(whole, F.lit("\n")).alias("markdown"))


#: Characters that pad mails invisibly, as regex class members.
INVISIBLE = r"\x{34F}\x{AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{180E}"


def html_text(c: Column) -> Column:
    """A text node: invisible characters dropped, white space runs as one space."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), f"[{INVISIBLE}]", ""), f"[{WS}]+", " ")


#: Styles that hide an element, as parts of a style attribute and as whole declarations (with px, % or nothing).
HIDDEN_PARTS = ("display:none", "visibility:hidden", "mso-hide:all")
HIDDEN_DECLARATIONS = ("opacity:0", "max-height:0", "font-size:0", "font-size:1px")


def hidden_style(style: Column) -> Column:
    """Whether a style attribute hides its element."""
    compact = F.lower(F.replace(F.coalesce(style, F.lit("")), F.lit(" "), F.lit("")))
    parts = F.transform(F.split(compact, ";", -1), lambda p: F.replace(p, F.lit("!important"), F.lit("")))
    exact = F.exists(parts, lambda p: p.rlike(rf"\A(?:{'|'.join(HIDDEN_DECLARATIONS)})(?:px|%)?\z"))
    return compact.rlike("|".join(HIDDEN_PARTS)) | exact


def compact_html_blanks(c: Column) -> Column:
    """At most one blank line, no spaces at line ends, no outer line feeds."""
    x = F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), rf"[{WS}&&[^\n]]+(?=\n|\z)", "")
    return F.trim(F.regexp_replace(x, "\n{3,}", "\n\n"), F.lit("\n"))


def heading_level_of_style(name: Column) -> Column:
    """Level of a heading style by its name: 1-9, or null."""
    level = F.regexp_extract(name, rf"(?iu)\A(?:heading|t[ií]?tulo|ttulo|titre|berschrift|überschrift)[{WS}]*([1-9])\z", 1)
    return F.when(F.lower(F.trim(name)) == "title", 1).when(
        F.lower(F.trim(name)) == "subtitle", 2
    ).otherwise(F.nullif(level, F.lit("")).cast("int"))


def normalize_extension(c: Column) -> Column:
    """A path or extension as a lower-case extension with its dot; blank gives an empty text."""
    trimmed = trim_ws(F.coalesce(c, F.lit("")))
    ext = F.regexp_extract(trimmed, r"(\.[^./\\]+)\z", 1)
    plain = F.when(trimmed.startswith("."), trimmed).otherwise(F.concat(F.lit("."), trimmed))
    return F.lower(F.when(trimmed == "", "").when(ext != "", ext).otherwise(plain))


#: File signatures.
SIGNATURES = {"25504446": "pdf", "89504E47": "png", "FFD8FF": "jpeg", "49492A00": "tiff", "4D4D002A": "tiff"}
EXTENSIONS = {".pdf": "pdf", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg", ".jpe": "jpeg", ".tif": "tiff", ".tiff": "tiff"}


def detect_format(content: Column, name: Column) -> Column:
    """pdf, png, jpeg, tiff or unknown: by signature (four bytes at least), else by extension."""
    head = F.hex(F.substring(content, 1, 4))
    ext = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(\.[^./\\]+)\z", 1))
    out = F.when(F.lit(False), F.lit(""))
    for sign, kind in SIGNATURES.items():
        out = out.when((F.octet_length(content) >= 4) & head.startswith(sign), kind)
    for e, kind in EXTENSIONS.items():
        out = out.when(ext == e, kind)
    return out.otherwise("unknown")


def to_percent(c: Column) -> Column:
    return F.when(c <= 1, c * 100).otherwise(c)


#: Extensions of image types.
IMAGE_EXTENSIONS = {
    "image/png": ".png", "image/jpeg": ".jpg", "image/jpg": ".jpg", "image/gif": ".gif", "image/bmp": ".bmp",
    "image/tiff": ".tiff",
    "image/svg+xml": ".svg", "image/x-emf": ".emf", "image/emf": ".emf", "image/x-wmf": ".wmf", "image/wmf": ".wmf",
}


def image_extension(mime: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for m, e in IMAGE_EXTENSIONS.items():
        out = out.when(F.lower(mime) == m, e)
    return out.otherwise(".bin")
